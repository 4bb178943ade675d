"""Composition of the structural, domain and integrity gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators.domain import _required_mask, decide_from_masks
from veriframe.operators.structural import claim_index
from veriframe.sources.profiles import Profile


def final_authorization(domain: DataFrame, structural: DataFrame, integrity: DataFrame) -> DataFrame:
    """``S & D & I`` per (package, claim); absence of deficit rows means a gate conforms."""
    s = structural.groupBy("package_id", "claim").agg(F.count("*").alias("n_structural"))
    i = integrity.groupBy("package_id").agg(F.count("*").alias("n_integrity"))
    out = domain.join(s, ["package_id", "claim"], "left").join(i, "package_id", "left")
    out = out.withColumn("structural_ok", F.col("n_structural").isNull())
    out = out.withColumn("integrity_ok", F.col("n_integrity").isNull())
    out = out.withColumn("domain_ok", F.col("status") == "profile_authorized")
    return out.withColumn("authorized", F.col("structural_ok") & F.col("domain_ok") & F.col("integrity_ok"))


def final_by_package(masks: DataFrame, structural: DataFrame, integrity: DataFrame, profile: Profile) -> DataFrame:
    """`final_authorization` decided from one row a package; claims are expanded last, so none of their rows is moved.

    ``masks``: packages with their status masks; ``structural``: of `package_masks`; ``integrity``: deficit rows.
    A package without a row in the last two conforms."""
    odd = integrity.select("package_id").distinct().withColumn("odd", F.lit(True))
    per = masks.join(structural.hint("merge"), "package_id", "left").join(odd.hint("merge"), "package_id", "left")
    zero, index = F.lit(0).cast("bigint"), claim_index(profile)
    bits = F.create_map(*[x for c in profile.claims for x in (F.lit(c), F.struct(F.lit(1 << index[c]).cast("bigint").alias("claim"), F.lit(_required_mask(profile, c)).cast("bigint").alias("need")))])[F.col("claim")]
    out = decide_from_masks(per, profile)
    failing = F.coalesce("s_claims", zero).bitwiseAND(bits["claim"]).bitwiseOR(F.coalesce("s_open", zero).bitwiseAND(bits["need"]))
    out = out.withColumn("structural_ok", failing == 0).withColumn("integrity_ok", F.col("odd").isNull())
    out = out.withColumn("domain_ok", F.col("status") == "profile_authorized")
    return out.withColumn("authorized", F.col("structural_ok") & F.col("domain_ok") & F.col("integrity_ok")).drop("s_claims", "s_open", "odd")


def domain_and_integrity(domain: DataFrame, integrity: DataFrame) -> DataFrame:
    i = integrity.groupBy("package_id").agg(F.count("*").alias("n_integrity"))
    out = domain.join(i, "package_id", "left").withColumn("integrity_ok", F.col("n_integrity").isNull())
    return out.withColumn("authorized", F.col("integrity_ok") & (F.col("status") == "profile_authorized"))
