"""Structural gate: package fields, required blocks, statuses, metadata and observations.

Only the graph contract is checked here; a supplied block with status ``failed``
is structurally fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators.domain import _fields_of_block
from veriframe.sources.profiles import STATUSES, Profile


def package_field_deficits(requests: DataFrame, profile: Profile) -> DataFrame:
    """``requests``: package_id, claim, claim_field, profile_id, profile_version, profile_hash."""
    expected = {"profile_id": profile.profile_id, "profile_version": profile.version, "profile_hash": profile.source_hash}
    names = {"profile_id": "profileId", "profile_version": "profileVersion", "profile_hash": "profileHash"}
    checks = [F.when(F.col("package_id").isNull(), F.lit("packageId"))]
    checks.append(F.when(~F.col("claim_field").eqNullSafe(F.col("claim")), F.lit("claimId")))
    checks += [F.when(~F.col(c).eqNullSafe(v), F.lit(names[c])) for c, v in expected.items()]
    return requests.select(
        "package_id", "claim", F.lit("missing_or_invalid_package_field").alias("code"),
        F.explode(F.array_compact(F.array(*checks))).alias("witness"),
    )


def judged_facts(evidence: DataFrame, profile: Profile) -> DataFrame:
    """``package_id, block, codes, fields``: what is wrong with each supplied fact, and which fields a passed one lacks."""
    required = _fields_of_block(profile)[F.col("block")]
    return evidence.filter(F.col("block").isin(list(profile.blocks))).select(
        "package_id", "block",
        F.array_compact(F.array(
            F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("invalid_or_missing_status")),
            F.when(F.col("source").isNull() | F.col("rule").isNull() | F.col("rationale").isNull(), F.lit("missing_fact_metadata")),
        )).alias("codes"),
        F.when(F.col("status") == "passed", F.filter(required, lambda f: F.col("observations")[f].isNull()))
        .otherwise(F.array().cast("array<string>")).alias("fields"),
    )


def block_deficits(packages: DataFrame, evidence: DataFrame, profile: Profile) -> DataFrame:
    """Claim-independent fact deficits plus missing blocks, expanded to claims by literal lookup.

    Facts are judged once per (package, block); only then are they fanned out to
    the claims that require the block.
    """
    rows = judged_facts(evidence, profile).select(
        "package_id", "block",
        F.explode(F.concat(
            F.transform("codes", lambda c: F.struct(c.alias("code"), F.col("block").alias("witness"))),
            F.transform("fields", lambda f: F.struct(F.lit("missing_required_observation").alias("code"),
                                                     F.concat_ws(".", F.col("block"), f).alias("witness"))),
        )).alias("d"),
    ).select("package_id", "block", "d.code", "d.witness")
    users: dict[str, list[str]] = {}
    for claim, block, _ in profile.relations():
        users.setdefault(block, []).append(claim)
    claims_of = F.create_map(*[x for b, cs in users.items() for x in (F.lit(b), F.array(*map(F.lit, cs)))])
    found = rows.select("package_id", F.explode(claims_of[F.col("block")]).alias("claim"), "code", "witness")
    return found.unionByName(missing_blocks(packages, evidence, profile))


def missing_blocks(packages: DataFrame, evidence: DataFrame, profile: Profile) -> DataFrame:
    index = profile.block_index()
    bit = F.create_map(*[x for b, i in index.items() for x in (F.lit(b), F.lit(1 << i).cast("bigint"))])
    supplied = evidence.filter(F.col("block").isin(list(index))).groupBy("package_id").agg(F.bit_or(bit[F.col("block")]).alias("have"))
    wanted = F.array(*[
        F.struct(F.lit(c).alias("claim"), F.lit(b).alias("block"), F.lit(1 << index[b]).cast("bigint").alias("bit"))
        for c, b, _ in profile.relations()
    ])
    have = F.coalesce("have", F.lit(0).cast("bigint"))
    return (
        packages.select("package_id").join(supplied, "package_id", "left")
        .select("package_id", F.explode(F.filter(wanted, lambda w: have.bitwiseAND(w["bit"]) == 0)).alias("w"))
        .select("package_id", F.col("w.claim").alias("claim"), F.lit("missing_required_block").alias("code"), F.col("w.block").alias("witness"))
    )


def deficits(requests: DataFrame, packages: DataFrame, evidence: DataFrame, profile: Profile) -> DataFrame:
    return package_field_deficits(requests, profile).unionByName(block_deficits(packages, evidence, profile))


def package_masks(requests: DataFrame, packages: DataFrame, evidence: DataFrame, profile: Profile) -> DataFrame:
    """``package_id, s_claims, s_open``: claims with a package field that fails, and blocks that are missing or have a deficit, as bits.

    The deficits of a (package, claim) folded into one row a package before claims are expanded: a claim conforms if
    its bit and those of its blocks are clear."""
    claim_bit, block_bit = (F.create_map(*[x for k, i in index.items() for x in (F.lit(k), F.lit(1 << i).cast("bigint"))]) for index in (claim_index(profile), profile.block_index()))
    zero = F.lit(0).cast("bigint")
    bit = block_bit[F.col("block")]
    fields = package_field_deficits(requests, profile).groupBy("package_id").agg(F.bit_or(claim_bit[F.col("claim")]).alias("s_claims"))
    blocks = judged_facts(evidence, profile).groupBy("package_id").agg(
        F.bit_or(bit).alias("_have"), F.bit_or(F.when(F.size("codes") + F.size("fields") > 0, bit).otherwise(zero)).alias("_bad"))
    every = packages.select("package_id").distinct().join(blocks.hint("merge"), "package_id", "left").join(fields.hint("merge"), "package_id", "left")
    lacking = F.bitwise_not(F.coalesce("_have", zero)).bitwiseOR(F.coalesce("_bad", zero))
    return every.select("package_id", F.coalesce("s_claims", zero).alias("s_claims"), lacking.alias("s_open"))


def claim_index(profile: Profile) -> dict[str, int]:
    return {claim: i for i, claim in enumerate(profile.claims)}
