"""Claim specifications: one small driver-side file turned into nested and flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC = (
    "claim_id string, claim_type string, scope string, evidence_family string, severity string, permitted_wording string, "
    "blocked_wording array<string>, blocked_patterns array<string>, "
    "required_artifacts array<struct<path:string,expectations:array<struct<key:string,equals:string,not_equals:string,min:double,max:double>>>>"
)


def claim_specs(spark: SparkSession, claims: list[dict]) -> DataFrame:
    """Nested specification rows; absent family and severity take their defaults."""

    def text(v):
        return None if v is None else (str(v).lower() if isinstance(v, bool) else str(v))

    def number(v):
        return None if v is None else float(v)

    rows = [
        (
            c["claim_id"], c["claim_type"], c["scope"], c.get("evidence_family", c["claim_type"]), c.get("severity", "medium"), c["permitted_wording"],
            list(c.get("blocked_wording", [])), list(c.get("blocked_patterns", [])),
            [(a["path"], [(e["key"], text(e.get("equals")), text(e.get("not_equals")), number(e.get("min")), number(e.get("max"))) for e in a.get("expectations", [])])
             for a in c.get("required_artifacts", [])],
        )
        for c in claims
    ]
    return spark.createDataFrame(rows, SPEC)


#: Fields of a stored specification and what an absent one means.
STORED = SPEC + ", non_compensatory_requirements array<string>, uncertainty_policy string"


def read_claim_specs(spark: SparkSession, path: str) -> DataFrame:
    """Specifications from JSON lines, any number of them.

    An absent evidence family is the claim type, an absent severity ``medium``, an absent policy
    ``deterministic``, absent lists are empty. A line without id, type, scope or permitted
    wording raises, as a contract that names nothing can't be audited.
    """
    raw = spark.read.schema(STORED).json(path)
    must = ("claim_id", "claim_type", "scope", "permitted_wording")
    lacking = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in must])
    claim = F.when(lacking != "", F.raise_error(F.concat(F.lit("claim specification without "), lacking))).otherwise(F.col("claim_id"))
    types = {f.name: f.dataType for f in raw.schema.fields}
    default = {"evidence_family": F.col("claim_type"), "severity": F.lit("medium"), "uncertainty_policy": F.lit("deterministic")}
    empty = {n: F.array().cast(t) for n, t in types.items() if t.typeName() == "array"}
    return raw.select(*[claim.alias(n) if n == "claim_id" else F.coalesce(F.col(n), (default | empty)[n]).alias(n) if n in default | empty else F.col(n) for n in types])


def expectations(specs: DataFrame) -> DataFrame:
    """One row per expected value; artifacts without expectations keep one row with null tests."""
    a = specs.select("claim_id", F.explode("required_artifacts").alias("a"))
    return a.select("claim_id", F.col("a.path").alias("path"), F.explode_outer("a.expectations").alias("e")).select(
        "claim_id", "path", F.coalesce("e.key", F.lit("_")).alias("key"), "e.equals", "e.not_equals", "e.min", "e.max")
