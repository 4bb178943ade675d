"""Claim contracts and release gates over JSON artifacts held as a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_value(payload: Column, key: Column, kind: str) -> Column:
    """Value at a dotted key of a JSON text; null when the path or the type does not fit."""
    path = F.concat(F.lit("$."), key)
    return F.try_variant_get(F.try_parse_json(payload), path, kind)


def expectation_passes(text: Column, number: Column, equals: Column, not_equals: Column, low: Column, high: Column) -> Column:
    return (
        F.when(equals.isNotNull(), text.eqNullSafe(equals))
        .when(low.isNotNull() & ~F.coalesce(number >= low, F.lit(False)), False)
        .when(high.isNotNull() & ~F.coalesce(number <= high, F.lit(False)), False)
        .when(not_equals.isNotNull(), ~text.eqNullSafe(not_equals))
        .otherwise(True)
    )


def audit_contracts(expectations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``expectations``: claim_id, path, key, equals, not_equals, min, max; ``artifacts``: path, payload."""
    joined = expectations.join(artifacts.withColumn("found", F.lit(True)), "path", "left")
    ok = expectation_passes(
        json_value(F.col("payload"), F.col("key"), "string"), json_value(F.col("payload"), F.col("key"), "double"),
        F.col("equals"), F.col("not_equals"), F.col("min"), F.col("max"))
    missing = F.col("found").isNull()
    return joined.groupBy("claim_id").agg(
        F.count_distinct(F.when(missing, F.col("path"))).alias("n_missing"),
        F.count_if(~missing & ~ok).alias("n_failed"),
    ).withColumn("status", F.when((F.col("n_missing") == 0) & (F.col("n_failed") == 0), "supported").otherwise("blocked"))


def release_gates(conditions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Conjunction of JSON conditions per gate; a missing artifact counts as an empty object."""
    joined = conditions.join(artifacts, "path", "left").withColumn("payload", F.coalesce("payload", F.lit("{}")))
    ok = expectation_passes(
        json_value(F.col("payload"), F.col("key"), "string"), json_value(F.col("payload"), F.col("key"), "double"),
        F.col("equals"), F.col("not_equals"), F.col("min"), F.col("max"))
    return joined.groupBy("gate").agg(F.bool_and(ok).alias("open"), F.count_if(~ok).alias("n_unmet"), F.count("*").alias("n_conditions"))
