"""Criteria, conjunctive blocks and their sensitivity to threshold multipliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passed(value: Column, threshold: Column, direction: Column) -> Column:
    return (
        F.when(direction == "gt", value > threshold).when(direction == "gte", value >= threshold)
        .when(direction == "lt", value < threshold).otherwise(value <= threshold)
    )


def normalized(value: Column, threshold: Column, direction: Column) -> Column:
    """Descriptive score in 0..1; never turns a failed criterion into a pass."""
    ok = F.when(passed(value, threshold, direction), 1.0).otherwise(0.0)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return (
        F.when(threshold == 0, ok)
        .when(direction.isin("gt", "gte"), clip(F.try_divide(value, threshold)))
        .when(value <= 0, ok)
        .otherwise(clip(F.try_divide(threshold, value)))
    )


def score_criteria(criteria: DataFrame) -> DataFrame:
    args = (F.col("value"), F.col("threshold"), F.col("direction"))
    return criteria.withColumn("passed", passed(*args)).withColumn("score", normalized(*args))


def block_scores(criteria: DataFrame) -> DataFrame:
    return score_criteria(criteria).groupBy("case_id", "block").agg(F.bool_and("passed").alias("passed"), F.avg("score").alias("score"))


def case_scores(criteria: DataFrame) -> DataFrame:
    """All blocks must pass; the score is the mean of block scores."""
    return block_scores(criteria).groupBy("case_id").agg(
        F.bool_and("passed").alias("passed"), F.avg("score").alias("score"), F.count("*").alias("n_blocks"))


def multiplier_sensitivity(criteria: DataFrame, multipliers: tuple[float, ...]) -> DataFrame:
    """Case pass flag under scaled thresholds.

    The per-criterion verdicts for all multipliers travel as one array through one
    aggregate, so adding multipliers adds no rows to the shuffle.
    """
    flags = [passed(F.col("value"), F.col("threshold") * m, F.col("direction")) for m in multipliers]
    per = criteria.groupBy("case_id").agg(*[F.bool_and(f).alias(f"p{i}") for i, f in enumerate(flags)])
    rows = F.array(*[F.struct(F.lit(m).alias("multiplier"), F.col(f"p{i}").alias("passed")) for i, m in enumerate(multipliers)])
    return per.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.*")
