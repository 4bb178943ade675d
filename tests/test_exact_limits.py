"""Queries whose limits and halves fall on exact values, on small tables written for it."""

from pyspark.sql import functions as F

from veriframe.plans import catalog


def tables(tmp_path, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_strong_perturbations_on_the_limit(spark, tmp_path):
    """Nine discounts of 0.1 in thirty lines are a mean of 0.03, though nine doubles add up to less than 0.9."""
    lines = spark.range(30).select(F.lit(1).cast("long").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.when(F.col("id") < 9, 0.1).otherwise(0.0).alias("l_discount"))
    part = spark.createDataFrame([(1, "hot bolt")], "p_partkey long, p_name string")
    got = catalog.QUERIES["p14_strong_perturbations"](spark, tables(tmp_path, lineitem=lines.coalesce(1), part=part)).collect()
    assert [(r["p_partkey"], r["gene"]) for r in got] == [(1, "bolt")]


def test_best_model_rounds_halves_exactly(spark, tmp_path):
    """A mean of 0.03125 is 0.0313 in whatever order its lines are added."""
    cents = [1, 3, 1, 7, 4, 4, 2, 2, 4, 2, 5, 5, 2, 3, 4, 1]  # as doubles, in this order, they add up to less than 0.5
    assert sum(cents) * 1000 == 3125 * len(cents)
    for k, own in enumerate((cents, sorted(cents))):
        lines = spark.createDataFrame([(1, "N", c / 100) for c in own], "l_suppkey long, l_returnflag string, l_discount double").coalesce(1)
        got = catalog.QUERIES["w21_best_model"](spark, tables(tmp_path / str(k), lineitem=lines)).collect()
        assert [tuple(r) for r in got] == [(1, "N", 0.0313)]
