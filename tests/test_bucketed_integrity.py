"""The rows of a manifest are moved only where a pair or a contradiction asks for them."""

from pyspark.sql import functions as F

from veriframe.operators import integrity
from veriframe.session import bucketed


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_counts_by_package_move_nothing(spark):
    rows = bucketed(spark.range(200).select(*integrity.row("artifact", package_id=F.col("id") % 40, key=F.concat(F.lit("n"), F.col("id")), flag=F.lit(False))), "package_id")
    assert exchanges(integrity.counted_deficits(rows)) == 0
    assert integrity.counted_deficits(rows).count() == 0 and rows.count() == 200


def test_only_packages_with_several_statuses_are_compared(spark):
    attested = spark.createDataFrame([(1, "b", "passed", "n1"), (1, "c", "passed", "n1"), (2, "b", "passed", "n2"), (3, "b", "failed", "n3")], "package_id long, key string, status string, other string")
    block = spark.createDataFrame([(1, "b", "passed"), (1, "c", "failed"), (2, "b", "passed"), (3, "d", "passed")], "package_id long, key string, status string")
    rows = attested.select(*integrity.row("attested", **{c: F.col(c) for c in attested.columns})).unionByName(block.select(*integrity.row("block", **{c: F.col(c) for c in block.columns})))
    got = [tuple(r) for r in integrity.stated_mismatch(bucketed(rows, "package_id")).collect()]
    assert got == [(1, "attestation_block_status_mismatch", "c:failed!=passed@n1")]
