"""Attacked manifests whose rows are derived where the bucketed cases lie."""

import re

from pyspark.sql import functions as F

from veriframe.operators import integrity, scenarios
from veriframe.plans import bindings as B
from veriframe.session import bucketed

V2 = B.V2


def test_attacked_rows_in_place_equal_written_ones(spark):
    """Nothing is moved to count, to compare statuses or to name pairs, and all deficits are those of written rows."""
    masks = scenarios.attack_sets(None)[::7]
    cases = spark.createDataFrame([(10 * i + j, c, m) for i, m in enumerate(masks) for j, c in enumerate(V2.claims) if (i + j) % 4 == 0], "package_id long, claim string, attacks int")
    lying = bucketed(cases, "package_id")
    rows_of = lambda *kinds, content: integrity.manifest_rows(scenarios.attacked_manifest(lying, V2), scenarios.complete_evidence(lying, V2), kinds)
    moved = lambda df: re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    assert moved(integrity.counted_deficits(rows_of(content=False))) == []
    assert not [k for k in moved(integrity.pair_deficits(rows_of)) if "kind" in k]
    ev = scenarios.complete_evidence(lying, V2)
    place = integrity.deficits(scenarios.attacked_manifest(lying, V2), ev, V2, in_place=True)
    rows = lambda df: sorted(tuple(r) for r in df.select("package_id", "code", "witness").collect())
    got = rows(place)
    assert got == rows(integrity.deficits(scenarios.attacked_manifest(cases, V2), scenarios.complete_evidence(cases, V2), V2))
    observed = scenarios.observed_codes(lying, place).withColumn("want", scenarios.expected_codes(F.col("attacks")))
    assert observed.where("observed <> want").isEmpty() and observed.count() == cases.count()
