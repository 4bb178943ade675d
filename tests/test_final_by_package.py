"""The three gates from one row a package, and integrity from rows that are never written."""

import re

import pytest
from pyspark.sql import functions as F

from veriframe.operators import compose, domain, integrity, structural
from veriframe.plans import bindings as B
from veriframe.plans import catalog
from veriframe.plans.q_authorization import final, structural_deficits
from veriframe.plans.registry import Tables

SMALL = "/root/testdata/sf0.001"
V2 = B.V2


def moved(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["g06_final_authorization", "g06_three_gate_summary"])
def test_gates_move_no_claims_or_contents(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    keys = moved(df)
    assert keys and not any(k.startswith("package_id") and "claim" in k for k in keys)
    both = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert both and "l_declared_sha256" not in df._jdf.queryExecution().analyzed().toString()


def test_rows_of_bucketed_lines_are_not_moved(spark):
    t = B.Dealt(Tables(spark, SMALL))
    rows = B.integrity_rows(t, B.evidence(t), (), False)
    assert moved(integrity.counted_deficits(rows)) == [] and rows.where("declared_sha256 IS NOT NULL").isEmpty()
    for kinds in (("lineage", "block"), ("block",)):
        some = B.integrity_rows(t, B.evidence(t), kinds)
        assert {r["kind"] for r in some.select("kind").distinct().collect()} == set(kinds)


def test_final_by_package_equals_deficit_rows(spark):
    t = Tables(spark, SMALL)
    ev = B.evidence(t)
    odd = integrity.deficits_of(B.integrity_rows(t, ev), B.manifest(t)["packages"], V2)
    want = compose.final_authorization(domain.infer_all(B.packages(t), ev, V2), structural_deficits(t), odd)
    columns = ["package_id", "claim", "structural_ok", "domain_ok", "integrity_ok", "authorized"]
    rows = sorted(tuple(r) for r in want.select(columns).collect())
    assert sorted(tuple(r) for r in final(t).select(columns).collect()) == rows
    assert {r[2] for r in rows} == {True, False} or {r[4] for r in rows} == {True, False}


def test_package_masks_fold_every_structural_deficit(spark):
    claim, blocks = max(V2.claims.items(), key=lambda x: len(x[1]))
    whole = lambda p, b, status="passed", rationale="w", drop=0: (p, b, status, "s", "r", rationale, {f: "v" for f in V2.blocks[b][drop:]})
    rows = [whole(p, b) for p in (1, 2, 3, 4, 5, 6) for b in blocks[1:]]
    rows += [whole(1, blocks[0]), whole(2, blocks[0], status="odd"), whole(3, blocks[0], rationale=None), whole(4, blocks[0], drop=1), whole(6, blocks[0])]
    ev = spark.createDataFrame(rows, "package_id long, block string, status string, source string, rule string, rationale string, observations map<string,string>")
    packages = spark.createDataFrame([(p,) for p in range(1, 8)], "package_id long")
    requests = packages.select("package_id", F.lit(claim).alias("claim"), F.when(F.col("package_id") != 6, claim).alias("claim_field"), *[F.lit(v).alias(c) for c, v in (("profile_id", V2.profile_id), ("profile_version", V2.version), ("profile_hash", V2.source_hash))])
    want = {r["package_id"] for r in structural.deficits(requests, packages, ev, V2).where(F.col("claim") == claim).collect()}
    need, bit = sum(1 << V2.block_index()[b] for b in blocks), 1 << structural.claim_index(V2)[claim]
    got = {r["package_id"] for r in structural.package_masks(requests, packages, ev, V2).collect() if r["s_open"] & need or r["s_claims"] & bit}
    assert got == want == {2, 3, 4, 5, 6, 7}
