"""What the gates move and broadcast: plans of queries over the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

from veriframe.operators import domain, scenarios
from veriframe.plans import bindings as B
from veriframe.plans import catalog

SMALL = "/root/testdata/sf0.001"
V2 = B.V2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a02_deficit_lists", "g12_evidence_comparators", "a01_claim_conjunction", "j01_requirement_facts", "g01_requested_claims", "x09_formal_properties", "x10_repair_fidelity"])
def test_packages_meet_masks_by_merging(spark, name):
    """No table of packages or facts is broadcast, and no join is on a block, for which every relation of the profile would be moved."""
    got = plan(catalog.QUERIES[name](spark, SMALL))
    assert "BroadcastHashJoin" not in got and "BroadcastNestedLoopJoin" not in got
    keys = re.findall(r"SortMergeJoin \[([^\]]*)\]", got)
    assert keys and all("block" not in k and k.startswith("package_id") for k in keys)


def test_repairs_name_all_deficits_and_all_but_one(spark):
    blocks = list(V2.block_index())[:3]
    bit = {b: 1 << V2.block_index()[b] for b in blocks}
    row = spark.range(1).select(scenarios.repairs(F.array(*map(F.lit, blocks)), V2).alias("r"), scenarios.repairs(F.array().cast("array<string>"), V2).alias("none")).first()
    every = sum(bit.values())
    assert [(x["left"], x["fixed"]) for x in row["r"]] == [(None, every)] + [(b, every - bit[b]) for b in blocks]
    assert [(x["left"], x["fixed"]) for x in row["none"]] == [(None, 0)]


def test_requested_claims_keep_their_rows(spark):
    """Requests without evidence, of undeclared claims, without a package and asked twice each have their row."""
    claim = next(iter(V2.claims))
    ev = spark.createDataFrame([(1, V2.claims[claim][0], "failed", "s", "r", "w", {"a": "b"})], "package_id long, block string, status string, source string, rule string, rationale string, observations map<string,string>")
    rq = spark.createDataFrame([(1, claim), (1, claim), (2, claim), (1, "none"), (None, claim)], "package_id long, claim string")
    got = sorted(((r["package_id"] or 0, r["claim"], r["status"], r["n_failed"]) for r in domain.infer_requested(rq, ev, V2).collect()), key=str)
    no, out = "profile_not_authorized", "outside_profile"
    assert got == sorted([(1, claim, no, 1), (1, claim, no, 1), (2, claim, no, 0), (1, "none", out, None), (0, claim, out, None)], key=str)


@pytest.mark.parametrize(("name", "keys"), [("s20_evidence_triples", ("subject", "object")), ("g09_two_semantics_agree", ("claim",))])
def test_rows_stay_with_their_package(spark, name, keys):
    """Triples and decisions of a package are never dealt anew after its facts were."""
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(catalog.QUERIES[name](spark, SMALL)))
    assert moved and not any(k in m for m in moved for k in keys)


def test_second_semantics_agrees_on_odd_evidence(spark):
    from veriframe.plans.q_authorization import second_semantics

    claim, blocks = next(iter(V2.claims.items()))
    rows = [(1, b, "passed", "s", "r", "w", dict.fromkeys(V2.blocks[b], "v")) for b in blocks] + [(2, blocks[0], "failed", "s", "r", "w", {"a": "b"}), (9, blocks[0], "passed", "s", "r", "w", {"a": "b"})]
    ev = spark.createDataFrame(rows, "package_id long, block string, status string, source string, rule string, rationale string, observations map<string,string>")
    packages = spark.createDataFrame([(1,), (2,), (3,)], "package_id long")
    first = {(r["package_id"], r["claim"]): (r["status"], len(r["deficits"])) for r in domain.infer_all(packages, ev, V2).collect()}
    second = {(r["package_id"], r["claim"]): (r["status"], r["n_deficits"]) for r in second_semantics(spark, packages, ev, V2).collect()}
    assert first == second and first[1, claim] == ("profile_authorized", 0) and first[3, claim] == ("profile_not_authorized", len(blocks))
