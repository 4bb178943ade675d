"""Cycles with paths, and the integrity gate in one pass, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators import cycles, integrity
from veriframe.plans import bindings as B
from veriframe.plans.registry import Tables
from veriframe.sources.profiles import profile_v2

V2 = profile_v2()
EDGES = "package_id bigint, child string, parent string"


def random_edges(packages, nodes, p, seed):
    rng = random.Random(seed)
    out = set()
    for k in range(packages):
        names = [f"n{rng.randint(0, 99)}" for _ in range(rng.randint(1, nodes))]
        out |= {(k, a, b) for a in names for b in names if rng.random() < p / len(names)}
    return sorted(out)


def brute_walks(edges):
    """Trim by rounds, then walk along smallest parents."""
    out = []
    for package in {e[0] for e in edges}:
        left = {(c, p) for k, c, p in edges if k == package}
        while True:
            kept = {(c, p) for c, p in left if any(c2 == p for c2, _ in left) and any(p2 == c for _, p2 in left)}
            if kept == left:
                break
            left = kept
        if not left:
            continue
        step = {c: min(p for c2, p in left if c2 == c) for c, _ in left}
        node = min(step)
        for _ in range(len(step)):
            node = step[node]
        cycle = [node]
        while step[cycle[-1]] != node:
            cycle.append(step[cycle[-1]])
        at = cycle.index(min(cycle))
        out += [(package, min(step), k, v) for k, v in enumerate(cycle[at:] + cycle[:at])]
    return sorted(out)


def rows_of(table):
    return sorted((r["package_id"], r["smallest"], r["position"], r["artifact_id"]) for r in table.collect())


@pytest.mark.parametrize("local", [10**6, 0, 4])
def test_cycle_paths_equal_loops(spark, monkeypatch, local):
    monkeypatch.setattr(cycles, "LOCAL_EDGES", local)
    edges = random_edges(25, 9, 1.6, 3)
    want = brute_walks(edges)
    assert len({w[0] for w in want}) > 5
    assert rows_of(cycles.cycle_paths(spark.createDataFrame(edges, EDGES))) == want
    assert cycles.cycle_paths(spark.createDataFrame([], EDGES)).collect() == []


def test_chain_of_5000_takes_logarithmic_rounds(spark, monkeypatch):
    monkeypatch.setattr(cycles, "LOCAL_EDGES", 0)
    names = [f"a{k}" for k in range(5000)]
    random.Random(1).shuffle(names)
    chain = [(1, names[k], names[k + 1]) for k in range(4999)]
    rounds = []
    real = cycles.doubled
    monkeypatch.setattr(cycles, "doubled", lambda p: (rounds.append(len((out := real(p))[1])), out)[1])
    assert cycles.cycle_paths(spark.createDataFrame(chain, EDGES)).collect() == []
    assert max(rounds) <= 15 and len(rounds) <= 2
    rounds.clear()
    ring = spark.createDataFrame([*chain, (1, names[-1], names[0])], EDGES)
    got = sorted((r["position"], r["artifact_id"]) for r in cycles.cycle_paths(ring).collect())
    at = names.index(min(names))
    assert [v for _, v in got] == names[at:] + names[:at] and [k for k, _ in got] == list(range(5000))
    assert max(rounds) <= 15
    monkeypatch.setattr(cycles, "LOCAL_EDGES", 10**6)
    assert sorted((r["position"], r["artifact_id"]) for r in cycles.cycle_paths(ring).collect()) == got


def test_one_pass_equals_the_single_checks(spark):
    """Every code from the one table equals the operator that computes it alone."""
    t = Tables(spark, "/root/testdata/sf0.001")
    m, ev = B.manifest(t), B.evidence(t)
    parts = [
        integrity.profile_identity(m["packages"], V2), integrity.duplicate_artifacts(m["artifacts"]), integrity.duplicate_lineages(m["lineage"]),
        integrity.hash_mismatch(m["artifacts"]), integrity.unknown_references(m), integrity.block_closure(m, ev), integrity.provenance_cycles(m["artifacts"]),
        integrity.dependent_pairs(m["independent_pairs"], m["artifacts"]), integrity.overlapping_cohorts(m["disjoint_pairs"], m["artifacts"]),
        integrity.contradictory_attestations(m["attestations"]), integrity.attestation_mismatch(m["attestations"], ev)]
    want = sorted(tuple(r) for part in parts for r in part.select("package_id", "code", "witness").collect())
    assert {w[1] for w in want} >= {"provenance_cycle", "overlapping_independent_cohorts", "unknown_block_reference", "missing_block_lineage"}
    for rows in (integrity.manifest_rows(m, ev), B.integrity_rows(t, ev)):
        assert sorted(tuple(r) for r in integrity.deficits_of(rows, m["packages"], V2).select("package_id", "code", "witness").collect()) == want


def test_blocks_supplied_twice_are_refused(spark):
    ev = spark.createDataFrame([(1, "b", "passed"), (1, "b", "passed"), (1, "c", "passed"), (2, "b", "failed")], "package_id bigint, block string, status string")
    empty = {
        "packages": spark.createDataFrame([], "package_id bigint, profile_id string, profile_version string, profile_hash string"),
        "artifacts": spark.createDataFrame([], "package_id bigint, artifact_id string, declared_sha256 string, observed_sha256 string, derived_from array<string>, cohorts array<string>, study_id string, data_generation_id string"),
        "lineage": spark.createDataFrame([], "package_id bigint, block string, artifact_ids array<string>"),
        "attestations": spark.createDataFrame([], "package_id bigint, block string, status string, artifact_id string"),
        "independent_pairs": spark.createDataFrame([], "package_id bigint, left_id string, right_id string"),
        "disjoint_pairs": spark.createDataFrame([], "package_id bigint, left_id string, right_id string"),
    }
    got = integrity.deficits(empty, ev, V2)
    assert [tuple(r) for r in got.where(F.col("code") == integrity.REFUSED).collect()] == [(1, integrity.REFUSED, "b")]


def test_integrity_reads_the_lines_twice_at_most(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    from veriframe.session import stored

    ev = stored(B.evidence(t))
    plan = integrity.deficits_of(B.integrity_rows(t, ev), B.manifest(t)["packages"], V2)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan  # one written table is read; it and the evidence took a scan each
