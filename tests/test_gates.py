"""Set-based gates against plain per-package loops, and the expected catalog sizes."""

import itertools
import random

from pyspark.sql import functions as F

from veriframe.operators import compose, domain, gates, integrity, scenarios, structural
from veriframe.sources.profiles import STATUSES, profile_from_mapping, profile_from_requirements, profile_v1, profile_v2

V2 = profile_v2()
EVIDENCE = "package_id bigint, block string, status string, source string, rule string, rationale string, observations map<string,string>"


def loop_decision(blocks, claim):
    deficits = []
    for b in V2.claims[claim]:
        row = blocks.get(b)
        if row is None:
            deficits.append((b, "unknown"))
            continue
        status, source, obs = row
        if status == "passed" and (not source.strip() or any(not (obs.get(f) or "").strip() for f in V2.blocks[b])):
            status = "requires_review"
        if status != "passed":
            deficits.append((b, status))
    return deficits


def random_packages(n, seed):
    rng = random.Random(seed)
    out = {}
    for p in range(n):
        blocks = {}
        for b, fields in V2.blocks.items():
            if rng.random() < 0.15:
                continue
            status = rng.choice(STATUSES + ("passed",) * 6)
            obs = {f: ("x" if rng.random() > 0.02 else " ") for f in fields}
            blocks[b] = (status, "src" if rng.random() > 0.05 else " ", obs)
        out[p] = blocks
    return out


def test_domain_gate_equals_loop(spark):
    packs = random_packages(60, 1)
    rows = [(p, b, s, src, "r", "w", obs) for p, bs in packs.items() for b, (s, src, obs) in bs.items()]
    ev = spark.createDataFrame(rows, EVIDENCE)
    pk = spark.createDataFrame([(p,) for p in packs], "package_id bigint")
    got = {(r["package_id"], r["claim"]): r for r in domain.infer_all(pk, ev, V2).collect()}
    rel = {(r["package_id"], r["claim"]): r["authorized"] for r in domain.claim_conjunction(domain.requirement_facts(pk, ev, V2)).collect()}
    for p, bs in packs.items():
        for claim in V2.claims:
            want = loop_decision(bs, claim)
            r = got[p, claim]
            assert list(r["deficits"]) == [b for b, _ in want]
            assert (r["status"] == "profile_authorized") == (not want) == rel[p, claim]
            assert r["n_unknown"] == sum(s == "unknown" for _, s in want)


def test_irrelevant_block_changes_nothing_and_undeclared_claim_is_outside(spark):
    ev = spark.createDataFrame([(1, "reproducible_compute", "passed", "s", "r", "w", {f: "x" for f in V2.blocks["reproducible_compute"]}), (1, "unprofiled", "failed", "s", "r", "w", {})], EVIDENCE)
    rq = spark.createDataFrame([(1, "clean_computational_reproduction"), (1, "sentience")], "package_id bigint, claim string")
    got = {r["claim"]: r["status"] for r in domain.infer_requested(rq, ev, V2).collect()}
    assert got == {"clean_computational_reproduction": "profile_authorized", "sentience": "outside_profile"}


def test_mutation_catalog_sizes(spark):
    c = {r["family"]: r["count"] for r in scenarios.mutation_catalog(spark, V2).groupBy("family").count().collect()}
    assert sum(c.values()) == 5677 and c["pristine_complete"] == 10
    assert len(scenarios.attack_sets(2)) * 10 == 370 and len(scenarios.attack_sets(None)) * 10 == 2560
    assert len(scenarios.profile_variants(V2)) == 220
    assert len(list(itertools.product(*gates.THRESHOLD_GRID.values()))) == 243
    assert len(gates.VARIANTS) * 12 == 144


def test_all_attacks_leave_exact_traces_and_three_gates_compose(spark):
    masks = scenarios.attack_sets(2)
    rows = [(i * 10 + j, c, m) for i, m in enumerate(masks) for j, c in enumerate(V2.claims)]
    cases = spark.createDataFrame(rows, "package_id bigint, claim string, attacks int")
    ev = scenarios.complete_evidence(cases, V2)
    m = scenarios.attacked_manifest(cases, V2)
    rows_i = integrity.deficits(m, ev, V2)
    obs = scenarios.observed_codes(cases, rows_i).withColumn("want", scenarios.expected_codes(F.col("attacks")))
    assert obs.filter("observed <> want").count() == 0 and obs.count() == 370
    dom = domain.decide_from_masks(cases.join(domain.status_masks(domain.evaluate_facts(ev, V2), V2), "package_id").drop("attacks"), V2, "claim")
    req = m["packages"].join(cases.select("package_id", "claim"), "package_id").withColumn("claim_field", F.col("claim"))
    st = structural.deficits(req, cases, ev, V2).join(cases.select("package_id", "claim"), ["package_id", "claim"], "left_semi")
    fin = compose.final_authorization(dom, st, rows_i)
    assert fin.filter("authorized").count() == 10
    assert fin.filter("not domain_ok").count() == 0


def test_prioritized_rules_equal_loop(spark):
    v1 = profile_v1()
    packs = random_packages(40, 2)
    rows = [(p, b, s, "s", "r", "w", {}) for p, bs in packs.items() for b, (s, _, _) in bs.items()]
    pk = spark.createDataFrame([(p,) for p in packs], "package_id bigint")
    got = {(r["package_id"], r["claim"]): r for r in domain.prioritized_decisions(pk, spark.createDataFrame(rows, EVIDENCE), v1).collect()}
    for p, bs in packs.items():
        for claim, req in v1.claims.items():
            st = [bs[b][0] if b in bs else "unknown" for b in req]
            for rule, _, q, status, conclusion in v1.rules:
                hit = [b for b, s in zip(req, st, strict=True) if s == status]
                if hit and (q == "any" or len(hit) == len(req)):
                    assert (got[p, claim]["decision"], list(got[p, claim]["witnesses"])) == (conclusion, hit)
                    break


def test_causal_scenarios(spark):
    """Known-truth controls: the gate equals the truth, shortcuts over-claim."""
    cols = "name string, predictive_score double, reproducibility_score double, topology_effect double, topology_specific boolean, directed_fraction double, causal_evidence boolean, whole_brain_coverage boolean, independent_validation boolean, truth int"
    b = gates.bits
    rows = [
        ("chain", 0.86, 0.90, 0.10, True, 0.90, True, False, False, b("predictive", "reproducible", "topology_specific", "directed", "mechanistic", "causal")),
        ("fork", 0.88, 0.89, 0.0, False, 0.0, False, False, False, b("predictive", "reproducible")),
        ("collider", 0.74, 0.86, 0.08, True, 0.0, False, False, False, b("predictive", "reproducible", "topology_specific")),
        ("twin", 0.92, 0.94, 0.12, True, 0.90, True, True, True, b("predictive", "reproducible", "topology_specific", "directed", "mechanistic", "causal", "digital_twin")),
    ]
    d = spark.createDataFrame(rows, cols).withColumn("structure_function_effect", F.lit(0.0)).withColumn("matched_structure_function_effect", F.lit(0.0))
    d = d.withColumn("structure_function_fdr_passed", F.lit(False)).withColumn("reproducible_compute", F.lit(True))
    r = {x["evaluator"]: x for x in gates.confusion_rollup(gates.confusion(gates.evaluate(d, keep=("truth",)))).collect()}
    assert r["claim_gate"]["fp"] == r["claim_gate"]["fn"] == 0
    assert r["correlation_only"]["false_positive_rate"] > 0


def test_profile_validation():
    import pytest

    with pytest.raises(ValueError):
        profile_from_mapping({"profile_id": "x", "version": 1, "claims": [{"id": "a", "required_blocks": ["zz"]}], "evidence_blocks": []})
    p = profile_from_requirements({"a": ("x", "y")})
    assert p.relations() == [("a", "x", 0), ("a", "y", 1)] and len(p.rules) == 5


def test_failed_duplicate_does_not_authorize(spark):
    from veriframe.operators import domain
    from veriframe.plans.bindings import V2

    claim, blocks = next(iter(V2.claims.items()))
    schema = "package_id long, block string, effective_status string"
    rows = [(1, b, "passed") for b in blocks] + [(1, blocks[0], "failed")] + [(2, b, "passed") for b in blocks] + [(2, blocks[0], "passed")]
    masks = domain.status_masks(spark.createDataFrame(rows, schema), V2)
    got = {r["package_id"]: r for r in domain.decide_from_masks(masks, V2).where(f"claim = '{claim}'").collect()}
    assert got[1]["status"] == "profile_not_authorized" and got[1]["n_failed"] == 1 and blocks[0] in got[1]["deficits"]
    assert got[2]["status"] == "profile_authorized" and got[2]["deficits"] == []


def test_every_status_vector_is_decided_and_a_broken_rule_is_found(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from veriframe.operators import domain
    from veriframe.sources.profiles import profile_from_requirements

    profile = profile_from_requirements({"small": ("a",), "large": ("a", "b", "c")})
    rows = [("p", "a", "passed"), ("p", "b", "failed"), ("p", "c", "passed"), ("q", "a", "passed"), ("q", "b", "passed"), ("q", "c", "passed"), ("r", "b", "passed")]
    evidence = spark.createDataFrame(rows, "package_id string, block string, status string")

    def unsafe(of):
        return of.where((F.col("decision") == "supported") & ~F.col("all_passed")).count()

    vectors = domain.status_vectors(evidence, profile)
    assert {r["claim"]: r["n"] for r in vectors.groupBy("claim").agg(F.count("*").alias("n")).collect()} == {"small": 5, "large": 125}
    assert {(r["claim"], r["vector"], r["decision"], r["packages"]) for r in vectors.where("packages > 0").collect()} == {
        ("small", 4, "supported", 2), ("small", 2, "uncertain", 1), ("large", 4 + 0 + 100, "blocked", 1), ("large", 4 + 20 + 100, "supported", 1), ("large", 2 + 20 + 50, "uncertain", 1)}
    assert unsafe(vectors) == 0 and vectors.where("decision = 'supported'").count() == 2
    broken = replace(profile, rules=tuple((*r[:2], "any", *r[3:]) if r[4] == "supported" else r for r in profile.rules if r[3] != "failed"))
    assert unsafe(domain.status_vectors(evidence, broken)) > 0
