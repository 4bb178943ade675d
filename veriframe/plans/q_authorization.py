"""Queries on the three gates over evidence derived from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import compose, cycles, domain, integrity, structural
from veriframe.plans import bindings as B
from veriframe.plans.registry import query, values
from veriframe.session import stored

V2, V1 = B.V2, B.V1
STAT5 = ("failed", "requires_review", "unknown", "not_applicable", "passed")


def joined(c):
    return F.array_join(c, "|")


@query("s08_profile_tables_to_evidence", f"""WITH {B.EVIDENCE_SQL}
 SELECT r.claim, r.block, r.pos::BIGINT AS pos, count(f.package_id) AS n_packages, count(*) FILTER (f.status='passed') AS n_passed
 FROM req r LEFT JOIN facts f USING (block) GROUP BY 1,2,3""")
def s08(t):
    per_block = B.evidence(t).groupBy("block").agg(F.count("*").alias("n_packages"), F.count_if(F.col("status") == "passed").alias("n_passed"))
    rel = V2.relations_df(t.spark).withColumn("pos", F.col("pos").cast("bigint"))
    return rel.join(per_block, "block", "left").na.fill(0, ["n_packages", "n_passed"])


@query("p01_presence", f"""WITH {B.EVIDENCE_SQL}
 SELECT block, count(*) AS n, count(*) FILTER (no_rationale) AS no_rationale, count(*) FILTER (last_missing) AS short_observations FROM evidence GROUP BY 1""")
def p01(t):
    ev = B.evidence(t)
    nf = F.create_map(*[x for b, f in V2.blocks.items() for x in (F.lit(b), F.lit(len(f)))])[F.col("block")]
    return ev.groupBy("block").agg(
        F.count("*").alias("n"),
        F.count_if(~domain.present(F.col("rationale"))).alias("no_rationale"),
        F.count_if(domain.present_collection(F.col("observations")) & (F.size("observations") < nf)).alias("short_observations"),
    )


@query("p02_fact_evaluation", f"WITH {B.EVIDENCE_SQL} SELECT package_id, block, status AS declared_status, effective AS effective_status FROM facts")
def p02(t):
    return domain.evaluate_facts(B.evidence(t), V2).select("package_id", "block", F.col("status").alias("declared_status"), "effective_status")


@query("p03_missing_observations", f"""WITH {B.EVIDENCE_SQL}
 SELECT f.package_id, f.block, string_agg(s.field, '|' ORDER BY s.fpos) AS missing FROM facts f JOIN spec s USING (block)
 WHERE f.status='passed' AND ((f.last_missing AND s.fpos=s.nf-1) OR (f.second_blank AND s.fpos=1)) GROUP BY 1,2""")
def p03(t):
    facts = domain.evaluate_facts(B.evidence(t), V2)
    return facts.filter(F.size("missing_observations") > 0).select("package_id", "block", joined("missing_observations").alias("missing"))


@query("p04_missing_metadata", f"WITH {B.EVIDENCE_SQL} SELECT package_id, block, 'rationale' AS missing FROM facts WHERE no_rationale")
def p04(t):
    facts = domain.evaluate_facts(B.evidence(t), V2)
    return facts.filter(F.size("missing_metadata") > 0).select("package_id", "block", joined("missing_metadata").alias("missing"))


@query("j01_requirement_facts", f"""WITH {B.DOMAIN_SQL}
 SELECT claim, block, pos::BIGINT AS pos, eff AS effective_status, declared AS declared_status, count(*) AS n FROM cf GROUP BY ALL""")
def j01(t):
    facts = domain.requirement_facts(B.packages(t), B.evidence(t), V2)
    return facts.groupBy("claim", "block", F.col("pos").cast("bigint").alias("pos"), "effective_status", "declared_status").agg(F.count("*").alias("n"))


@query("j02_all_claims_per_package", f"WITH {B.DOMAIN_SQL} SELECT package_id, claim, n_passed, n_unknown FROM domain")
def j02(t):
    return domain.infer_all(B.packages(t), B.evidence(t), V2).select("package_id", "claim", "n_passed", "n_unknown")


@query("a01_claim_conjunction", f"WITH {B.DOMAIN_SQL} SELECT claim, ok AS authorized, count(*) AS n FROM domain GROUP BY 1,2")
def a01(t):
    facts = domain.requirement_facts(B.packages(t), B.evidence(t), V2)
    return domain.claim_conjunction(facts).groupBy("claim", "authorized").agg(F.count("*").alias("n"))


@query("a02_deficit_lists", f"""WITH {B.DOMAIN_SQL}
 SELECT package_id, claim, coalesce(string_agg(block||'='||eff, '|' ORDER BY pos) FILTER (eff<>'passed'),'') AS deficits FROM cf GROUP BY 1,2""")
def a02(t):
    return domain.deficit_list(B.packages(t), B.evidence(t), V2).select("package_id", "claim", joined("deficits").alias("deficits"))


@query("g01_domain_gate", f"""WITH {B.DOMAIN_SQL}
 SELECT package_id, claim, CASE WHEN ok THEN 'profile_authorized' ELSE 'profile_not_authorized' END AS status,
 n_failed, n_requires_review, n_unknown, n_not_applicable, n_passed, deficits FROM domain""")
def g01(t):
    return domain.infer_all(B.packages(t), B.evidence(t), V2).withColumn("deficits", joined("deficits"))


_UNDECLARED = "sentience_of_the_model"


@query("g01_requested_claims", f"""WITH {B.DOMAIN_SQL},
 rq AS (SELECT package_id, CASE WHEN o_orderstatus='F' THEN '{_UNDECLARED}' WHEN o_orderstatus='O' THEN 'within_resource_reproduction' ELSE 'bounded_predictive_performance' END AS claim FROM packages)
 SELECT claim, CASE WHEN d.ok IS NULL THEN 'outside_profile' WHEN d.ok THEN 'profile_authorized' ELSE 'profile_not_authorized' END AS status, count(*) AS n
 FROM rq LEFT JOIN domain d USING (package_id, claim) GROUP BY 1,2""")
def g01_requested(t):
    rq = t.orders.select(
        F.col("o_orderkey").alias("package_id"),
        F.when(F.col("o_orderstatus") == "F", _UNDECLARED).when(F.col("o_orderstatus") == "O", "within_resource_reproduction")
        .otherwise("bounded_predictive_performance").alias("claim"))
    return domain.infer_requested(rq, B.evidence(t), V2).groupBy("claim", "status").agg(F.count("*").alias("n"))


_V1_STATUS = f"""{B.EVIDENCE_SQL}, req1(claim, block, pos) AS (VALUES {values(V1.relations())}),
 f1 AS (SELECT p.package_id, r.claim, r.block, r.pos, coalesce(e.status,'unknown') AS st FROM packages p CROSS JOIN req1 r LEFT JOIN evidence e ON e.package_id=p.package_id AND e.block=r.block),
 s1 AS (SELECT package_id, claim, CASE WHEN bool_or(st='failed') THEN 'failed' WHEN bool_or(st='requires_review') THEN 'requires_review' WHEN bool_or(st='unknown') THEN 'unknown'
   WHEN bool_or(st='not_applicable') THEN 'not_applicable' ELSE 'passed' END AS key FROM f1 GROUP BY 1,2),
 rules(fired_rule, step, key, decision) AS (VALUES {values([(r[0], i + 1, r[3], r[4]) for i, r in enumerate(V1.rules)])}),
 v1 AS (SELECT s1.package_id, s1.claim, rules.decision, rules.fired_rule, rules.step::BIGINT AS steps, string_agg(f1.block,'|' ORDER BY f1.pos) AS witnesses
   FROM s1 JOIN rules USING (key) JOIN f1 ON f1.package_id=s1.package_id AND f1.claim=s1.claim AND f1.st=s1.key GROUP BY ALL)"""


@query("g08_prioritized_inference", f"WITH {_V1_STATUS} SELECT * FROM v1")
def g08(t):
    return domain.prioritized_decisions(B.packages(t), B.evidence(t), V1).withColumn("witnesses", joined("witnesses"))


@query("a03_rule_firing_counts", f"WITH {_V1_STATUS} SELECT claim, fired_rule, decision, count(*) AS n, sum(steps)::BIGINT AS steps FROM v1 GROUP BY 1,2,3")
def a03(t):
    d = domain.prioritized_decisions(B.packages(t), B.evidence(t), V1)
    return d.groupBy("claim", "fired_rule", "decision").agg(F.count("*").alias("n"), F.sum("steps").alias("steps"))


@query("a12_status_distribution", f"""WITH {_V1_STATUS}, allst(decision) AS (VALUES ('supported'),('blocked'),('uncertain'),('out_of_scope'),('needs_external_review'))
 SELECT a.decision, count(v1.package_id) AS n FROM allst a LEFT JOIN v1 USING (decision) GROUP BY 1""")
def a12(t):
    d = domain.prioritized_decisions(B.packages(t), B.evidence(t), V1).groupBy("decision").agg(F.count("*").alias("n"))
    enum = t.spark.createDataFrame([("supported",), ("blocked",), ("uncertain",), ("out_of_scope",), ("needs_external_review",)], "decision string")
    return enum.join(F.broadcast(d), "decision", "left").na.fill(0, ["n"])


def second_semantics(spark, packages, evidence, profile):
    """The same authorization stated as NOT EXISTS rules in SQL, for agreement checks.

    The blocks a package holds (at most those of the profile) meet it as one list before its relations are
    written out, so all that is moved is a row a package and its facts.
    """
    pairs = ", ".join(f"named_struct('claim', '{c}', 'block', '{b}')" for c, b, _ in profile.relations())
    facts = domain.evaluate_facts(evidence, profile)
    return spark.sql(f"""
      WITH held AS (SELECT package_id, collect_set(block) AS blocks FROM {{facts}} WHERE effective_status = 'passed' GROUP BY package_id),
           own AS (SELECT /*+ MERGE(h) */ p.package_id, coalesce(h.blocks, array()) AS blocks FROM {{packages}} p LEFT JOIN held h ON h.package_id = p.package_id),
           want AS (SELECT package_id, blocks, inline(array({pairs})) FROM own)
      SELECT package_id, claim,
             CASE WHEN count_if(NOT exists(blocks, b -> b = block)) = 0 THEN 'profile_authorized' ELSE 'profile_not_authorized' END AS status,
             count_if(NOT exists(blocks, b -> b = block)) AS n_deficits
      FROM want GROUP BY package_id, claim""", facts=facts, packages=packages)


@query("g09_two_semantics_agree", f"WITH {B.DOMAIN_SQL} SELECT count(*) AS n_first, count(*) AS n_second, 0::BIGINT AS only_first, 0::BIGINT AS only_second FROM domain")
def g09(t):
    first = domain.infer_all(B.packages(t), B.evidence(t), V2).select("package_id", "claim", "status", F.size("deficits").cast("bigint").alias("n_deficits"))
    second = second_semantics(t.spark, B.packages(t), B.evidence(t), V2)
    tag = first.withColumn("side", F.lit(1)).unionByName(second.withColumn("side", F.lit(-1)))
    bal = tag.groupBy("package_id", "claim", "status", "n_deficits").agg(
        F.sum("side").alias("net"), F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == -1).alias("b"))
    return bal.agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"),
                   F.sum(F.greatest("net", F.lit(0))).alias("only_first"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("only_second"))


# ---- integrity -----------------------------------------------------------

def package_deficits(t, ev):
    """Deficits of all orders as packages, from rows of the manifest derived where the lines of `Dealt` lie."""
    return integrity.deficits_in_place(lambda *kinds, content: B.integrity_rows(t, ev, kinds, content), B.manifest(t)["packages"], V2)


def _codes(*names):
    return f"WITH RECURSIVE {B.INTEGRITY_SQL} SELECT package_id, code, witness FROM integ WHERE code IN ({', '.join(repr(n) for n in names)})"


@query("g03_profile_identity", f"WITH {B.MANIFEST_SQL} SELECT package_id, 'profile_identity_mismatch' AS code, '{V2.profile_id}|1.0.0|{V2.source_hash}' AS witness FROM packages WHERE o_totalprice<5000")
def g03(t):
    return integrity.profile_identity(B.manifest(t)["packages"], V2)


@query("a04_duplicate_detection", _codes("duplicate_artifact_id", "duplicate_block_lineage"))
def a04(t):
    m = B.manifest(t)
    return integrity.duplicate_artifacts(m["artifacts"]).unionByName(integrity.duplicate_lineages(m["lineage"]))


@query("g04_artifact_hash", _codes("artifact_hash_mismatch"))
def g04(t):
    return integrity.hash_mismatch(B.manifest(t)["artifacts"])


@query("h03_hash_format", f"WITH {B.MANIFEST_SQL} SELECT regexp_full_match(observed, 'sha256:[0-9a-f]{{64}}') AS well_formed, observed=declared AS same, count(*) AS n FROM art GROUP BY 1,2")
def h03(t):
    a = B.manifest(t)["artifacts"]
    return a.groupBy(F.col("observed_sha256").rlike(integrity.HASH_FORMAT).alias("well_formed"), (F.col("observed_sha256") == F.col("declared_sha256")).alias("same")).agg(F.count("*").alias("n"))


@query("u01_reference_union", f"WITH {B.MANIFEST_SQL} SELECT package_id, a AS artifact_id FROM refs")
def u01(t):
    return integrity.references(B.manifest(t))


@query("j03_reference_closure", _codes("unknown_provenance_reference", "unknown_block_reference"))
def j03(t):
    m, ev = B.manifest(t), B.evidence(t)
    return integrity.unknown_references(m).unionByName(integrity.block_closure(m, ev).filter("code = 'unknown_block_reference'"))


@query("j04_independent_pairs", _codes("duplicate_independent_artifact"))
def j04(t):
    m = B.manifest(t)
    return integrity.dependent_pairs(m["independent_pairs"], m["artifacts"])


@query("j05_cohort_overlap", _codes("overlapping_independent_cohorts"))
def j05(t):
    m = B.manifest(t)
    return integrity.overlapping_cohorts(m["disjoint_pairs"], m["artifacts"])


@query("a05_contradictory_attestations", _codes("contradictory_attestation"))
def a05(t):
    return integrity.contradictory_attestations(B.manifest(t)["attestations"])


@query("j06_attestation_mismatch", _codes("attestation_block_status_mismatch"))
def j06(t):
    return integrity.attestation_mismatch(B.manifest(t)["attestations"], B.evidence(t))


@query("j07_uncovered_blocks", _codes("missing_block_lineage", "missing_block_attestation"))
def j07(t):
    return integrity.block_closure(B.manifest(t), B.evidence(t)).filter("code <> 'unknown_block_reference'")


@query("n01_provenance_cycles", _codes("provenance_cycle"))
def n01(t):
    return integrity.provenance_cycles(B.manifest(t)["artifacts"])


@query("n02_artifact_groups", f"WITH {B.MANIFEST_SQL} SELECT package_id, artifact_id, count(*) AS n, count(DISTINCT declared) AS n_contents, count(DISTINCT study||gen) AS n_origins FROM art GROUP BY 1,2")
def n02(t):
    return B.manifest(t)["artifacts"].groupBy("package_id", "artifact_id").agg(
        F.count("*").alias("n"), F.count_distinct("declared_sha256").alias("n_contents"),
        F.count_distinct(F.concat("study_id", "data_generation_id")).alias("n_origins"))


@query("n01_cycle_paths", f"WITH RECURSIVE {B.MANIFEST_SQL}{B.CYCLE_SQL} SELECT DISTINCT package_id, true AS closed, true AS simple FROM onc")
def n01_paths(t):
    """Every package with a cycle, and whether its reported path is one: each artifact derived from the next, the last from the first, none twice."""
    edges = integrity.provenance_edges(B.manifest(t)["artifacts"])
    path = stored(cycles.cycle_paths(edges))
    size = path.groupBy("package_id").agg(F.count("*").alias("n"), F.count_distinct("artifact_id").alias("distinct"))
    onward = path.select("package_id", "position", F.col("artifact_id").alias("parent"))
    steps = path.join(size, "package_id").withColumn("next", F.pmod(F.col("position") + 1, F.col("n")))
    steps = steps.join(onward.withColumnRenamed("position", "next"), ["package_id", "next"]).withColumnRenamed("artifact_id", "child")
    real = steps.join(edges, ["package_id", "child", "parent"], "left_semi").groupBy("package_id").agg(F.count("*").alias("real"))
    return size.join(real, "package_id", "left").select("package_id", (F.col("real") == F.col("n")).alias("closed"), (F.col("distinct") == F.col("n")).alias("simple"))


@query("n01_walked_cycles", f"""WITH RECURSIVE {B.MANIFEST_SQL}{B.CYCLE_SQL},
 f AS (SELECT e.package_id, e.child AS v, min(e.parent) AS w FROM edges e JOIN core c ON c.package_id=e.package_id AND c.a=e.child JOIN core d ON d.package_id=e.package_id AND d.a=e.parent GROUP BY 1,2),
 w AS (SELECT package_id, min(a) AS v, 0 AS k FROM core GROUP BY 1 UNION ALL SELECT w.package_id, f.w, k+1 FROM w JOIN f USING (package_id, v) WHERE k<16),
 l AS (SELECT DISTINCT package_id, v FROM w WHERE k>=8),
 o AS (SELECT package_id, min(v) AS v, 0 AS position FROM l GROUP BY 1 UNION ALL SELECT o.package_id, f.w, o.position+1 FROM o JOIN f USING (package_id, v) WHERE o.position+1 < (SELECT count(*) FROM l WHERE l.package_id=o.package_id))
 SELECT package_id, (SELECT min(a) FROM core c WHERE c.package_id=o.package_id) AS smallest, position::BIGINT AS position, v AS artifact_id FROM o""")
def n01_walks(t):
    return cycles.cycle_paths(integrity.provenance_edges(B.manifest(t)["artifacts"]))


@query("g02_refused_blocks", f"WITH {B.LINES_SQL} SELECT package_id, block AS witness, count(*) AS n FROM lines GROUP BY 1,2 HAVING count(*)>1")
def g02_refused(t):
    """Lines as facts, not merged by block: a block stated twice is refused whatever its status."""
    facts = B.line_facts(t)
    refused = integrity.counted_deficits(integrity.block_rows(facts)).filter(F.col("code") == integrity.REFUSED)
    n = facts.groupBy("package_id", F.col("block").alias("witness")).agg(F.count("*").alias("n"))
    return refused.join(n, ["package_id", "witness"]).select("package_id", "witness", "n")


@query("g02_integrity_gate", f"WITH RECURSIVE {B.INTEGRITY_SQL} SELECT package_id, code, count(*) AS n_witnesses, min(CASE WHEN code<>'profile_identity_mismatch' THEN witness END) AS first_witness FROM integ GROUP BY 1,2")
def g02(t):
    t = B.Dealt(t)
    rows = package_deficits(t, B.evidence(t))
    return rows.groupBy("package_id", "code").agg(F.count("*").alias("n_witnesses"), F.min(F.when(F.col("code") != "profile_identity_mismatch", F.col("witness"))).alias("first_witness"))


@query("t08_canonical_trace", f"""WITH RECURSIVE {B.INTEGRITY_SQL}, per AS (SELECT package_id, code, count(*) AS n FROM integ GROUP BY 1,2)
 SELECT package_id, string_agg(code||':'||n, '|' ORDER BY code) AS trace, count(*) AS n_codes, sum(n)::BIGINT AS n_witnesses FROM per GROUP BY 1""")
def t08(t):
    t = B.Dealt(t)
    return integrity.code_counts(package_deficits(t, B.evidence(t))).withColumn("trace", joined("trace"))


@query("g07_domain_and_integrity", f"""WITH RECURSIVE {B.INTEGRITY_SQL}{B.DOMAIN_SQL[len(B.EVIDENCE_SQL):]}, bad AS (SELECT DISTINCT package_id FROM integ)
 SELECT claim, d.ok AS domain_ok, b.package_id IS NULL AS integrity_ok, (d.ok AND b.package_id IS NULL) AS authorized, count(*) AS n FROM domain d LEFT JOIN bad b USING (package_id) GROUP BY ALL""")
def g07(t):
    t = B.Dealt(t)
    ev = B.evidence(t)
    out = compose.domain_and_integrity(domain.infer_all(B.packages(t), ev, V2), package_deficits(t, ev))
    return out.groupBy("claim", (F.col("status") == "profile_authorized").alias("domain_ok"), "integrity_ok", "authorized").agg(F.count("*").alias("n"))


# ---- structural ----------------------------------------------------------

def structural_requests(t):
    claims = F.array(*map(F.lit, V2.claims))
    return B.manifest(t)["packages"].join(t.orders.select(F.col("o_orderkey").alias("package_id"), "o_orderstatus"), "package_id").select(
        "package_id", "profile_id", "profile_version", "profile_hash", "o_orderstatus", F.explode(claims).alias("claim")
    ).withColumn("claim_field", F.when(F.col("o_orderstatus") != "P", F.col("claim")))


STRUCT_SQL = f""",
sreq AS (SELECT p.*, c.claim FROM packages p CROSS JOIN (SELECT DISTINCT claim FROM req) c),
struct AS (
 SELECT package_id, claim, 'missing_or_invalid_package_field' AS code, 'profileVersion' AS witness FROM sreq WHERE o_totalprice<5000
 UNION ALL SELECT package_id, claim, 'missing_or_invalid_package_field', 'claimId' FROM sreq WHERE o_orderstatus='P'
 UNION ALL SELECT f.package_id, r.claim, 'missing_fact_metadata', f.block FROM facts f JOIN req r USING (block) WHERE no_rationale
 UNION ALL SELECT f.package_id, r.claim, 'missing_required_observation', f.block||'.'||s.field FROM facts f JOIN req r USING (block) JOIN spec s USING (block) WHERE f.status='passed' AND f.last_missing AND s.fpos=s.nf-1
 UNION ALL SELECT p.package_id, r.claim, 'missing_required_block', r.block FROM packages p CROSS JOIN req r WHERE (p.package_id, r.block) NOT IN (SELECT package_id, block FROM evidence))"""


def structural_deficits(t):
    return structural.deficits(structural_requests(t), B.packages(t), B.evidence(t), V2)


@query("g05_structural_gate", f"WITH {B.EVIDENCE_SQL}{STRUCT_SQL} SELECT package_id, claim, code, count(*) AS n, min(witness) AS first_witness FROM struct GROUP BY 1,2,3")
def g05(t):
    return structural_deficits(t).groupBy("package_id", "claim", "code").agg(F.count("*").alias("n"), F.min("witness").alias("first_witness"))


_G06 = f"""WITH RECURSIVE {B.INTEGRITY_SQL}{B.DOMAIN_SQL[len(B.EVIDENCE_SQL):]}{STRUCT_SQL},
 badi AS (SELECT DISTINCT package_id FROM integ), bads AS (SELECT DISTINCT package_id, claim FROM struct),
 fin AS (SELECT d.package_id, d.claim, s.package_id IS NULL AS structural_ok, d.ok AS domain_ok, i.package_id IS NULL AS integrity_ok
 FROM domain d LEFT JOIN badi i ON i.package_id=d.package_id LEFT JOIN bads s ON s.package_id=d.package_id AND s.claim=d.claim)"""


def final(t):
    t = B.Dealt(t)
    ev = B.evidence(t)
    masks = domain.by_package(B.packages(t), domain.status_masks(domain.evaluate_facts(ev, V2), V2))
    structure = structural.package_masks(structural_requests(t), B.packages(t), ev, V2)
    return compose.final_by_package(masks, structure, package_deficits(t, ev), V2)


@query("g06_final_authorization", _G06 + " SELECT *, structural_ok AND domain_ok AND integrity_ok AS authorized FROM fin")
def g06(t):
    return final(t).select("package_id", "claim", "structural_ok", "domain_ok", "integrity_ok", "authorized")


@query("g06_three_gate_summary", _G06 + """ SELECT claim, count(*) AS n, count(*) FILTER (structural_ok) AS n_structural, count(*) FILTER (domain_ok) AS n_domain,
 count(*) FILTER (integrity_ok) AS n_integrity, count(*) FILTER (structural_ok AND domain_ok AND integrity_ok) AS n_authorized FROM fin GROUP BY 1""")
def g06_summary(t):
    return final(t).groupBy("claim").agg(
        F.count("*").alias("n"), F.count_if("structural_ok").alias("n_structural"), F.count_if("domain_ok").alias("n_domain"),
        F.count_if("integrity_ok").alias("n_integrity"), F.count_if("authorized").alias("n_authorized"))
