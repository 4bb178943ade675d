"""Queries on thresholds, certificates, selective decisions and review panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import hashing as H
from veriframe.functions import numeric as N
from veriframe.functions.tails import bound_column
from veriframe.operators import risk, selection
from veriframe.plans import bindings as B
from veriframe.plans.registry import query, values

CLAIMS4 = ("bounded_predictive_performance", "within_resource_reproduction", "assumption_conditional_direction", "intervention_supported_effect")
r9 = lambda c: F.round(c, 9)


def risk_cases(t):
    """Orders as cases, customers as independent units; scores and labels are hash-derived."""
    x = t.orders.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("unit_id"), F.concat_ws("/", "o_custkey", "o_orderpriority").alias("subgroup_id"),
        F.col("o_orderstatus").alias("stratum"), F.col("o_orderpriority").alias("regime"), F.explode(F.array(*map(F.lit, CLAIMS4))).alias("claim"))
    key = lambda tag: F.concat_ws(":", F.lit(tag), F.col("case_id").cast("string"), F.col("claim"))
    x = x.withColumn("score", F.round(H.hash_unit(key("score")), 3)).withColumn("a", H.hash_unit(key("admit")))
    miss = (1.0 - F.col("score")) * (1.0 - F.col("score"))
    x = x.withColumn("label", H.hash_unit(key("truth")) >= miss).withColumn("admissible", F.col("a") < 0.7)
    return x.withColumn("veto_state", F.when(F.col("a") < 0.7, "passed").when(F.col("a") < 0.85, "failed").otherwise("unresolved")).drop("a")


def _u(tag):
    return B.hash_unit_sql(f"'{tag}:'||case_id||':'||claim")


RC = f"""rc0 AS (SELECT o_orderkey AS case_id, o_custkey AS unit_id, o_custkey||'/'||o_orderpriority AS subgroup_id, o_orderstatus AS stratum, o_orderpriority AS regime, claim FROM orders CROSS JOIN (VALUES {values([(c,) for c in CLAIMS4])}) c(claim)),
 rc1 AS (SELECT *, round({_u('score')},3) AS score, {_u('admit')} AS a, {_u('truth')} AS u FROM rc0),
 rc AS (SELECT *, u >= (1.0-score)*(1.0-score) AS label, a<0.7 AS admissible, CASE WHEN a<0.7 THEN 'passed' WHEN a<0.85 THEN 'failed' ELSE 'unresolved' END AS veto_state FROM rc1)"""
_D = RC + ", d AS (SELECT *, admissible AND score>=0.9 AS decision FROM rc)"
_LEVEL = "count(*) AS units, count(*) FILTER (failed) AS failing_units, count(*) FILTER (authorized) AS authorized_units, count(*) FILTER (eligible) AS eligible_positive_units, count(*) FILTER (eligible AND hit) AS recovered_positive_units"
_UF = "bool_or(decision AND NOT label) AS failed, bool_or(decision) AS authorized, bool_or(label AND admissible) AS eligible, bool_or(decision AND label) AS hit"
_COUNTS = ["units", "failing_units", "authorized_units", "eligible_positive_units", "recovered_positive_units"]


@query("a19_unit_collapse", f"WITH {_D}, u AS (SELECT unit_id, {_UF} FROM d GROUP BY 1) SELECT {_LEVEL} FROM u")
def a19(t):
    return risk.level_summary(risk.decide(risk_cases(t), 0.9), ["unit_id"]).select(*_COUNTS)


@query("a20_level_summaries", f"WITH {_D}, u AS (SELECT stratum, subgroup_id, {_UF} FROM d GROUP BY 1,2) SELECT stratum, {_LEVEL} FROM u GROUP BY 1")
def a20(t):
    return risk.level_summary(risk.decide(risk_cases(t), 0.9), ["subgroup_id"], ["stratum"]).select("stratum", *_COUNTS)


@query("a21_false_authorization", f"WITH {_D} SELECT count(*) AS rows, count(*) FILTER (decision) AS authorizations, count(*) FILTER (decision AND NOT label) AS false_authorizations, round(avg(decision::INT),9) AS coverage, round(count(*) FILTER (decision AND NOT label)/count(*) FILTER (decision)::DOUBLE,9) AS risk FROM d")
def a21(t):
    m = risk.false_authorization_metrics(risk.decide(risk_cases(t), 0.9))
    return m.withColumn("coverage", r9("coverage")).withColumn("risk", r9("risk"))


@query("a22_per_claim_metrics", f"WITH {_D} SELECT claim, count(*) AS rows, count(*) FILTER (decision) AS authorizations, count(*) FILTER (decision AND NOT label) AS false_authorizations, round(avg(decision::INT),9) AS coverage, round(count(*) FILTER (decision AND NOT label)/count(*) FILTER (decision)::DOUBLE,9) AS risk FROM d GROUP BY 1")
def a22(t):
    m = risk.false_authorization_metrics(risk.decide(risk_cases(t), 0.9), ["claim"])
    return m.withColumn("coverage", r9("coverage")).withColumn("risk", r9("risk"))


_SEL = RC + ", s AS (SELECT *, CASE WHEN score>=0.8 THEN CASE veto_state WHEN 'passed' THEN 1 WHEN 'failed' THEN -1 ELSE 0 END WHEN score<=1.0::DOUBLE-0.8::DOUBLE THEN -1 ELSE 0 END AS choice FROM rc)"
_SELM = "count(*) AS total, count(*) FILTER (choice<>0) AS decisions, count(*) FILTER (choice=1) AS supports, count(*) FILTER (choice=-1) AS blocks, count(*) FILTER ((choice=1 AND NOT label) OR (choice=-1 AND label)) AS errors, count(*) FILTER (choice=1 AND NOT label) AS false_authorizations"


@query("l02_selective_decisions", f"WITH {_SEL} SELECT case_id, claim, choice::INT AS choice FROM s")
def l02(t):
    return risk.selective(risk_cases(t), F.lit(0.8)).select("case_id", "claim", "choice")


@query("l02_veto_violations", f"WITH {RC}, s AS (SELECT *, CASE WHEN score>=0.8 THEN 1 WHEN score<=1.0::DOUBLE-0.8::DOUBLE THEN -1 ELSE 0 END AS choice FROM rc) SELECT claim, count(*) FILTER (choice=1 AND veto_state<>'passed') AS violations FROM s GROUP BY 1")
def l02b(t):
    s = risk.selective(risk_cases(t), F.lit(0.8), veto=False)
    return s.groupBy("claim").agg(F.count_if((F.col("choice") == 1) & (F.col("veto_state") != "passed")).alias("violations"))


@query("a23_selective_metrics", f"WITH {_SEL}, m AS (SELECT claim, {_SELM} FROM s GROUP BY 1) SELECT *, total-decisions AS abstentions, round(decisions/total::DOUBLE,9) AS coverage, round(errors/decisions::DOUBLE,9) AS selective_error, round(false_authorizations/supports::DOUBLE,9) AS false_fraction FROM m")
def a23(t):
    m = risk.selective_metrics(risk.selective(risk_cases(t), F.lit(0.8)), ["claim"])
    for c in ("coverage", "selective_error", "false_fraction"):
        m = m.withColumn(c, r9(c))
    return m


@query("a24_pair_metrics", f"WITH {_D} SELECT stratum, count(*) FILTER (label) AS positives, count(*) FILTER (decision AND label) AS recovered, round(coalesce(count(*) FILTER (decision AND label)/nullif(count(*) FILTER (label),0)::DOUBLE,0),9) AS recovery, count(*) FILTER (decision AND NOT admissible) AS violations FROM d GROUP BY 1")
def a24(t):
    d = risk.decide(risk_cases(t), 0.9)
    c, y = F.col("decision"), F.col("label")
    m = d.groupBy("stratum").agg(F.count_if(y).alias("positives"), F.count_if(c & y).alias("recovered"), F.count_if(c & ~F.col("admissible")).alias("violations"))
    return m.withColumn("recovery", r9(risk.ratio(F.col("recovered"), F.col("positives"))))


@query("a25_repeat_variability", f"WITH {_D}, p AS (SELECT regime, stratum, count(*) FILTER (decision AND NOT label)/count(*) FILTER (decision)::DOUBLE AS risk FROM d GROUP BY 1,2) SELECT regime, round(avg(risk),9) AS mean, round(stddev_pop(risk),9) AS std, round(min(risk),9) AS lo, round(max(risk),9) AS hi, round(avg((risk<=0.005)::INT),9) AS at_target FROM p GROUP BY 1")
def a25(t):
    p = risk.false_authorization_metrics(risk.decide(risk_cases(t), 0.9), ["regime", "stratum"])
    x = F.col("risk")
    return p.groupBy("regime").agg(r9(F.avg(x)).alias("mean"), r9(F.stddev_pop(x)).alias("std"), r9(F.min(x)).alias("lo"), r9(F.max(x)).alias("hi"), r9(F.avg((x <= 0.005).cast("int"))).alias("at_target"))


@query("a26_calibration_error", f"WITH {RC}, b AS (SELECT claim, least(floor(round(score*10,9)),9) AS bin, count(*) AS n, sum(score) AS p, sum(label::INT) AS y FROM rc GROUP BY 1,2) SELECT claim, round(sum(abs(p-y))/sum(n),9) AS ece FROM b GROUP BY 1")
def a26(t):
    return risk.calibration_error(risk_cases(t), ["claim"]).withColumn("ece", r9("ece"))


@query("a37_bundle_states", f"WITH {_D} SELECT unit_id, bool_or(decision AND NOT label) AS failed, bool_or(decision) AS authorized FROM d GROUP BY 1")
def a37(t):
    return risk.unit_flags(risk.decide(risk_cases(t), 0.9), ["unit_id"]).select("unit_id", "failed", "authorized")


@query("a39_scenario_calibration", f"WITH {RC} SELECT regime AS scenario, count(*) AS n, round(avg(admissible::INT),9) AS pass_rate, count(*) FILTER (admissible AND label) AS true_pass, count(*) FILTER (admissible AND NOT label) AS false_pass, count(*) FILTER (NOT admissible AND label) AS missed, count(*) FILTER (NOT admissible AND NOT label) AS true_block FROM rc GROUP BY 1")
def a39(t):
    g, y = F.col("admissible"), F.col("label")
    return risk_cases(t).groupBy(F.col("regime").alias("scenario")).agg(
        F.count("*").alias("n"), r9(F.avg(g.cast("int"))).alias("pass_rate"), F.count_if(g & y).alias("true_pass"), F.count_if(g & ~y).alias("false_pass"),
        F.count_if(~g & y).alias("missed"), F.count_if(~g & ~y).alias("true_block"))


_POL = ("always", "admissible_only", "score_090", "gated_090")
_POLSQL = "CASE policy WHEN 'always' THEN true WHEN 'admissible_only' THEN admissible WHEN 'score_090' THEN score>=0.9 ELSE admissible AND score>=0.9 END"


def policies(cases):
    """Comparator policies as literal alternatives of one scan."""
    s = F.col("score") >= 0.9
    alt = F.array(*[F.struct(F.lit(n).alias("policy"), e.alias("decision")) for n, e in zip(_POL, (F.lit(True), F.col("admissible"), s, F.col("admissible") & s), strict=True)])
    return cases.withColumn("p", F.explode(alt)).select("*", "p.policy", "p.decision").drop("p")


_PSQL = f"WITH {RC}, p AS (SELECT rc.*, policy, {_POLSQL} AS decision FROM rc CROSS JOIN (VALUES {values([(p,) for p in _POL])}) x(policy))"


@query("l07_comparator_policies", f"{_PSQL}, u AS (SELECT policy, unit_id, {_UF} FROM p GROUP BY 1,2) SELECT policy, {_LEVEL} FROM u GROUP BY 1")
def l07(t):
    return risk.level_summary(policies(risk_cases(t)), ["unit_id"], ["policy"]).select("policy", *_COUNTS)


@query("a40_policy_benchmark", f"{_PSQL} SELECT policy, regime, count(*) AS n, count(*) FILTER (decision AND label) AS tp, count(*) FILTER (decision AND NOT label) AS fp, count(*) FILTER (NOT decision AND label) AS fn, count(*) FILTER (NOT decision AND NOT label) AS tn, round(coalesce(count(*) FILTER (decision AND NOT label)/nullif(count(*) FILTER (NOT label),0)::DOUBLE,0),9) AS false_positive_rate FROM p GROUP BY GROUPING SETS ((policy),(policy,regime))")
def a40(t):
    d, y = F.col("decision"), F.col("label")
    p = policies(risk_cases(t)).groupingSets([["policy"], ["policy", "regime"]], "policy", "regime").agg(
        F.count("*").alias("n"), F.count_if(d & y).alias("tp"), F.count_if(d & ~y).alias("fp"), F.count_if(~d & y).alias("fn"), F.count_if(~d & ~y).alias("tn"))
    return p.withColumn("false_positive_rate", r9(risk.ratio(F.col("fp"), F.col("fp") + F.col("tn"))))


@query("a41_outcome_audit", f"WITH {_SEL}, m AS (SELECT claim, {_SELM}, round(avg(pow(score-label::INT,2)),9) AS brier FROM s GROUP BY 1), b AS (SELECT claim, least(floor(round(score*10,9)),9) AS bin, count(*) AS n, sum(score) AS p, sum(label::INT) AS y FROM rc GROUP BY 1,2), e AS (SELECT claim, round(sum(abs(p-y))/sum(n),9) AS ece FROM b GROUP BY 1) SELECT claim, decisions, errors, brier, ece FROM m JOIN e USING (claim)")
def a41(t):
    c = risk_cases(t)
    m = risk.selective_metrics(risk.selective(c, F.lit(0.8)), ["claim"]).select("claim", "decisions", "errors")
    b = c.groupBy("claim").agg(r9(F.avg(F.pow(F.col("score") - F.col("label").cast("int"), 2))).alias("brier"))
    return m.join(b, "claim").join(risk.calibration_error(c, ["claim"]).withColumn("ece", r9("ece")), "claim")


_CURVE = """cand AS (SELECT 0.0::DOUBLE AS threshold UNION SELECT 1.0000000000000002::DOUBLE UNION SELECT score FROM {src}),
 top AS (SELECT unit_id, max(score) FILTER (admissible) AS a, max(score) FILTER (admissible AND NOT label) AS b, max(score) FILTER (admissible AND label) AS g FROM {src} GROUP BY 1)"""


@query("l04_threshold_curve", f"WITH {RC}, {_CURVE.format(src='rc')}, z AS (SELECT threshold, count(*) AS units, count(g) AS eligible, count(*) FILTER (b>=threshold) AS failing, count(*) FILTER (a>=threshold) AS authorized, count(*) FILTER (g>=threshold) AS recovered FROM cand CROSS JOIN top GROUP BY 1), y AS (SELECT threshold, count(*) FILTER (score>=threshold AND admissible) AS authorizations, count(*) FILTER (score>=threshold AND admissible AND NOT label) AS false_authorizations FROM cand CROSS JOIN (SELECT score, admissible, label FROM rc) q GROUP BY 1) SELECT z.*, authorizations, false_authorizations FROM z JOIN y USING (threshold)")
def l04(t):
    return risk.threshold_curve(risk_cases(t))


# Risk target, minimum coverage, minimum recovery used with the certificates.
LIMITS = (0.05, 0.10, 0.10)


@query("l04_certificate")
def l04b(t):
    return risk.select_certificate(risk.certify(risk.threshold_curve(risk_cases(t)), *LIMITS))


@query("t07_certificate_per_claim")
def t07(t):
    return risk.select_certificate(risk.certify(risk.threshold_curve(risk_cases(t), ["claim"]), *LIMITS), ["claim"])


@query("l08_family_discovery", None)
def l08(t):
    best = risk.select_certificate(risk.certify(risk.threshold_curve(risk_cases(t), ["claim"]), *LIMITS), ["claim"])
    return best.filter(F.col("threshold").isNotNull()).select("claim", "threshold", "authorized")


@query("l05_hierarchy_check", f"WITH {RC} SELECT (SELECT count(*) FROM (SELECT subgroup_id FROM rc GROUP BY 1 HAVING count(DISTINCT unit_id)>1)) AS bad_nested, (SELECT count(*) FROM (SELECT regime FROM rc GROUP BY 1 HAVING count(DISTINCT unit_id)>1)) AS bad_crossed")
def l05(t):
    c = risk_cases(t)
    good = risk.hierarchy_violations(c).agg(F.count("*").alias("bad_nested"), F.lit(1).alias("_one"))
    bad = risk.hierarchy_violations(c.withColumn("subgroup_id", F.col("regime"))).agg(F.count("*").alias("bad_crossed"), F.lit(1).alias("_one"))
    return good.join(bad, "_one").drop("_one")


@query("l05_hierarchical_certificate")
def l05b(t):
    """Certificate on units plus the minimum number of units and the descriptive subgroup level."""
    c = risk_cases(t)
    best = risk.select_certificate(risk.certify(risk.threshold_curve(c), *LIMITS)).withColumn("enough_units", F.col("units") >= 30)
    one = F.broadcast(best.select("threshold", F.lit(1).alias("_one")))
    low = risk.level_summary(risk.decide(c.withColumn("_one", F.lit(1)).join(one, "_one"), F.col("threshold")), ["subgroup_id"])
    low = low.select(F.col("units").alias("subgroups"), F.col("failing_units").alias("failing_subgroups"), F.lit(1).alias("_one"))
    return best.withColumn("_one", F.lit(1)).join(low, "_one").drop("_one")


@query("l09_leave_one_stratum_out", f"WITH {_D}, u AS (SELECT excluded, unit_id, {_UF} FROM d JOIN (VALUES ('F'),('O'),('P')) e(excluded) ON stratum<>excluded GROUP BY 1,2) SELECT excluded, {_LEVEL} FROM u GROUP BY 1")
def l09(t):
    d = risk.decide(risk_cases(t), 0.9)
    left = d.withColumn("excluded", F.explode(F.filter(F.array(*map(F.lit, ("F", "O", "P"))), lambda s: s != F.col("stratum"))))
    return risk.level_summary(left, ["unit_id"], ["excluded"]).select("excluded", *_COUNTS)


@query("l10_role_manifest", f"WITH {RC} SELECT CASE WHEN case_id%5 IN (0,1,2) THEN 'model_fit' WHEN case_id%5=3 THEN 'threshold_calibration' ELSE 'locked_development_audit' END AS role, count(DISTINCT unit_id) AS units, count(DISTINCT subgroup_id) AS subgroups, string_agg(DISTINCT stratum, '|' ORDER BY stratum) AS strata FROM rc GROUP BY 1")
def l10(t):
    c = risk_cases(t).withColumn("role", N.split_role(F.col("case_id")))
    return c.groupBy("role").agg(F.count_distinct("unit_id").alias("units"), F.count_distinct("subgroup_id").alias("subgroups"), F.array_join(F.array_sort(F.collect_set("stratum")), "|").alias("strata"))


GRID = [round(0.5 + 0.02 * i, 2) for i in range(25)]


@query("l06_claim_thresholds")
def l06(t):
    th = risk.claim_thresholds(risk_cases(t), GRID, 0.05, 0.95, len(CLAIMS4))
    return th.groupBy("claim").agg(F.min(F.when(F.col("valid"), F.col("threshold"))).alias("threshold"), F.count_if("valid").alias("valid_thresholds"))


@query("l06_grid_counts", f"WITH {RC}, g(threshold) AS (VALUES {values([(v,) for v in GRID])}) SELECT claim, threshold, count(*) AS authorizations, count(*) FILTER (NOT label) AS false_authorizations FROM rc JOIN g ON score>=threshold WHERE admissible GROUP BY 1,2")
def l06b(t):
    return risk.claim_thresholds(risk_cases(t), GRID, 0.05, 0.95, len(CLAIMS4)).select("claim", "threshold", "authorizations", "false_authorizations")


FROZEN = {CLAIMS4[0]: 0.8, CLAIMS4[1]: 0.9, CLAIMS4[2]: None, CLAIMS4[3]: 0.95}


def frozen_threshold():
    return F.create_map(*[x for c, v in FROZEN.items() for x in (F.lit(c), F.lit(v).cast("double"))])[F.col("claim")]


@query("l03_frozen_thresholds", f"WITH {RC}, f(claim, thr) AS (VALUES {values([(c, v) for c, v in FROZEN.items()])}) SELECT case_id, claim, coalesce(admissible AND score>=thr, false)::INT AS decision FROM rc JOIN f USING (claim)")
def l03(t):
    d = F.coalesce(F.col("admissible") & (F.col("score") >= frozen_threshold()), F.lit(False))
    return risk_cases(t).select("case_id", "claim", d.cast("int").alias("decision"))


@query("l11_partition_evaluation", f"WITH {RC}, f(claim, thr) AS (VALUES {values([(c, v) for c, v in FROZEN.items()])}), d AS (SELECT rc.*, coalesce(admissible AND score>=thr, false) AS decision, CASE WHEN {B.hash_mod_sql('unit_id::VARCHAR', 5)} IN (0,1,2) THEN 'calibration_context' ELSE 'locked_test' END AS part FROM rc JOIN f USING (claim)) SELECT part, claim, count(*) AS rows, count(*) FILTER (decision) AS authorizations, count(*) FILTER (decision AND NOT label) AS false_authorizations FROM d GROUP BY 1,2")
def l11(t):
    part = F.when(H.hash_mod(F.col("unit_id").cast("string"), 5).isin(0, 1, 2), "calibration_context").otherwise("locked_test")
    d = risk_cases(t).withColumn("decision", F.coalesce(F.col("admissible") & (F.col("score") >= frozen_threshold()), F.lit(False))).withColumn("part", part)
    return risk.false_authorization_metrics(d, ["part", "claim"]).drop("coverage", "risk")


@query("l12_subsample_recalibration")
def l12(t):
    """Thresholds recalibrated on hash subsamples of units, then their spread per size."""
    c = risk_cases(t)
    s = selection.subsamples(c.select("unit_id").distinct(), F.col("unit_id"), [(300, 0), (300, 1), (300, 2), (900, 0), (900, 1), (900, 2)], "units").select("size", "repeat", "unit_id")
    x = c.join(s, "unit_id").withColumn("claim", F.concat_ws("#", "claim", "size", "repeat"))
    th = risk.claim_thresholds(x, GRID, 0.05, 0.95, len(CLAIMS4)).groupBy("claim").agg(F.min(F.when(F.col("valid"), F.col("threshold"))).alias("threshold"))
    p = F.split("claim", "#")
    th = th.select(p[0].alias("claim"), p[1].cast("int").alias("size"), "threshold")
    return th.groupBy("claim", "size").agg(F.count("threshold").alias("certified"), F.avg("threshold").alias("mean"), F.stddev_pop("threshold").alias("std"), F.min("threshold").alias("lo"), F.max("threshold").alias("hi"))


@query("l13_shift_sweep", f"WITH {RC}, s AS (SELECT level, unit_id, bool_or(admissible AND score-0.05*level>=0.85) AS authorized, bool_or(admissible AND score-0.05*level>=0.85 AND NOT label) AS failed FROM rc CROSS JOIN range(4) r(level) GROUP BY 1,2) SELECT b.level AS level, count(*) AS units, count(*) FILTER (b.authorized) AS authorized, count(*) FILTER (a.authorized AND NOT b.authorized) AS lost, count(*) FILTER (NOT a.failed AND b.failed) AS newly_failing FROM s b JOIN s a ON a.unit_id=b.unit_id AND a.level=b.level-1 GROUP BY 1")
def l13(t):
    """Severity levels lower the score; each level is compared with the one before on the same units."""
    x = risk_cases(t).withColumn("level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    d = x.withColumn("decision", F.col("admissible") & (F.round(F.col("score") - 0.05 * F.col("level"), 9) >= 0.85))
    u = risk.unit_flags(d, ["unit_id", "level"])
    a = u.select("unit_id", (F.col("level") + 1).alias("level"), F.col("authorized").alias("a0"), F.col("failed").alias("f0"))
    j = u.join(a, ["unit_id", "level"])
    return j.groupBy("level").agg(F.count("*").alias("units"), F.count_if("authorized").alias("authorized"), F.count_if(F.col("a0") & ~F.col("authorized")).alias("lost"), F.count_if(~F.col("f0") & F.col("failed")).alias("newly_failing"))


@query("j17_matched_transition", f"WITH {_D}, a AS (SELECT unit_id, bool_or(decision) AS x FROM d WHERE stratum='F' GROUP BY 1), b AS (SELECT unit_id, bool_or(decision) AS x FROM d WHERE stratum='O' GROUP BY 1) SELECT count(*) FILTER (a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL) AS shared, count(*) FILTER (b.unit_id IS NULL) AS left_only, count(*) FILTER (a.unit_id IS NULL) AS right_only, count(*) FILTER (a.x AND b.x) AS stay_on, count(*) FILTER (a.x AND NOT b.x) AS lost, count(*) FILTER (NOT a.x AND b.x) AS gained, count(*) FILTER (NOT a.x AND NOT b.x) AS stay_off FROM a FULL JOIN b ON a.unit_id=b.unit_id")
def j17(t):
    d = risk.decide(risk_cases(t), 0.9)
    a = d.filter("stratum = 'F'").groupBy("unit_id").agg(F.bool_or("decision").alias("x"))
    b = d.filter("stratum = 'O'").groupBy("unit_id").agg(F.bool_or("decision").alias("y"))
    j = a.join(b, "unit_id", "full")
    x, y = F.col("x"), F.col("y")
    return j.agg(F.count_if(x.isNotNull() & y.isNotNull()).alias("shared"), F.count_if(y.isNull()).alias("left_only"), F.count_if(x.isNull()).alias("right_only"),
                 F.count_if(x & y).alias("stay_on"), F.count_if(x & ~y).alias("lost"), F.count_if(~x & y).alias("gained"), F.count_if(~x & ~y).alias("stay_off"))


@query("j18_paired_transition", f"WITH {_D}, a AS (SELECT unit_id, bool_or(decision AND NOT label) AS f, bool_or(decision) AS x FROM d WHERE regime='1-URGENT' GROUP BY 1), b AS (SELECT unit_id, bool_or(decision AND NOT label) AS f, bool_or(decision) AS x FROM d WHERE regime='5-LOW' GROUP BY 1) SELECT count(*) AS bundles, count(*) FILTER (NOT a.f AND b.f) AS new_failures, count(*) FILTER (a.x AND NOT b.x) AS lost_coverage FROM a JOIN b USING (unit_id)")
def j18(t):
    d = risk.decide(risk_cases(t), 0.9)
    a = risk.unit_flags(d.filter("regime = '1-URGENT'"), ["unit_id"]).select("unit_id", F.col("failed").alias("f0"), F.col("authorized").alias("a0"))
    b = risk.unit_flags(d.filter("regime = '5-LOW'"), ["unit_id"])
    return a.join(b, "unit_id").agg(F.count("*").alias("bundles"), F.count_if(~F.col("f0") & F.col("failed")).alias("new_failures"), F.count_if(F.col("a0") & ~F.col("authorized")).alias("lost_coverage"))


SGRID = [round(0.5 + 0.05 * i, 2) for i in range(10)]


@query("t06_threshold_curve", f"WITH {RC}, g(threshold) AS (VALUES {values([(v,) for v in SGRID])}), s AS (SELECT threshold, label, CASE WHEN score>=threshold THEN CASE veto_state WHEN 'passed' THEN 1 WHEN 'failed' THEN -1 ELSE 0 END WHEN score<=1.0::DOUBLE-threshold THEN -1 ELSE 0 END AS choice FROM rc CROSS JOIN g) SELECT threshold, count(*) AS total, count(*) FILTER (choice<>0) AS decisions, count(*) FILTER ((choice=1 AND NOT label) OR (choice=-1 AND label)) AS errors, round(count(*) FILTER (choice<>0)/count(*)::DOUBLE,9) AS coverage, round(count(*) FILTER ((choice=1 AND NOT label) OR (choice=-1 AND label))/count(*) FILTER (choice<>0)::DOUBLE,9) AS selective_error FROM s GROUP BY 1")
def t06(t):
    g = risk.selective_grid(risk_cases(t), SGRID)
    return g.withColumn("coverage", r9("coverage")).withColumn("selective_error", r9("selective_error"))


@query("t06_selected_threshold")
def t06b(t):
    g = risk.selective_grid(risk_cases(t), SGRID).withColumn("upper", bound_column(F.col("errors"), F.col("decisions"), 0.95, "upper"))
    ok = g.filter((F.col("decisions") > 0) & (F.col("upper") <= 0.20))
    return ok.agg(F.max_by(F.struct("threshold", "coverage", "selective_error", "upper"), F.struct("coverage", -F.col("selective_error"), "threshold")).alias("b")).select("b.*")


@query("h17_exact_bounds")
def h17(t):
    p = risk.false_authorization_metrics(risk.decide(risk_cases(t), 0.9), ["claim", "stratum"])
    return p.select("claim", "stratum", "authorizations", "false_authorizations", bound_column(F.col("false_authorizations"), F.col("authorizations"), 0.95, "upper").alias("upper"),
                    bound_column(F.col("authorizations"), F.col("rows"), 0.95, "lower").alias("lower"))


@query("l01_semantic_admissibility", f"WITH {B.DOMAIN_SQL} SELECT claim, CASE WHEN ok THEN 'passed' WHEN n_failed>0 THEN 'failed' ELSE 'unresolved' END AS veto_state, count(*) AS n FROM domain GROUP BY 1,2")
def l01(t):
    from veriframe.operators import domain

    d = domain.infer_all(B.packages(t), B.evidence(t), B.V2)
    state = F.when(F.col("status") == "profile_authorized", "passed").when(F.col("n_failed") > 0, "failed").otherwise("unresolved")
    return d.groupBy("claim", state.alias("veto_state")).agg(F.count("*").alias("n"))


@query("l14_transport_audit", f"WITH {B.DOMAIN_SQL}, sc AS (SELECT d.claim, d.ok, o_orderstatus AS domain_key, o_custkey AS unit_id, round({B.hash_unit_sql(chr(39) + 'tr:' + chr(39) + '||d.package_id||' + chr(39) + ':' + chr(39) + '||d.claim')},3) AS score, o_totalprice>100000 AS label FROM domain d JOIN packages USING (package_id)) SELECT domain_key, claim, count(*) AS rows, count(*) FILTER (ok AND score>=0.5) AS authorizations, count(*) FILTER (ok AND score>=0.5 AND NOT label) AS false_authorizations FROM sc GROUP BY 1,2")
def l14(t):
    """Frozen scores meet real admissibility (the domain gate), then metrics per domain and claim in one plan."""
    from veriframe.operators import domain

    d = domain.infer_all(B.packages(t), B.evidence(t), B.V2).select("package_id", "claim", (F.col("status") == "profile_authorized").alias("admissible"))
    o = t.orders.select(F.col("o_orderkey").alias("package_id"), F.col("o_orderstatus").alias("domain_key"), (F.col("o_totalprice") > 100000).alias("label"))
    s = F.round(H.hash_unit(F.concat_ws(":", F.lit("tr"), F.col("package_id").cast("string"), F.col("claim"))), 3)
    x = risk.decide(d.join(o, "package_id").withColumn("score", s), 0.5)
    return risk.false_authorization_metrics(x, ["domain_key", "claim"]).drop("coverage", "risk")


@query("l15_risk_policy_calibration")
def l15(t):
    """Constrained and unconstrained thresholds for claims whose label varies."""
    c = risk_cases(t)
    varying = c.groupBy("claim").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("claim")
    x = c.join(varying, "claim", "left_semi")
    x = x.withColumn("mode", F.explode(F.array(F.lit("constrained"), F.lit("unconstrained")))).withColumn("admissible", F.col("admissible") | (F.col("mode") == "unconstrained"))
    x = x.withColumn("claim", F.concat_ws("#", "claim", "mode"))
    th = risk.claim_thresholds(x, GRID, 0.05, 0.95, len(CLAIMS4)).groupBy("claim").agg(F.min(F.when(F.col("valid"), F.col("threshold"))).alias("threshold"))
    return th.select(F.split("claim", "#")[0].alias("claim"), F.split("claim", "#")[1].alias("mode"), "threshold")


@query("g21_scope_enforced_transfer", f"WITH {_D} SELECT stratum, stratum='F' AS in_scope, CASE WHEN stratum='F' THEN count(*) FILTER (decision) ELSE 0 END AS authorizations, CASE WHEN stratum='F' THEN count(*) FILTER (decision AND NOT label) ELSE 0 END AS false_authorizations, count(*) FILTER (decision) AS raw_authorizations FROM d GROUP BY 1")
def g21(t):
    m = risk.false_authorization_metrics(risk.decide(risk_cases(t), 0.9), ["stratum"])
    ok = F.col("stratum").eqNullSafe("F")
    zero = lambda c: F.when(ok, F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c)
    return m.select("stratum", ok.alias("in_scope"), zero("authorizations"), zero("false_authorizations"), F.col("authorizations").alias("raw_authorizations"))


# ---- review panels -----------------------------------------------------------

RT = "rt AS (SELECT c_nationkey AS rater_id, l_partkey AS part_id, 1 + max(l_orderkey+l_linenumber) % 4 AS rating FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey GROUP BY 1,2), rb AS (SELECT p_brand AS item_id, rater_id, 1 + sum(rating)%4 AS rating FROM rt JOIN part ON p_partkey=part_id GROUP BY 1,2)"


def ratings(t):
    """Brands as items, customer nations as raters, rating 1..4 from keys."""
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("rater_id"))
    per = t.lineitem.join(c, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("rater_id", "l_partkey").agg((F.max(F.col("l_orderkey") + F.col("l_linenumber")) % 4 + 1).alias("rating"))
    return per.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("item_id"), "rater_id").agg((F.sum("rating") % 4 + 1).alias("rating"))


@query("a27_content_validity", f"WITH {RT}, i AS (SELECT item_id, avg((rating>=3)::INT) AS cvi, count(*) AS n FROM rb GROUP BY 1) SELECT count(*) AS items, round(avg(cvi),9) AS scale_cvi, round(min(cvi),9) AS lo, round(max(cvi),9) AS hi FROM i")
def a27(t):
    i = ratings(t).groupBy("item_id").agg(F.avg((F.col("rating") >= 3).cast("int")).alias("cvi"))
    return i.agg(F.count("*").alias("items"), r9(F.avg("cvi")).alias("scale_cvi"), r9(F.min("cvi")).alias("lo"), r9(F.max("cvi")).alias("hi"))


@query("h18_modified_kappa", f"WITH {RT}, i AS (SELECT item_id, count(*) FILTER (rating>=3) AS a, count(*) AS n FROM rb GROUP BY 1), c AS (SELECT *, factorial(n::INT)::DOUBLE/(factorial(a::INT)::DOUBLE*factorial((n-a)::INT)::DOUBLE)*pow(0.5,n) AS chance FROM i) SELECT item_id, a AS agreeing, n AS raters, round((a::DOUBLE/n-chance)/(1-chance),6) AS kappa FROM c")
def h18(t):
    i = ratings(t).groupBy("item_id").agg(F.count_if(F.col("rating") >= 3).alias("agreeing"), F.count("*").alias("raters"))
    k = N.modified_kappa(F.col("agreeing") / F.col("raters"), F.col("agreeing"), F.col("raters"))
    return i.select("item_id", "agreeing", "raters", F.round(k, 6).alias("kappa"))


@query("h19_fleiss_kappa", f"WITH {RT}, i AS (SELECT item_id, count(*) FILTER (rating>=3) AS y, count(*) AS n FROM rb GROUP BY 1), z AS (SELECT avg((y*(y-1)+(n-y)*(n-y-1))/(n*(n-1))::DOUBLE) AS o, sum(y)/sum(n)::DOUBLE AS p FROM i) SELECT round((o-(p*p+(1-p)*(1-p)))/(1-(p*p+(1-p)*(1-p))),9) AS kappa FROM z")
def h19(t):
    i = ratings(t).groupBy("item_id").agg(F.count_if(F.col("rating") >= 3).alias("y"), F.count("*").alias("n"))
    y, n = F.col("y"), F.col("n")
    z = i.agg(F.avg((y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1))).alias("o"), (F.sum(y) / F.sum(n)).alias("p"))
    e = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return z.select(r9(F.when(e < 1, (F.col("o") - e) / (1 - e)).otherwise(1.0)).alias("kappa"))


@query("a28_panel_eligibility", "WITH r AS (SELECT c_nationkey AS rater_id, bool_or(c_mktsegment='BUILDING') AS methods, bool_or(c_mktsegment='MACHINERY') AS biology, bool_or(c_acctbal>9990) AS computation FROM customer GROUP BY 1) SELECT stratum, n FROM (SELECT 'methods' AS stratum, count(*) FILTER (methods) AS n FROM r UNION ALL SELECT 'biology', count(*) FILTER (biology) FROM r UNION ALL SELECT 'computation', count(*) FILTER (computation) FROM r UNION ALL SELECT 'raters', count(*) FROM r)")
def a28(t):
    seg = F.col("c_mktsegment")
    r = t.customer.groupBy("c_nationkey").agg(F.bool_or(seg == "BUILDING").alias("methods"), F.bool_or(seg == "MACHINERY").alias("biology"), F.bool_or(F.col("c_acctbal") > 9990).alias("computation"))
    a = r.agg(F.count_if("methods").alias("methods"), F.count_if("biology").alias("biology"), F.count_if("computation").alias("computation"), F.count("*").alias("raters"))
    return a.unpivot([], ["methods", "biology", "computation", "raters"], "stratum", "n")


@query("j29_rater_item_completeness", f"WITH {RT} SELECT r.rater_id, count(*) AS missing FROM (SELECT DISTINCT rater_id FROM rb) r CROSS JOIN (SELECT DISTINCT p_brand AS item_id FROM part) i WHERE (r.rater_id, i.item_id) NOT IN (SELECT rater_id, item_id FROM rb WHERE rating<>4) GROUP BY 1")
def j29(t):
    """Missing items per rater as total minus present, so raters and items are never multiplied out."""
    done = ratings(t).filter("rating <> 4").groupBy("rater_id").agg(F.count_distinct("item_id").alias("have"))
    raters = ratings(t).select("rater_id").distinct()
    n = F.broadcast(t.part.agg(F.count_distinct("p_brand").alias("items"), F.lit(1).alias("_one")))
    j = raters.join(done, "rater_id", "left").withColumn("_one", F.lit(1)).join(n, "_one")
    return j.select("rater_id", (F.col("items") - F.coalesce("have", F.lit(0))).alias("missing")).filter("missing > 0")


@query("g23_panel_validation", f"WITH {RT}, i AS (SELECT item_id, avg((rating>=3)::INT) AS cvi, count(*) FILTER (rating=1) AS vetoes, count(*) AS n FROM rb GROUP BY 1) SELECT item_id, round(cvi,9) AS cvi, vetoes, concat_ws('|', CASE WHEN n<20 THEN 'too_few_raters' END, CASE WHEN cvi<0.5 THEN 'low_validity' END, CASE WHEN vetoes>7 THEN 'critical_veto' END) AS reasons FROM i")
def g23(t):
    i = ratings(t).groupBy("item_id").agg(F.avg((F.col("rating") >= 3).cast("int")).alias("cvi"), F.count_if(F.col("rating") == 1).alias("vetoes"), F.count("*").alias("n"))
    why = F.array_compact(F.array(F.when(F.col("n") < 20, F.lit("too_few_raters")), F.when(F.col("cvi") < 0.5, F.lit("low_validity")), F.when(F.col("vetoes") > 7, F.lit("critical_veto"))))
    return i.select("item_id", r9("cvi").alias("cvi"), "vetoes", F.array_join(why, "|").alias("reasons"))
