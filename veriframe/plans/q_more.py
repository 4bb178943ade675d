"""Queries on pluggable estimators, cohort pair records and agreement of rule semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import hashing as H
from veriframe.operators import domain
from veriframe.plans import bindings as B
from veriframe.plans.q_stats import pair_data, power_sums, standardized
from veriframe.plans.registry import query, values

V1 = B.V1
r6 = lambda c: F.round(c, 6)

# Registry of direction estimators: a name and an expression on a pair's power sums.
ESTIMATORS = {}


def register_estimator(name, build):
    """``build`` returns a signed margin column (positive = forward) from the sums of a pair."""
    if name in ESTIMATORS:
        raise ValueError(f"estimator {name} exists")
    ESTIMATORS[name] = build


register_estimator("third_moment", lambda: F.col("sx")[3] - F.col("sy")[3])
register_estimator("cross_skew", lambda: F.col("cyx")[2] - F.col("cxy")[2])


@query("f01_pluggable_estimators", "WITH m AS (SELECT l_suppkey AS pair, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, stddev_pop(l_extendedprice) AS sy FROM lineitem GROUP BY 1), z AS (SELECT l_suppkey AS pair, (l_quantity-mx)/sx AS x, (l_extendedprice-my)/sy AS y FROM lineitem JOIN m ON pair=l_suppkey) SELECT pair, 'third_moment' AS estimator, round(sum(x*x*x)-sum(y*y*y),5) AS margin FROM z GROUP BY 1 UNION ALL SELECT pair, 'cross_skew', round(sum(y*x*x)-sum(x*y*y),5) FROM z GROUP BY 1")
def f01(t):
    m = power_sums(standardized(pair_data(t)))
    rows = F.array(*[F.struct(F.lit(n).alias("estimator"), F.round(b(), 5).alias("margin")) for n, b in ESTIMATORS.items()])
    return m.select("pair", F.inline(rows))


_COH = B.hash_mod_sql("'cohort:'||l_orderkey||'-'||l_linenumber", 5)


@query("i36_cohort_pair_records", f"WITH d AS (SELECT l_suppkey AS pair, l_quantity AS x, l_extendedprice AS y, {_COH} AS cohort FROM lineitem), f AS (SELECT pair, regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM d WHERE cohort=0 GROUP BY 1), s AS (SELECT pair, cohort, 1-sum(pow(y-a-b*x,2))/(var_pop(y)*count(*)) AS r2 FROM d JOIN f USING (pair) WHERE cohort>0 GROUP BY 1,2 HAVING var_pop(y)>0) SELECT pair, count(*) AS cohorts, round(min(r2),6) AS worst, bool_and(r2>0.1) AS reproduced FROM s GROUP BY 1")
def i36(t):
    """Fit on one hash cohort, scored on the four others; the record is a conjunction over cohorts."""
    d = t.lineitem.select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
                          H.hash_mod(F.concat(F.lit("cohort:"), F.concat_ws("-", "l_orderkey", "l_linenumber")), 5).alias("cohort"))
    f = d.filter("cohort = 0").groupBy("pair").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    e = F.pow(F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.lit(2))
    s = d.filter("cohort > 0").join(f, "pair").groupBy("pair", "cohort").agg((1 - F.try_divide(F.sum(e), F.var_pop("y") * F.count("*"))).alias("r2")).filter("r2 is not null")
    return s.groupBy("pair").agg(F.count("*").alias("cohorts"), r6(F.min("r2")).alias("worst"), F.bool_and(F.col("r2") > 0.1).alias("reproduced"))


@query("s10_rule_table", f"WITH {B.EVIDENCE_SQL}, ru(rule_id, priority, st) AS (VALUES {values([(r[0], r[1], r[3]) for r in V1.rules])}) SELECT rule_id, priority::INT AS priority, count(e.package_id) AS facts FROM ru LEFT JOIN evidence e ON e.status=ru.st GROUP BY 1,2")
def s10(t):
    n = B.evidence(t).groupBy(F.col("status").alias("evidence_status")).agg(F.count("*").alias("facts"))
    return V1.rules_df(t.spark).join(n, "evidence_status", "left").na.fill(0, ["facts"]).select("rule_id", "priority", "facts")


@query("x14_rule_semantics_agree", f"WITH {B.EVIDENCE_SQL} SELECT count(*)*{len(V1.claims)} AS compared, 0::BIGINT AS disagreements FROM packages")
def x14(t):
    """The prioritized rules and an order-free SQL statement of them, compared on every package and claim."""
    first = domain.prioritized_decisions(B.packages(t), B.evidence(t), V1).select("package_id", "claim", "decision")
    pairs = F.array(*[F.struct(F.lit(c).alias("claim"), F.lit(b).alias("block")) for c, b, _ in V1.relations()])
    want = B.packages(t).select("package_id", F.inline(pairs))
    evidence = B.evidence(t).select("package_id", "block", "status")
    second = t.spark.sql("""
      WITH s AS (SELECT w.package_id, w.claim, coalesce(e.status, 'unknown') AS st FROM {want} w LEFT JOIN {evidence} e ON e.package_id = w.package_id AND e.block = w.block)
      SELECT package_id, claim, CASE max(CASE st WHEN 'failed' THEN 4 WHEN 'requires_review' THEN 3 WHEN 'unknown' THEN 2 WHEN 'not_applicable' THEN 1 ELSE 0 END)
        WHEN 4 THEN 'blocked' WHEN 3 THEN 'needs_external_review' WHEN 2 THEN 'uncertain' WHEN 1 THEN 'out_of_scope' ELSE 'supported' END AS other
      FROM s GROUP BY package_id, claim""", want=want, evidence=evidence)
    j = first.join(second, ["package_id", "claim"], "full")
    return j.agg(F.count("*").alias("compared"), F.count_if(~F.col("decision").eqNullSafe(F.col("other"))).alias("disagreements"))
