"""Queries on pair frames, nulls, bootstraps, regressions and rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import numeric as N
from veriframe.functions import tails
from veriframe.operators import inference as I
from veriframe.operators import pairs as P
from veriframe.operators import ranking
from veriframe.plans import bindings as B
from veriframe.plans.registry import query

r6 = lambda c: F.round(c, 6)
r9 = lambda c: F.round(c, 9)


def units(t):
    """Suppliers as units with positions, response columns and a kind."""
    l = t.lineitem.groupBy(F.col("l_suppkey").alias("root")).agg(
        r6(F.avg("l_discount")).alias("cc_abs"), r6(F.avg("l_tax")).alias("cc_max"), r6(F.avg("l_quantity") / 50).alias("cc_norm"),
        r6(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))).alias("osi"), r6(F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0))).alias("dsi"),
        r6(F.avg("l_extendedprice") / 100000).alias("gosi"), r6(F.avg(F.col("l_discount") * F.col("l_tax")) * 100).alias("gdsi"))
    s = t.supplier.select(
        F.col("s_suppkey").alias("root"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_nationkey") * 40.0).alias("y"), (F.col("s_suppkey") * 37 % 500).cast("double").alias("z"),
        F.concat(F.lit("k"), F.col("s_nationkey") % 5).alias("kind"), r6(F.pmod(F.col("s_acctbal"), F.lit(180.0))).alias("pref_ori"), r6(F.pmod(F.col("s_acctbal") * 3, F.lit(360.0))).alias("pref_dir"))
    return P.prepare_units(s.join(l, "root").withColumn("readout_x", F.col("cc_abs")).withColumn("readout_y", F.col("cc_max")))


def edges(t):
    """Supplier of an order line to supplier of the next line, where returned lines meet new ones."""
    per = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("supp"), F.sum("l_extendedprice").alias("size"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("out"),
        F.bool_or((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("inn"))
    a = per.filter("out").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("supp").alias("pre"), "size")
    b = per.filter("inn").select("l_orderkey", "l_linenumber", F.col("supp").alias("post"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).filter("pre <> post").select("pre", "post", "size")


_ZC = ", ".join(f"({c}-avg({c}) OVER ())/CASE WHEN stddev_pop({c}) OVER ()=0 THEN 1 ELSE stddev_pop({c}) OVER () END AS z_{c}" for c in P.CONTINUOUS)
UE = f"""un0 AS (SELECT s_suppkey AS root, s_acctbal/10 AS x, s_nationkey*40.0::DOUBLE AS y, (s_suppkey*37%500)::DOUBLE AS z, 'k'||(s_nationkey%5) AS kind, round(((s_acctbal%180)+180)%180,6) AS pref_ori, round(((s_acctbal*3%360)+360)%360,6) AS pref_dir, l.*
  FROM supplier JOIN (SELECT l_suppkey, round(avg(l_discount),6) AS cc_abs, round(avg(l_tax),6) AS cc_max, round(avg(l_quantity)/50,6) AS cc_norm, round(avg((l_returnflag='R')::INT),6) AS osi, round(avg((l_linestatus='F')::INT),6) AS dsi,
  round(avg(l_extendedprice)/100000,6) AS gosi, round(avg(l_discount*l_tax)*100,6) AS gdsi FROM lineitem GROUP BY 1) l ON l_suppkey=s_suppkey),
 un AS (SELECT *, {_ZC}, CASE WHEN cc_abs>=median(cc_abs) OVER () THEN 'R' ELSE 'L' END||CASE WHEN cc_max>=median(cc_max) OVER () THEN 'U' ELSE 'D' END AS quadrant, cc_norm>=median(cc_norm) OVER () AS reliable, row_number() OVER (ORDER BY root)-1 AS idx, count(*) OVER () AS n FROM un0),
 per AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS supp, sum(l_extendedprice) AS size, bool_or(l_returnflag='R' AND l_linestatus='F') AS o, bool_or(l_returnflag='N' AND l_linestatus='O') AS i FROM lineitem GROUP BY 1,2),
 ed AS (SELECT a.supp AS pre, b.supp AS post, a.size FROM per a JOIN per b ON a.l_orderkey=b.l_orderkey AND b.l_linenumber=a.l_linenumber+1 WHERE a.o AND b.i AND a.supp<>b.supp),
 ag AS (SELECT pre, post, count(*) AS synapse_count, sum(size) AS synapse_size_sum FROM ed GROUP BY 1,2)"""
K_ = 16
_SQ = "+".join(f"pow(a.z_{c}-b.z_{c},2)" for c in P.CONTINUOUS)


def _circ(c, period):
    return f"1-least(abs(a.{c}-b.{c})%{period}, {period}-abs(a.{c}-b.{c})%{period})/{period / 2}"


PF = UE + f""",
 ctl AS (SELECT DISTINCT a.root AS pre, b.root AS post FROM un a CROSS JOIN range({K_}) r(j) JOIN un b ON b.idx=(a.idx+1+{B.hash_index_sql("'control:'||a.root||':'||j", 'a.n-1')})%a.n WHERE (a.root,b.root) NOT IN (SELECT pre, post FROM ag)),
 pr AS (SELECT pre, post, synapse_count, synapse_size_sum, true AS connected FROM ag UNION ALL SELECT pre, post, 0, 0.0, false FROM ctl),
 pf AS (SELECT pr.*, coalesce(o.d,0) AS pre_degree, coalesce(q.d,0) AS post_degree, pr.pre||'-'||pr.post AS pair_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS distance, a.kind=b.kind AS same_kind, a.kind||'->'||b.kind AS kind_pair, a.quadrant=b.quadrant AS same_quadrant, a.reliable AND b.reliable AS both_reliable,
  -sqrt({_SQ}) AS response_profile, {_circ('pref_ori', 180)} AS orientation, {_circ('pref_dir', 360)} AS direction, -abs(a.cc_norm-b.cc_norm) AS cc_norm, -sqrt(pow(a.cc_abs-b.cc_abs,2)+pow(a.cc_max-b.cc_max,2)) AS readout_location
  FROM pr JOIN un a ON a.root=pr.pre JOIN un b ON b.root=pr.post LEFT JOIN (SELECT pre, count(*) AS d FROM ag GROUP BY 1) o ON o.pre=pr.pre LEFT JOIN (SELECT post, count(*) AS d FROM ag GROUP BY 1) q ON q.post=pr.post),
 pm AS (SELECT *, response_profile+orientation+direction AS aggregate_functional FROM pf)"""


def frame(t):
    return P.pair_frame(units(t), edges(t), K_).withColumn("pair_id", F.concat_ws("-", "pre", "post"))


@query("a13_edge_aggregation", f"WITH {UE} SELECT pre, post, synapse_count, round(synapse_size_sum,2) AS synapse_size_sum FROM ag")
def a13(t):
    return P.aggregate_edges(edges(t)).withColumn("synapse_size_sum", F.round("synapse_size_sum", 2))


@query("a14_degrees", f"WITH {UE} SELECT 'pre' AS side, pre AS unit, count(DISTINCT post) AS degree FROM ed GROUP BY 2 UNION ALL SELECT 'post', post, count(DISTINCT pre) FROM ed GROUP BY 2")
def a14(t):
    o, i = P.degrees(P.aggregate_edges(edges(t)))
    return o.select(F.lit("pre").alias("side"), F.col("pre").alias("unit"), F.col("pre_degree").alias("degree")).unionByName(i.select(F.lit("post").alias("side"), F.col("post").alias("unit"), F.col("post_degree").alias("degree")))


@query("j08_pair_frame", f"WITH {PF} SELECT pre, post, connected, synapse_count, pre_degree, post_degree, round(distance,6) AS distance, same_kind, same_quadrant, both_reliable FROM pm")
def j08(t):
    return frame(t).select("pre", "post", "connected", "synapse_count", "pre_degree", "post_degree", r6("distance").alias("distance"), "same_kind", "same_quadrant", "both_reliable")


@query("j09_pair_metrics", f"WITH {PF} SELECT pre, post, {', '.join(f'round({m},6) AS {m}' for m in P.METRICS)} FROM pm")
def j09(t):
    return frame(t).select("pre", "post", *[r6(m).alias(m) for m in P.METRICS])


@query("j10_pair_records", f"WITH {PF} SELECT connected, count(*) AS pairs, round(avg(distance),6) AS distance, round(avg(aggregate_functional),6) AS similarity, sum(synapse_count)::BIGINT AS synapses FROM pm GROUP BY 1")
def j10(t):
    return frame(t).groupBy("connected").agg(F.count("*").alias("pairs"), r6(F.avg("distance")).alias("distance"), r6(F.avg("aggregate_functional")).alias("similarity"), F.sum("synapse_count").alias("synapses"))


def binned(f):
    """Distance bins from the connected pairs and coarse degree bins."""
    q = f.filter("connected").agg(F.percentile(F.round("distance", 6), F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"), F.lit(1).alias("_one"))
    g = f.withColumn("_one", F.lit(1)).join(F.broadcast(q), "_one")
    d = F.round("distance", 6)
    return g.withColumn("dbin", (d > F.col("e")[0]).cast("int") + (d > F.col("e")[1]).cast("int")).withColumn("gbin", F.least(F.floor(F.log2(F.col("pre_degree") + 1.0)), F.lit(9))).drop("e", "_one")


def stratified(f):
    names = {"all_pairs": F.lit(True), "same_kind": F.col("same_kind"), "different_kind": ~F.col("same_kind"), "same_quadrant": F.col("same_quadrant"), "both_reliable": F.col("both_reliable")}
    arr = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names.items()], F.concat(F.lit("distance:"), F.col("dbin"))))
    return f.withColumn("stratum", F.explode(arr))


_BIN = PF + """, q AS (SELECT quantile_cont(round(distance,6), [1.0/3,2.0/3]) AS e FROM pm WHERE connected), pb AS (SELECT pm.*, (round(distance,6)>e[1])::INT+(round(distance,6)>e[2])::INT AS dbin, least(floor(log2(pre_degree+1.0)),9)::BIGINT AS gbin FROM pm CROSS JOIN q),
 ps AS (SELECT pb.*, s.stratum FROM pb CROSS JOIN (VALUES ('all_pairs'),('same_kind'),('different_kind'),('same_quadrant'),('both_reliable')) s(stratum) WHERE CASE s.stratum WHEN 'all_pairs' THEN true WHEN 'same_kind' THEN same_kind WHEN 'different_kind' THEN NOT same_kind WHEN 'same_quadrant' THEN same_quadrant ELSE both_reliable END UNION ALL SELECT pb.*, 'distance:'||dbin FROM pb)"""


@query("p18_candidate_strata", f"WITH {_BIN} SELECT stratum, count(*) AS pairs, count(*) FILTER (connected) AS connected FROM ps GROUP BY 1 HAVING count(*) FILTER (connected)>=20 UNION ALL SELECT 'kind_pair:'||kind_pair, count(*), count(*) FILTER (connected) FROM pb WHERE kind_pair IN (SELECT kind_pair FROM pb WHERE connected GROUP BY 1 ORDER BY count(*) DESC, kind_pair LIMIT 4) GROUP BY 1 HAVING count(*) FILTER (connected)>=20")
def p18(t):
    f = binned(frame(t))
    fixed = stratified(f).groupBy("stratum").agg(F.count("*").alias("pairs"), F.count_if("connected").alias("connected"))
    top = f.filter("connected").groupBy("kind_pair").count().orderBy(F.desc("count"), "kind_pair").limit(4).select("kind_pair")
    cat = f.join(F.broadcast(top), "kind_pair", "left_semi").groupBy(F.concat(F.lit("kind_pair:"), "kind_pair").alias("stratum")).agg(F.count("*").alias("pairs"), F.count_if("connected").alias("connected"))
    return fixed.unionByName(cat).filter("connected >= 20")


REPS = 50
_NULL = _BIN + f""", base AS (SELECT *, dbin||'|'||gbin AS bin FROM pb), sz AS (SELECT bin, count(*) FILTER (connected) AS need, count(*) FILTER (NOT connected) AS have FROM base GROUP BY 1 HAVING count(*) FILTER (connected)>0),
 rk AS (SELECT r.rep, base.*, need, row_number() OVER (PARTITION BY base.bin, r.rep ORDER BY sha256('null:'||r.rep||':'||pair_id), pair_id) AS rn FROM base JOIN sz ON sz.bin=base.bin AND have>=need CROSS JOIN range({REPS}) r(rep) WHERE NOT connected),
 mem AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY sha256('pool:'||pair_id), pair_id)-1 AS slot, count(*) OVER (PARTITION BY src) AS size, orientation, cc_norm FROM (SELECT bin AS src, * FROM base WHERE NOT connected UNION ALL SELECT '*', * FROM base WHERE NOT connected)),
 tot AS (SELECT src, max(size) AS size FROM mem GROUP BY 1),
 dr AS (SELECT r.rep, tot.src, {B.hash_index_sql("'null:'||r.rep||':'||pair_id", 'tot.size')} AS slot FROM base JOIN sz ON sz.bin=base.bin AND have<need JOIN tot ON tot.src=CASE WHEN have>0 THEN base.bin ELSE '*' END CROSS JOIN range({REPS}) r(rep) WHERE connected),
 drawn AS (SELECT rep, orientation, cc_norm FROM rk WHERE rn<=need UNION ALL SELECT rep, orientation, cc_norm FROM dr JOIN mem USING (src, slot)),
 nl AS (SELECT rep, avg(orientation) AS orientation, avg(cc_norm) AS cc_norm FROM drawn GROUP BY 1)"""


@query("i15_matched_null_means", f"WITH {_NULL} SELECT rep::INT AS rep, round(orientation,6) AS orientation, round(cc_norm,6) AS cc_norm FROM nl")
def i15(t):
    from veriframe.session import cut

    n = P.matched_null(binned(cut(frame(t))), [], ["dbin", "gbin"], ["orientation", "cc_norm"], REPS, "null")
    return n.select("rep", r6("orientation").alias("orientation"), r6("cc_norm").alias("cc_norm"))


@query("i16_within_bin_shuffle", f"WITH {_BIN}, rk AS (SELECT r.rep, pb.dbin, orientation, row_number() OVER (PARTITION BY dbin, r.rep ORDER BY sha256('shuffle:'||r.rep||':'||pair_id), pair_id) AS rn, count(*) FILTER (connected) OVER (PARTITION BY dbin, r.rep) AS need FROM pb CROSS JOIN range(50) r(rep)) SELECT rep::INT AS rep, round(avg(orientation),6) AS orientation FROM rk WHERE rn<=need GROUP BY 1")
def i16(t):
    """Labels shuffled within distance bins: the first ranks of the whole bin play the connected pairs."""
    f = binned(frame(t)).select("dbin", "pair_id", "orientation", "connected")
    need = f.groupBy("dbin").agg(F.count_if("connected").alias("need"))
    x = f.join(need, "dbin").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(49))))
    k = ranking.hash_rank(x, ["dbin", "rep"], F.col("pair_id"), F.concat_ws(":", F.lit("shuffle"), F.col("rep").cast("string")))
    return k.filter("rn <= need").groupBy("rep").agg(r6(F.avg("orientation")).alias("orientation"))


@query("i17_stratum_metric_tests")
def i17(t):
    """Every (stratum, metric) against its distance- and degree-matched null, with adjusted p-values."""
    from veriframe.session import cut

    f = cut(stratified(binned(cut(frame(t)))).withColumn("pair_id", F.concat_ws(":", "stratum", "pair_id")))
    null = P.matched_null(f, ["stratum"], ["dbin", "gbin"], list(P.METRICS), REPS, "strata")
    tests = P.null_tests(f, null, ["stratum"], list(P.METRICS), REPS).filter("n_connected >= 20")
    return ranking.benjamini_hochberg(cut(tests), [], "p").withColumn("confirmed", (F.col("delta") > 0) & (F.col("q") <= 0.05)).select("stratum", "metric", "n_connected", r6("observed").alias("observed"), r6("delta").alias("delta"), r6("p").alias("p"), r6("q").alias("q"), "confirmed")


@query("i18_cohort_robustness")
def i18(t):
    """Conjunction of matched and shuffled nulls for one metric."""
    from veriframe.session import cut

    f = cut(binned(cut(frame(t))))
    a = P.null_tests(f, P.matched_null(f, [], ["dbin", "gbin"], ["cc_norm"], REPS, "cohort"), [], ["cc_norm"], REPS)
    b = P.null_tests(f, P.matched_null(f, [], ["dbin"], ["cc_norm"], REPS, "distance"), [], ["cc_norm"], REPS)
    b = b.select("metric", F.col("p").alias("p_distance"), F.col("delta").alias("delta_distance"))
    return a.join(b, "metric").withColumn("robust", (F.col("p") <= 0.05) & (F.col("p_distance") <= 0.05) & (F.col("delta") > 0) & (F.col("delta_distance") > 0))


def design(f):
    """Standardized controls; means and deviations come from one aggregate row."""
    logs = {"d": F.log1p("distance"), "o": F.log1p(F.col("pre_degree").cast("double")), "i": F.log1p(F.col("post_degree").cast("double"))}
    x = f.select("pre", "post", "connected", "same_kind", "aggregate_functional", *[c.alias(k) for k, c in logs.items()])
    s = x.agg(*[F.avg(k).alias(f"m_{k}") for k in logs], *[F.stddev_pop(k).alias(f"s_{k}") for k in logs], F.lit(1).alias("_one"))
    x = x.withColumn("_one", F.lit(1)).join(F.broadcast(s), "_one")
    z = {k: F.when(F.col(f"s_{k}") > 0, (F.col(k) - F.col(f"m_{k}")) / F.col(f"s_{k}")).otherwise(0.0) for k in logs}
    return x.select("pre", "post", F.lit(1.0).alias("x0"), F.col("connected").cast("double").alias("x1"), z["d"].alias("x2"), (z["d"] * z["d"]).alias("x3"), z["o"].alias("x4"), z["i"].alias("x5"), F.col("same_kind").cast("double").alias("x6"), F.col("aggregate_functional").alias("y"))


XS = [f"x{i}" for i in range(7)]


def ols(t):
    """Coefficient of connection with heteroskedastic and dyadic standard errors."""
    import numpy as np

    from veriframe.functions.solve import solve_normal
    from veriframe.session import cut

    d = cut(design(cut(frame(t))))
    g, c, _, n = P.gram(d, [F.col(x) for x in XS], F.col("y"))
    beta = solve_normal(g, c)
    res = F.col("y") - sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, XS, strict=True)), F.lit(0.0))
    sc = d.withColumn("r", res).select("pre", "post", *[(F.col(x) * F.col("r")).alias(x) for x in XS])
    meat, _, _, _ = P.gram(sc, [F.col(x) for x in XS], F.lit(0.0))
    dy = P.dyadic_meat(sc, XS)
    inv = np.linalg.inv(np.asarray(g))
    n_units = d.select(F.explode(F.array("pre", "post")).alias("u")).distinct().count()
    f1 = n / (n - len(XS))
    hc1 = float(np.sqrt(max(0.0, (f1 * inv @ np.asarray(meat) @ inv)[1, 1])))
    dyad = float(np.sqrt(max(0.0, (f1 * n_units / (n_units - 1) * inv @ np.asarray(dy) @ inv)[1, 1])))
    return d, beta, hc1, dyad, n, n_units


@query("i19_ols_dyadic")
def i19(t):
    _, beta, hc1, dyad, n, units_ = ols(t)
    out = t.spark.createDataFrame([(float(beta[1]), hc1, dyad, int(n), int(units_))], "coefficient double, hc1_se double, dyadic_se double, pairs bigint, units bigint")
    return out.withColumn("p_dyadic", tails.t_two_sided(F.col("coefficient") / F.col("dyadic_se"), (F.col("units") - 1).cast("double")))


@query("i20_dyadic_sums", f"WITH {PF}, inc AS (SELECT u, sum(orientation) AS s FROM (SELECT pre AS u, orientation FROM pm UNION ALL SELECT post, orientation FROM pm) GROUP BY 1), dy AS (SELECT least(pre,post) AS a, greatest(pre,post) AS b, sum(orientation) AS s FROM pm GROUP BY 1,2) SELECT round((SELECT sum(s*s) FROM inc)-(SELECT sum(s*s) FROM dy),4) AS meat")
def i20(t):
    m = P.dyadic_meat(frame(t).select("pre", "post", "orientation"), ["orientation"])
    return t.spark.createDataFrame([(round(m[0][0], 4),)], "meat double")


@query("i21_node_permutation")
def i21(t):
    """Residuals of relabelled pairs are recomputed from unit attributes, so no unit-by-unit matrix is needed."""
    from veriframe.functions.solve import solve_normal
    from veriframe.session import cut

    reps = 20
    u = cut(units(t))
    f = cut(frame(t))
    d = cut(design(f))
    low = [x for x in XS if x != "x1"]
    cols = [F.col(x) for x in low]
    g, cy, _, _ = P.gram(d, cols, F.col("y"))
    _, cf, _, _ = P.gram(d, cols, F.col("x1"))
    by, bf = solve_normal(g, cy), solve_normal(g, cf)
    lin = lambda b: sum((F.lit(float(v)) * F.col(x) for v, x in zip(b, low, strict=True)), F.lit(0.0))
    focal = cut(d.withColumn("e", F.col("x1") - lin(bf)).withColumn("ry", F.col("y") - lin(by)).select("pre", "post", "e", "ry"))
    den = focal.agg(F.sum(F.col("e") * F.col("e")).alias("d"), F.sum(F.col("e") * F.col("ry")).alias("o")).first()
    perm = I.permutations(u.select("root"), [], "root", reps, "node")
    m = focal.select("pre", "post", "e").join(perm.select("rep", F.col("root").alias("pre"), F.col("other").alias("p2")), "pre").join(perm.select("rep", F.col("root").alias("post"), F.col("other").alias("q2")), ["rep", "post"])
    agg = P.aggregate_edges(edges(t))
    o, i = P.degrees(agg)
    pair = m.select("rep", "e", F.col("p2").alias("pre"), F.col("q2").alias("post")).join(o, "pre", "left").join(i, "post", "left").na.fill(0, ["pre_degree", "post_degree"])
    full = P.attach_units(pair, u)
    s = f.agg(*[F.avg(c).alias(f"m_{k}") for k, c in _logs().items()], *[F.stddev_pop(c).alias(f"s_{k}") for k, c in _logs().items()], F.lit(1).alias("_one"))
    x = full.withColumn("_one", F.lit(1)).join(F.broadcast(s), "_one")
    z = {k: F.when(F.col(f"s_{k}") > 0, (c - F.col(f"m_{k}")) / F.col(f"s_{k}")).otherwise(0.0) for k, c in _logs().items()}
    x = x.select("rep", "e", F.col("aggregate_functional").alias("y"), F.lit(1.0).alias("x0"), z["d"].alias("x2"), (z["d"] * z["d"]).alias("x3"), z["o"].alias("x4"), z["i"].alias("x5"), F.col("same_kind").cast("double").alias("x6"))
    null = x.groupBy("rep").agg((F.sum(F.col("e") * (F.col("y") - lin(by))) / float(den["d"])).alias("stat"))
    obs = float(den["o"] / den["d"])
    return null.agg(F.lit(obs).alias("observed"), F.avg("stat").alias("null_mean"), F.stddev("stat").alias("null_sd"), ((1 + F.count_if(F.col("stat") >= obs)) / (F.count("*") + 1.0)).alias("p"))


def _logs():
    return {"d": F.log1p("distance"), "o": F.log1p(F.col("pre_degree").cast("double")), "i": F.log1p(F.col("post_degree").cast("double"))}


@query("i22_calibration_by_regime", "SELECT l_returnflag AS regime, count(*) AS trials, round(avg(l_discount),9) AS mean, round(stddev_samp(l_discount),9) AS sd, round(avg((l_discount>=0.05)::INT),9) AS rejection_rate, round(avg((abs(l_discount-0.05)<=0.02)::INT),9) AS coverage FROM (SELECT *, round(l_discount,2) FROM lineitem) GROUP BY 1")
def i22(t):
    x = F.col("l_discount")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("regime")).agg(
        F.count("*").alias("trials"), r9(F.avg(x)).alias("mean"), r9(F.stddev_samp(x)).alias("sd"), r9(F.avg((x >= 0.05).cast("int"))).alias("rejection_rate"), r9(F.avg((F.abs(x - 0.05) <= 0.02).cast("int"))).alias("coverage"))


# ---- permutation and bootstrap ------------------------------------------------

def cluster_values(t):
    """Orders as values, customers' nations as clusters and segments as levels."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("mouse"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"), "c_mktsegment", F.col("c_custkey"))


CV = "cv AS (SELECT c_nationkey AS mouse, o_totalprice AS value, o_orderkey AS id, c_custkey FROM orders JOIN customer ON c_custkey=o_custkey)"


@query("i08_label_permutation", f"WITH m AS (SELECT p_partkey AS id, p_retailprice AS v, p_type='ECONOMY' AS lab, row_number() OVER (ORDER BY p_partkey) AS pos FROM part), h AS (SELECT rep, p_partkey AS other, row_number() OVER (PARTITION BY rep ORDER BY sha256('perm:'||rep||':'||p_partkey), p_partkey) AS pos FROM part, range(40) r(rep)), z AS (SELECT h.rep, m.v, o.lab FROM h JOIN m USING (pos) JOIN m o ON o.id=h.other), s AS (SELECT rep, avg(v) FILTER (lab)-avg(v) FILTER (NOT lab) AS d FROM z GROUP BY 1), ob AS (SELECT avg(v) FILTER (lab)-avg(v) FILTER (NOT lab) AS d FROM m) SELECT round((SELECT d FROM ob),6) AS observed, round(avg(s.d),6) AS null_mean, round((1+count(*) FILTER (s.d>=(SELECT d FROM ob)))/41.0::DOUBLE,9) AS p FROM s")
def i08(t):
    m = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"), (F.col("p_type") == "ECONOMY").alias("lab"))
    perm = I.permutations(m, [], "id", 40, "perm")
    z = perm.join(m.select("id", "v"), "id").join(m.select(F.col("id").alias("other"), "lab"), "other")
    diff = F.avg(F.when(F.col("lab"), F.col("v"))) - F.avg(F.when(~F.col("lab"), F.col("v")))
    s = z.groupBy("rep").agg(diff.alias("d"))
    ob = m.agg(diff.alias("o"), F.lit(1).alias("_one"))
    return s.withColumn("_one", F.lit(1)).join(F.broadcast(ob), "_one").groupBy("o").agg(r6(F.avg("d")).alias("null_mean"), r9((1 + F.count_if(F.col("d") >= F.col("o"))) / 41.0).alias("p")).select(r6("o").alias("observed"), "null_mean", "p")


@query("i09_group_median_permutation", f"WITH g AS (SELECT o_custkey AS mouse, CASE WHEN count(DISTINCT o_orderpriority<='3-MEDIUM')=1 THEN bool_or(o_orderpriority<='3-MEDIUM') END AS lv, median(o_totalprice) AS m FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY mouse) AS pos FROM g WHERE lv IS NOT NULL), h AS (SELECT rep, mouse AS other, row_number() OVER (PARTITION BY rep ORDER BY sha256('grp:'||rep||':'||mouse), mouse) AS pos FROM k, range(30) r(rep)), s AS (SELECT h.rep, median(k.m) FILTER (o.lv)-median(k.m) FILTER (NOT o.lv) AS d FROM h JOIN k USING (pos) JOIN k o ON o.mouse=h.other GROUP BY 1), ob AS (SELECT median(m) FILTER (lv)-median(m) FILTER (NOT lv) AS d, count(*) AS n FROM k) SELECT (SELECT n FROM ob) AS included, (SELECT count(*) FROM g)-(SELECT n FROM ob) AS excluded, round((SELECT d FROM ob),4) AS observed, round((1+count(*) FILTER (abs(d)>=abs((SELECT d FROM ob))))/31.0::DOUBLE,9) AS p FROM s")
def i09(t):
    """Groups with mixed levels are excluded; medians per group are permuted as wholes."""
    lv = F.col("o_orderpriority") <= "3-MEDIUM"
    g = t.orders.groupBy(F.col("o_custkey").alias("mouse")).agg(F.min(lv).alias("lo"), F.max(lv).alias("hi"), F.median("o_totalprice").alias("m"))
    k = g.filter("lo = hi").select("mouse", F.col("lo").alias("lv"), "m")
    perm = I.permutations(k, [], "mouse", 30, "grp")
    z = perm.join(k.select("mouse", "m"), "mouse").join(k.select(F.col("mouse").alias("other"), "lv"), "other")
    diff = F.median(F.when(F.col("lv"), F.col("m"))) - F.median(F.when(~F.col("lv"), F.col("m")))
    s = z.groupBy("rep").agg(diff.alias("d")).withColumn("_one", F.lit(1))
    ob = k.agg(diff.alias("o"), F.count("*").alias("included"), F.lit(1).alias("_one"))
    ex = g.agg(F.count_if(F.col("lo") != F.col("hi")).alias("excluded"), F.lit(1).alias("_one"))
    j = s.join(F.broadcast(ob), "_one").join(F.broadcast(ex), "_one")
    return j.groupBy("included", "excluded", "o").agg(r9((1 + F.count_if(F.abs("d") >= F.abs("o"))) / 31.0).alias("p")).select("included", "excluded", F.round("o", 4).alias("observed"), "p")


def _boot_sql(seed, reps, key, src, n="n"):
    return f"bx AS (SELECT {key} AS k, row_number() OVER (ORDER BY {key})-1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {src})), bd AS (SELECT rep, {B.hash_index_sql(f'{chr(39)}{seed}:{chr(39)}||rep||{chr(39)}:{chr(39)}||idx', 'n')} AS idx FROM bx, range({reps}) r(rep)), bc AS (SELECT rep, k, count(*) AS times FROM bd JOIN bx USING (idx) GROUP BY 1,2)"


@query("i10_cluster_bootstrap", f"WITH {CV}, {_boot_sql('boot', 60, 'mouse', 'cv')}, v AS (SELECT mouse, round(median(value),2) AS m FROM cv GROUP BY 1), e AS (SELECT rep, m FROM bc JOIN v ON v.mouse=bc.k, range(100) c(i) WHERE i<times), q AS (SELECT rep, median(m) AS md FROM e GROUP BY 1) SELECT round(quantile_cont(md,0.025),4) AS low, round(quantile_cont(md,0.975),4) AS high FROM q")
def i10(t):
    """Weighted median per replicate from running counts of how often each was drawn, so drawn clusters are not copied."""
    v = cluster_values(t).groupBy("mouse").agg(F.round(F.median("value"), 2).alias("m"))
    c = I.bootstrap_counts(v, [], "mouse", 60, "boot")
    md = ranking.exact_median(c.join(v, "mouse"), ["rep"], "m", "md", "times")
    return I.interval(md, [], "md").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def _ratio_boot_sql(seed, reps, key, src, num, den):
    return f"{_boot_sql(seed, reps, key, src)}, v AS (SELECT {key} AS k, {num} AS a, {den} AS b FROM {src} GROUP BY 1), q AS (SELECT rep, sum(times*a)::DOUBLE/sum(times*b) AS x FROM bc JOIN v USING (k) GROUP BY 1) SELECT round(quantile_cont(x,0.025),9) AS low, round(quantile_cont(x,0.975),9) AS high FROM q"


def ratio_bootstrap(per, key, reps, seed, group=None):
    group = group or []
    c = I.bootstrap_counts(per, group, key, reps, seed)
    x = c.join(per, [*group, key]).groupBy("rep").agg((F.sum(F.col("times") * F.col("a")) / F.sum(F.col("times") * F.col("b"))).alias("x"))
    return I.interval(x, [], "x").select(r9("low").alias("low"), r9("high").alias("high"))


@query("i12_decision_bootstrap", "WITH " + _ratio_boot_sql("src", 60, "o_custkey", "orders", "count(*) FILTER (o_orderstatus='F')", "count(*)"))
def i12(t):
    per = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count("*").alias("b"))
    return ratio_bootstrap(per, "o_custkey", 60, "src")


@query("i13_weighted_accuracy_bootstrap", "WITH " + _ratio_boot_sql("acc", 60, "l_suppkey", "lineitem", "sum(CASE WHEN l_returnflag='N' THEN l_quantity ELSE 0 END)", "sum(l_quantity)"))
def i13(t):
    per = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("a"), F.sum("l_quantity").alias("b"))
    return ratio_bootstrap(per, "l_suppkey", 60, "acc")


@query("i11_stratified_bootstrap", f"WITH u AS (SELECT o_orderstatus AS g, o_custkey AS k, count(*) FILTER (o_orderpriority='5-LOW') AS a, count(*) AS b FROM orders GROUP BY 1,2), x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k)-1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM u), d AS (SELECT rep, g, {B.hash_index_sql(chr(39) + 'str:' + chr(39) + '||rep||' + chr(39) + ':' + chr(39) + '||g||' + chr(39) + ':' + chr(39) + '||idx', 'n')} AS idx FROM x, range(60) r(rep)), q AS (SELECT rep, sum(a)::DOUBLE/sum(b) AS v FROM d JOIN x USING (g, idx) GROUP BY 1) SELECT round(quantile_cont(v,0.025),9) AS low, round(quantile_cont(v,0.975),9) AS high FROM q")
def i11(t):
    per = t.orders.groupBy("o_orderstatus", "o_custkey").agg(F.count_if(F.col("o_orderpriority") == "5-LOW").alias("a"), F.count("*").alias("b"))
    return ratio_bootstrap(per, "o_custkey", 60, "str", ["o_orderstatus"])


@query("i14_unit_multiplicity_bootstrap", f"WITH {PF}, {_boot_sql('unit', 40, 'root', 'un')}, w AS (SELECT a.rep, connected, sum(a.times*b.times*orientation)/sum(a.times*b.times) AS m FROM pm JOIN bc a ON a.k=pm.pre JOIN bc b ON b.k=pm.post AND b.rep=a.rep GROUP BY 1,2), d AS (SELECT x.rep, x.m-y.m AS delta FROM w x JOIN w y ON x.rep=y.rep AND x.connected AND NOT y.connected) SELECT round(quantile_cont(delta,0.025),6) AS low, round(quantile_cont(delta,0.975),6) AS high FROM d")
def i14(t):
    """Pair weight is the product of its units' multiplicities."""
    u = units(t).select("root")
    c = I.bootstrap_counts(u, [], "root", 40, "unit")
    f = frame(t).select("pre", "post", "connected", "orientation")
    w = f.join(c.select("rep", F.col("root").alias("pre"), F.col("times").alias("ta")), "pre").join(c.select("rep", F.col("root").alias("post"), F.col("times").alias("tb")), ["rep", "post"])
    tw = F.col("ta") * F.col("tb")
    con = F.col("connected")
    mean = lambda cond: F.sum(F.when(cond, tw * F.col("orientation"))) / F.sum(F.when(cond, tw))
    d = w.groupBy("rep").agg((mean(con) - mean(~con)).alias("delta"))
    return I.interval(d, [], "delta").select(r6("low").alias("low"), r6("high").alias("high"))


@query("i23_sign_test_counts", "SELECT count(*) FILTER (d>0) AS wins, count(*) FILTER (d<0) AS losses, count(*) FILTER (d=0) AS ties FROM (SELECT o_custkey, round(avg(o_totalprice) FILTER (o_orderstatus='F'),2)-round(avg(o_totalprice) FILTER (o_orderstatus='O'),2) AS d FROM orders GROUP BY 1)")
def i23(t):
    return sign_counts(t)


def sign_counts(t):
    avg = lambda s: F.round(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    d = t.orders.groupBy("o_custkey").agg((avg("F") - avg("O")).alias("d"))
    return d.agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))


@query("i23_sign_test_p")
def i23b(t):
    s = sign_counts(t)
    top = F.greatest("wins", "losses").cast("double")
    return s.withColumn("p", F.least(F.lit(1.0), 2.0 * tails.binomial_upper_tail(top, (F.col("wins") + F.col("losses")).cast("double"))))


@query("i24_standardized_effect", "WITH a AS (SELECT p_brand, l_returnflag='R' AS treated, avg(l_quantity) AS m, var_samp(l_quantity) AS v, count(*) AS n FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2) SELECT x.p_brand AS brand, round((x.m-y.m)/sqrt(greatest(((x.n-1)*x.v+(y.n-1)*y.v)/greatest(x.n+y.n-2,1),1e-12)),9) AS effect FROM a x JOIN a y ON x.p_brand=y.p_brand AND x.treated AND NOT y.treated")
def i24(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    tr = F.col("l_returnflag") == "R"
    q = F.col("l_quantity")
    arm = lambda cond, tag: [F.avg(F.when(cond, q)).alias(f"m{tag}"), F.var_samp(F.when(cond, q)).alias(f"v{tag}"), F.count_if(cond).alias(f"n{tag}")]
    g = d.groupBy(F.col("p_brand").alias("brand")).agg(*arm(tr, 1), *arm(~tr, 0))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.greatest(F.col("n1") + F.col("n0") - 2, F.lit(1))
    return g.select("brand", r9((F.col("m1") - F.col("m0")) / F.sqrt(F.greatest(pooled, F.lit(1e-12)))).alias("effect"))


_MW = """d AS (SELECT p_brand AS g, l_quantity AS v FROM lineitem JOIN part ON p_partkey=l_partkey), c AS (SELECT v FROM d WHERE g='Brand#1'), cc AS (SELECT v, count(*) AS c FROM c GROUP BY 1), u AS (SELECT g, v, count(*) AS k FROM d WHERE g<>'Brand#1' GROUP BY 1,2),
 s AS (SELECT g, sum(k) AS n1, sum(k*((SELECT coalesce(sum(c),0) FROM cc WHERE cc.v<u.v)+coalesce((SELECT c FROM cc WHERE cc.v=u.v),0)/2.0)) AS u FROM u GROUP BY 1)"""


@query("i25_rank_sum", f"WITH {_MW}, w AS (SELECT b.g, b.v, coalesce(cc.c,0)+coalesce(u.k,0) AS t FROM (SELECT g, v FROM (SELECT DISTINCT g FROM u) CROSS JOIN (SELECT DISTINCT v FROM d)) b LEFT JOIN cc ON cc.v=b.v LEFT JOIN u ON u.g=b.g AND u.v=b.v), ti AS (SELECT g, sum(t*t*t-t) AS ties FROM w GROUP BY 1), m AS (SELECT count(*) AS m FROM c) SELECT s.g AS brand, n1::BIGINT AS n1, u::DOUBLE AS u, round((greatest(u, n1*m-u)-n1*m/2.0-0.5)/sqrt(n1*m/12.0*(n1+m+1-ties/((n1+m)*(n1+m-1.0)))),6) AS z FROM s JOIN ti USING (g) CROSS JOIN m")
def i25(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("brand"), F.col("l_quantity").alias("v"))
    return I.mann_whitney(d, "brand", "v", "Brand#1").select("brand", "n1", "u", r6("z").alias("z"))


@query("i25_adjusted_effects")
def i25b(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("brand"), F.col("l_quantity").alias("v"))
    return ranking.benjamini_hochberg(I.mann_whitney(d, "brand", "v", "Brand#1"), [], "p").select("brand", r9("p").alias("p"), r9("q").alias("q"))


@query("i26_library_normalization", "WITH c AS (SELECT l_orderkey AS cell, l_linenumber AS gene, sum(l_quantity) AS k FROM lineitem GROUP BY 1,2), b AS (SELECT cell, sum(k) AS lib FROM c GROUP BY 1) SELECT gene, round(avg(ln(1+k*1e4/lib)),9) AS mean_expression, count(*) AS cells FROM c JOIN b USING (cell) GROUP BY 1")
def i26(t):
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("gene")).agg(F.sum("l_quantity").alias("k"))
    lib = c.groupBy("cell").agg(F.sum("k").alias("lib"))
    return c.join(lib, "cell").groupBy("gene").agg(r9(F.avg(F.log1p(F.col("k") * 1e4 / F.col("lib")))).alias("mean_expression"), F.count("*").alias("cells"))


@query("i27_fold_effects", "WITH d AS (SELECT p_brand AS gene, l_returnflag='R' AS treated, l_quantity AS v, (row_number() OVER (PARTITION BY p_brand, l_returnflag='R' ORDER BY sha256('cells:'||id), id)-1)%3 AS fold FROM (SELECT *, l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||l_quantity||'-'||l_extendedprice AS id FROM lineitem) JOIN part ON p_partkey=l_partkey), e AS (SELECT gene, fold, avg(v) FILTER (treated)-avg(v) FILTER (NOT treated) AS effect FROM d GROUP BY 1,2) SELECT gene, round(avg(effect),6) AS mean_effect, bool_and(effect>0) OR bool_and(effect<0) AS consistent, count(*) AS folds FROM e GROUP BY 1")
def i27(t):
    from veriframe.operators.selection import balanced_folds

    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_brand").alias("gene"), (F.col("l_returnflag") == "R").alias("treated"), F.col("l_quantity").alias("v"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("id"))
    f = balanced_folds(d, ["gene", "treated"], F.col("id"), "cells")
    e = f.groupBy("gene", "fold").agg((F.avg(F.when(F.col("treated"), F.col("v"))) - F.avg(F.when(~F.col("treated"), F.col("v")))).alias("effect"))
    return e.groupBy("gene").agg(r6(F.avg("effect")).alias("mean_effect"), (F.bool_and(F.col("effect") > 0) | F.bool_and(F.col("effect") < 0)).alias("consistent"), F.count("*").alias("folds"))


@query("i28_ks_statistic", "WITH d AS (SELECT l_returnflag AS g, l_extendedprice AS v, l_linestatus='F' AS a FROM lineitem), c AS (SELECT g, v, sum(sum(a::INT)) OVER (PARTITION BY g ORDER BY v) AS ca, sum(sum((NOT a)::INT)) OVER (PARTITION BY g ORDER BY v) AS cb FROM d GROUP BY 1,2), n AS (SELECT g, sum(a::INT) AS na, sum((NOT a)::INT) AS nb FROM d GROUP BY 1) SELECT g, round(max(abs(ca::DOUBLE/na-cb::DOUBLE/nb)),9) AS d, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b FROM c JOIN n USING (g) GROUP BY 1")
def i28(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"), (F.col("l_linestatus") == "F").alias("a"))
    return I.ks_statistic(d, ["g"], "v", "a").withColumn("d", r9("d"))


@query("i28_ks_p_values")
def i28b(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"), (F.col("l_linestatus") == "F").alias("a"))
    return I.ks_p_value(I.ks_statistic(d, ["g"], "v", "a"))


@query("i29_energy_distance", "WITH d AS (SELECT l_quantity AS v, l_linestatus='F' AS a FROM lineitem), w AS (SELECT v, a, count(*) AS k FROM d GROUP BY 1,2), e AS (SELECT x.a AS xa, y.a AS ya, sum(x.k*y.k*abs(x.v-y.v))/sum(x.k*y.k) AS m FROM w x CROSS JOIN w y GROUP BY 1,2) SELECT round(2*(SELECT m FROM e WHERE xa AND NOT ya)-(SELECT m FROM e WHERE xa AND ya)-(SELECT m FROM e WHERE NOT xa AND NOT ya),9) AS energy")
def i29(t):
    d = t.lineitem.select(F.col("l_quantity").alias("v"), (F.col("l_linestatus") == "F").alias("a"))
    return I.mean_abs_difference(d, [], "v", "a").select(r9("energy").alias("energy"))


@query("i30_association_precondition")
def i30(t):
    """Pearson and rank association per pair with two-test correction."""
    d = t.lineitem.select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    a = d.groupBy("pair").agg(N.safe_corr(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n")).join(I.spearman(d, ["pair"], "x", "y"), "pair")
    stat = lambda c: F.col(c) * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col(c) * F.col(c), F.lit(1e-300)))
    a = a.withColumn("p_r", tails.t_two_sided(stat("r"), (F.col("n") - 2).cast("double"))).withColumn("p_rho", tails.t_two_sided(stat("rho"), (F.col("n") - 2).cast("double")))
    ok = lambda s, p: (F.abs(F.col(s)) >= 0.1) & (F.least(F.lit(1.0), 2 * F.col(p)) < 0.01)
    return a.withColumn("established", (F.col("n") >= 20) & (ok("r", "p_r") | ok("rho", "p_rho")))


def contrast(t):
    d = t.lineitem
    tr = F.col("l_returnflag") == "R"
    q = F.col("l_quantity")
    g = d.groupBy(F.col("l_suppkey").alias("pair")).agg(
        F.avg(F.when(tr, q)).alias("m1"), F.var_samp(F.when(tr, q)).alias("v1"), F.count_if(tr).alias("n1"), F.avg(F.when(~tr, q)).alias("m0"), F.var_samp(F.when(~tr, q)).alias("v0"), F.count_if(~tr).alias("n0"))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return g.withColumn("effect", F.col("m1") - F.col("m0")).withColumn("t", F.col("effect") / F.sqrt(a + b)).withColumn("dof", (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)))


@query("i31_welch_contrast", "WITH g AS (SELECT l_suppkey AS pair, avg(l_quantity) FILTER (l_returnflag='R') AS m1, var_samp(l_quantity) FILTER (l_returnflag='R') AS v1, count(*) FILTER (l_returnflag='R') AS n1, avg(l_quantity) FILTER (l_returnflag<>'R') AS m0, var_samp(l_quantity) FILTER (l_returnflag<>'R') AS v0, count(*) FILTER (l_returnflag<>'R') AS n0 FROM lineitem GROUP BY 1) SELECT pair, round(m1-m0,9) AS effect, round((m1-m0)/sqrt(v1/n1+v0/n0),6) AS t, round(pow(v1/n1+v0/n0,2)/(pow(v1/n1,2)/(n1-1)+pow(v0/n0,2)/(n0-1)),4) AS dof FROM g")
def i31(t):
    return contrast(t).select("pair", r9("effect").alias("effect"), r6("t").alias("t"), F.round("dof", 4).alias("dof"))


@query("i32_assumption_routing", "WITH a AS (SELECT s_suppkey AS pair, s_acctbal>0 AS conf, s_nationkey%2=0 AS sel, s_nationkey%5=0 AS err, s_nationkey%7=0 AS rnd, s_nationkey%3=0 AS lin, s_nationkey%3=1 AS ad FROM supplier), b AS (SELECT *, concat_ws('|', CASE WHEN NOT conf THEN 'hidden_confounding_not_excluded' END, CASE WHEN NOT sel THEN 'selection_bias_not_excluded' END, CASE WHEN err THEN 'material_measurement_error' END) AS bl FROM a) SELECT CASE WHEN rnd THEN 'controlled_intervention_contrast' WHEN bl<>'' THEN 'abstain' WHEN lin THEN 'linear_non_gaussian' WHEN ad THEN 'additive_noise' ELSE 'abstain' END AS method, CASE WHEN rnd THEN '' WHEN bl='' AND NOT lin AND NOT ad THEN 'no_declared_method_matches_assumptions' ELSE bl END AS blockers, count(*) AS n FROM b GROUP BY 1,2")
def i32(t):
    k = F.col("s_nationkey")
    return route(t.supplier.select(
        F.col("s_suppkey").alias("pair"), (F.col("s_acctbal") > 0).alias("hidden_confounding_excluded"), (k % 2 == 0).alias("selection_bias_excluded"), (k % 5 == 0).alias("material_measurement_error"),
        (k % 7 == 0).alias("randomized_intervention"), (k % 3 == 0).alias("linear_non_gaussian_acyclic"), (k % 3 == 1).alias("additive_noise_acyclic"))).groupBy("method", "blockers").agg(F.count("*").alias("n"))


def route(a):
    """Method chosen by declared assumptions; blockers force abstention unless randomized."""
    b = F.array_compact(F.array(
        F.when(~F.col("hidden_confounding_excluded"), F.lit("hidden_confounding_not_excluded")), F.when(~F.col("selection_bias_excluded"), F.lit("selection_bias_not_excluded")),
        F.when(F.col("material_measurement_error"), F.lit("material_measurement_error"))))
    blocked = F.size(b) > 0
    rnd, lin, add = F.col("randomized_intervention"), F.col("linear_non_gaussian_acyclic"), F.col("additive_noise_acyclic")
    method = F.when(rnd, "controlled_intervention_contrast").when(blocked, "abstain").when(lin, "linear_non_gaussian").when(add, "additive_noise").otherwise("abstain")
    none = ~rnd & ~blocked & ~lin & ~add
    return a.withColumn("method", method).withColumn("blockers", F.when(rnd, "").when(none, "no_declared_method_matches_assumptions").otherwise(F.array_join(b, "|")))


def pair_data(t):
    return t.lineitem.select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


def standardized(d):
    m = d.groupBy("pair").agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"))
    z = lambda c, mu, s: F.when(F.col(s) == 0, 0.0).otherwise((F.col(c) - F.col(mu)) / F.col(s))
    return d.join(m, "pair").select("pair", z("x", "mx", "sx").alias("x"), z("y", "my", "sy").alias("y"))


def power_sums(z):
    x, y = F.col("x"), F.col("y")
    up = lambda c, k: F.lit(1.0) if k == 0 else F.pow(c, F.lit(k))
    return z.groupBy("pair").agg(
        F.array(*[F.sum(up(x, k)) for k in range(7)]).alias("sx"), F.array(*[F.sum(up(y, k)) for k in range(7)]).alias("sy"),
        F.array(*[F.sum(y * up(x, k)) for k in range(4)]).alias("cyx"), F.array(*[F.sum(x * up(y, k)) for k in range(4)]).alias("cxy"))


@query("i33_direction_scores")
def i33(t):
    """Polynomial, slope and residual-dependence votes per pair; fits use power sums only."""
    import pandas as pd

    from veriframe.functions.solve import poly_error, poly_fit
    from veriframe.operators.timeseries import igci_slopes

    z = standardized(pair_data(t))

    def fit(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n = r.sx[0]
                fwd = min(poly_error(r.sx, r.cyx, r.sy[2], n, d) for d in (1, 2, 3))
                bwd = min(poly_error(r.sy, r.cxy, r.sx[2], n, d) for d in (1, 2, 3))
                f1, b1 = poly_fit(r.sx, r.cyx, 1), poly_fit(r.sy, r.cxy, 1)
                rows.append((r.pair, fwd, bwd, f1[0], f1[1], b1[0], b1[1]))
            yield pd.DataFrame(rows, columns=["pair", "anm_f", "anm_b", "f0", "f1", "b0", "b1"])

    m = power_sums(z).mapInPandas(fit, "pair bigint, anm_f double, anm_b double, f0 double, f1 double, b0 double, b1 double")
    res = z.join(m, "pair").withColumn("rf", F.col("y") - F.col("f0") - F.col("f1") * F.col("x")).withColumn("rb", F.col("x") - F.col("b0") - F.col("b1") * F.col("y"))
    dep = lambda s, r: F.greatest(*[F.abs(N.safe_corr(F.pow(F.col(s), F.lit(i)), F.pow(F.col(r), F.lit(j)))) for i in (1, 2) for j in (1, 2)])
    lin = res.groupBy("pair", "anm_f", "anm_b").agg(dep("x", "rf").alias("lin_f"), dep("y", "rb").alias("lin_b"))
    ig = igci_slopes(pair_data(t), ["pair"], "x", "y", []).select("pair", F.col("slope_score").alias("ig_f"))
    back = igci_slopes(pair_data(t).select("pair", F.col("y").alias("x"), F.col("x").alias("y")), ["pair"], "x", "y", []).select("pair", F.col("slope_score").alias("ig_b"))
    d = lin.join(ig, "pair").join(back, "pair")
    vote = lambda f, b: F.when(F.abs(F.col(b) - F.col(f)) < 0.02, "uncertain").when(F.col(f) < F.col(b), "forward").otherwise("backward")
    d = d.withColumn("anm", vote("anm_f", "anm_b")).withColumn("igci", vote("ig_f", "ig_b")).withColumn("lingam", vote("lin_f", "lin_b"))
    votes = F.array("anm", "igci", "lingam")
    n = lambda v: F.size(F.filter(votes, lambda e: e == v))
    strong = lambda name, f, b: (F.col(name) != "uncertain") & (F.abs(F.col(b) - F.col(f)) >= 0.12)
    out = (F.when(n("forward") >= 2, "forward").when(n("backward") >= 2, "backward").when(strong("anm", "anm_f", "anm_b"), F.col("anm"))
           .when(strong("igci", "ig_f", "ig_b"), F.col("igci")).when(strong("lingam", "lin_f", "lin_b"), F.col("lingam")).otherwise("uncertain"))
    return d.select("pair", "anm", "igci", "lingam", out.alias("direction"), r6("anm_f").alias("anm_forward_error"), r6("lin_f").alias("linear_forward_dependence"))


@query("i34_residual_dependence", "WITH z AS (SELECT l_suppkey AS pair, (l_quantity-avg(l_quantity) OVER w)/stddev_pop(l_quantity) OVER w AS x, (l_extendedprice-avg(l_extendedprice) OVER w)/stddev_pop(l_extendedprice) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)), b AS (SELECT pair, corr(x,y) AS b FROM z GROUP BY 1), r AS (SELECT pair, x, y-b*x AS e FROM z JOIN b USING (pair)) SELECT pair, round(greatest(abs(corr(x,e)),abs(corr(x,e*e)),abs(corr(x*x,e)),abs(corr(x*x,e*e))),6) AS dependence FROM r GROUP BY 1")
def i34(t):
    z = standardized(pair_data(t))
    b = z.groupBy("pair").agg(N.corr(F.col("x"), F.col("y")).alias("b"))
    r = z.join(b, "pair").withColumn("e", F.col("y") - F.col("b") * F.col("x"))
    c = [F.abs(N.safe_corr(F.pow("x", F.lit(i)), F.pow("e", F.lit(j)))) for i in (1, 2) for j in (1, 2)]
    return r.groupBy("pair").agg(r6(F.greatest(*c)).alias("dependence"))


@query("j21_leave_one_group_out", "WITH c AS (SELECT c_nationkey AS mouse, o_orderpriority AS cell, sum(o_totalprice) AS s, count(*) AS n FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1,2) SELECT a.mouse, a.cell, round(sum(b.s)/sum(b.n),4) AS reference FROM c a JOIN c b ON a.cell=b.cell AND a.mouse<>b.mouse GROUP BY 1,2")
def j21(t):
    """Mean of all other groups as total minus own, per cell."""
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    own = d.groupBy(F.col("c_nationkey").alias("mouse"), F.col("o_orderpriority").alias("cell")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    tot = own.groupBy("cell").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return own.join(tot, "cell").select("mouse", "cell", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 4).alias("reference"))


@query("j22_leave_one_group_out_median", "WITH c AS (SELECT c_nationkey AS mouse, o_orderpriority AS cell, round(avg(o_totalprice),2) AS v FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1,2) SELECT a.mouse, a.cell, round(median(b.v),4) AS reference FROM c a JOIN c b ON a.cell=b.cell AND a.mouse<>b.mouse GROUP BY 1,2")
def j22(t):
    """Median of the others by position: removing one value shifts the middle ranks by at most one."""
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    own = d.groupBy(F.col("c_nationkey").alias("mouse"), F.col("o_orderpriority").alias("cell")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    r = ranking.value_rank(own, ["cell"], F.col("v"), [F.col("mouse")])
    m = F.col("n") - 1  # values left
    at = lambda k: F.when(k < F.col("rn"), k).otherwise(k + 1)
    want = r.select("mouse", "cell", at(F.floor((m + 1) / 2)).alias("lo"), at(F.floor(m / 2) + 1).alias("hi"))
    pos = r.select("cell", F.col("rn").alias("lo"), F.col("v").alias("vlo"))
    pos2 = r.select("cell", F.col("rn").alias("hi"), F.col("v").alias("vhi"))
    return want.join(pos, ["cell", "lo"]).join(pos2, ["cell", "hi"]).select("mouse", "cell", F.round((F.col("vlo") + F.col("vhi")) / 2, 4).alias("reference"))


@query("i01_zero_guarded_correlation", "SELECT l_suppkey, round(CASE WHEN stddev_pop(l_quantity)=0 OR stddev_pop(l_tax)=0 THEN 0 ELSE corr(l_quantity,l_tax) END,9) AS r FROM lineitem GROUP BY 1")
def i01(t):
    return t.lineitem.groupBy("l_suppkey").agg(r9(N.safe_corr(F.col("l_quantity"), F.col("l_tax"))).alias("r"))


@query("i05_cell_agreement", "WITH c AS (SELECT c_nationkey AS m, o_orderpriority AS cell, avg(o_totalprice)>250000 AS s FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1,2) SELECT a.m AS mouse, round(avg((a.s=b.s)::INT),9) AS agreement FROM c a JOIN c b ON a.cell=b.cell AND b.m=(a.m+1)%25 GROUP BY 1")
def i05(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    c = d.groupBy(F.col("c_nationkey").alias("mouse"), F.col("o_orderpriority").alias("cell")).agg((F.avg("o_totalprice") > 250000).alias("s"))
    b = c.select(((F.col("mouse") + 24) % 25).alias("mouse"), "cell", F.col("s").alias("s2"))
    return c.join(b, ["mouse", "cell"]).groupBy("mouse").agg(r9(F.avg((F.col("s") == F.col("s2")).cast("int"))).alias("agreement"))


@query("i04_kendall_tau", "WITH c AS (SELECT c_nationkey AS m, o_orderpriority AS k, round(avg(o_totalprice)) AS x, count(*) AS y FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1,2), p AS (SELECT a.m, sign(a.x-b.x)*sign(a.y-b.y) AS s, (a.x=b.x)::INT AS tx, (a.y=b.y)::INT AS ty FROM c a JOIN c b ON a.m=b.m AND a.k<b.k) SELECT m AS mouse, round(coalesce(sum(s)/nullif(sqrt((count(*)-sum(tx))*(count(*)-sum(ty))),0),0),9) AS tau FROM p GROUP BY 1")
def i04(t):
    """Tie-corrected rank agreement over the few cells of each group (cells are a fixed vocabulary, held as one short array)."""
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    c = d.groupBy(F.col("c_nationkey").alias("mouse"), F.col("o_orderpriority").alias("k")).agg(F.round(F.avg("o_totalprice")).alias("x"), F.count("*").cast("double").alias("y"))
    g = c.groupBy("mouse").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("v"))
    later = F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["k"] > a["k"]), lambda b: F.struct(
        (F.signum(a["x"] - b["x"]) * F.signum(a["y"] - b["y"])).alias("s"), (a["x"] == b["x"]).cast("double").alias("tx"), (a["y"] == b["y"]).cast("double").alias("ty"))))
    p = F.flatten(later)
    total = lambda f: F.aggregate(p, F.lit(0.0), lambda acc, e: acc + e[f])
    n = F.size(p)
    den = F.sqrt((n - total("tx")) * (n - total("ty")))
    return g.select("mouse", r9(F.when(den == 0, 0.0).otherwise(total("s") / den)).alias("tau"))
