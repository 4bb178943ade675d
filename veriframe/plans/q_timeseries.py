"""Queries on event-aligned extraction, trajectories and region graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import numeric as N
from veriframe.operators import graph, ranking, selection
from veriframe.operators import timeseries as TS
from veriframe.plans.registry import query
from veriframe.session import cut

r6 = lambda c: F.round(c, 6)
r9 = lambda c: F.round(c, 9)
EPOCH = 1704067200000000  # Fixed value: 2024-01-01 in microseconds.


def spikes(t):
    """Events as spikes: session from the user's decade, unit = user, region = event type, t in seconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select((F.col("user_id") % 10).alias("session"), F.col("user_id").alias("unit"), F.col("event_type").alias("region"), ((us - EPOCH) / 1e6).alias("t"), "value", "event_id")


def change_events(t):
    e = spikes(t).filter("region = 'error'").select("session", "event_id", F.col("t").alias("at"))
    return ranking.value_rank(e, ["session"], F.col("at"), [F.col("event_id")]).select("session", "event_id", "at", (F.col("rn") - 1).alias("ordinal"))


SP = f"sp AS (SELECT user_id%10 AS session, user_id AS unit, event_type AS region, (epoch_us(ts)-{EPOCH})/1e6 AS t, value, event_id FROM events)"
CE = SP + ", ce AS (SELECT session, event_id, t AS at, row_number() OVER (PARTITION BY session ORDER BY t, event_id)-1 AS ordinal FROM sp WHERE region='error')"
UN = "un AS (SELECT session, region, count(DISTINCT unit) AS units FROM sp GROUP BY 1,2)"
W_ = 7200.0


@query("j13_spike_windows", f"WITH {CE} SELECT c.session, c.event_id, s.region, s.unit, count(*) FILTER (s.t>=c.at) AS n_response, count(*) FILTER (s.t<c.at) AS n_baseline FROM ce c JOIN sp s ON s.session=c.session AND s.t>=c.at-{W_} AND s.t<c.at+{W_} GROUP BY ALL")
def j13(t):
    events = spikes(t).filter("region = 'error'").select("session", "event_id", F.col("t").alias("at"))
    return TS.event_windows(spikes(t), events, ["session"], W_).select("session", "event_id", "region", "unit", "n_response", "n_baseline")


@query("e02_change_profile", f"""WITH {CE}, {UN}, w AS (SELECT c.session, c.ordinal, s.region, sum(CASE WHEN s.t>=c.at THEN 1 ELSE -1 END) AS d FROM ce c JOIN sp s ON s.session=c.session AND s.t>=c.at-{W_} AND s.t<c.at+{W_} GROUP BY 1,2,3),
 n AS (SELECT session, count(*) AS n, count(*) FILTER (ordinal%2=0) AS n0, count(*) FILTER (ordinal%2=1) AS n1 FROM ce GROUP BY 1)
 SELECT un.session, un.region, n.n AS events, round(coalesce(sum(d),0)/n.n/(units*{W_}),9) AS response_hz, round(coalesce(sum(d) FILTER (ordinal%2=0),0)/n0/(units*{W_}),9) AS odd_hz, round(coalesce(sum(d) FILTER (ordinal%2=1),0)/n1/(units*{W_}),9) AS even_hz
 FROM un JOIN n USING (session) LEFT JOIN w ON w.session=un.session AND w.region=un.region GROUP BY un.session, un.region, units, n.n, n0, n1""")
def e02(t):
    d = TS.change_profile(spikes(t), change_events(t), ["session"], W_)
    return d.select("session", "region", "events", *[r9(c).alias(c) for c in ("response_hz", "odd_hz", "even_hz")])


_TC = f"""WITH {CE}, {UN}, h AS (SELECT c.session, s.region, least(floor((s.t-(c.at-3600.0))/900.0),11)::BIGINT AS bin, ordinal FROM ce c JOIN sp s ON s.session=c.session AND s.t>=c.at-3600.0 AND s.t<c.at+7200.0),
 n AS (SELECT session, count(*) AS n, count(*) FILTER (ordinal%2=0) AS n0, count(*) FILTER (ordinal%2=1) AS n1 FROM ce GROUP BY 1),
 tc AS (SELECT un.session, un.region, b.bin, (-3600.0+(b.bin+0.5)*900.0)::DOUBLE AS time, count(h.bin)/n.n/(units*900.0) AS hz, count(h.bin) FILTER (ordinal%2=0)/n0/(units*900.0) AS odd_hz, count(h.bin) FILTER (ordinal%2=1)/n1/(units*900.0) AS even_hz
  FROM un JOIN n USING (session) CROSS JOIN range(12) b(bin) LEFT JOIN h ON h.session=un.session AND h.region=un.region AND h.bin=b.bin GROUP BY un.session, un.region, b.bin, units, n.n, n0, n1)"""


def timecourse(t):
    return TS.change_timecourse(spikes(t), cut(change_events(t)), ["session"], -3600.0, 7200.0, 900.0)


@query("e03_change_timecourse", _TC + " SELECT session, region, bin, round(time,6) AS time, round(hz,9) AS hz, round(odd_hz,9) AS odd_hz, round(even_hz,9) AS even_hz FROM tc")
def e03(t):
    return timecourse(t).select("session", "region", "bin", r6("time").alias("time"), *[r9(c).alias(c) for c in ("hz", "odd_hz", "even_hz")])


@query("j14_event_bins", _TC + " SELECT bin, sum(c)::BIGINT AS n FROM (SELECT h.bin, count(*) AS c FROM h GROUP BY 1) GROUP BY 1")
def j14(t):
    iv = change_events(t).withColumn("w0", F.col("at") - 3600.0).withColumn("w1", F.col("at") + 7200.0)
    hit = TS.interval_join(spikes(t), iv, ["session"], "t", "w0", "w1", 10800.0)
    return hit.groupBy(F.least(F.floor((F.col("t") - F.col("w0")) / 900.0), F.lit(11)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def weekly_intervals(t):
    s = spikes(t)
    return s.groupBy("session", F.floor(F.col("t") / 604800.0).alias("week")).agg(F.min("t").alias("start"), F.max("t").alias("stop"))


_BR = f"""WITH {SP}, {UN}, iv AS (SELECT session, floor(t/604800.0) AS week, min(t) AS start, max(t) AS stop FROM sp GROUP BY 1,2),
 best AS (SELECT session, start, stop, ceil(round((stop-start)/21600.0,9))::BIGINT AS bins FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY stop-start DESC, start) AS rn FROM iv) WHERE rn=1),
 c AS (SELECT sp.session, region, least(floor((t-start)/21600.0)::BIGINT, bins-1) AS bin, count(*) AS n FROM sp JOIN best USING (session) WHERE t>=start AND t<=stop GROUP BY 1,2,3),
 br AS (SELECT s.session, s.region, s.bin, (start+s.bin*21600.0+least(start+(s.bin+1)*21600.0,stop))/2-start AS time, coalesce(n,0)/(units*(least(start+(s.bin+1)*21600.0,stop)-(start+s.bin*21600.0))) AS hz
  FROM (SELECT un.session, un.region, units, start, stop, unnest(range(bins)) AS bin FROM un JOIN best USING (session)) s LEFT JOIN c ON c.session=s.session AND c.region=s.region AND c.bin=s.bin)"""


def rates(t):
    return TS.binned_rates(spikes(t), weekly_intervals(t), ["session"], 21600.0)


@query("e01_binned_rates", _BR + " SELECT session, region, bin, round(time,4) AS time, round(hz,9) AS hz FROM br")
def e01(t):
    return rates(t).select("session", "region", "bin", F.round("time", 4).alias("time"), r9("hz").alias("hz"))


@query("i02_functional_connectivity", _BR + " SELECT a.session, a.region AS r1, b.region AS r2, round(CASE WHEN stddev_pop(a.hz)=0 OR stddev_pop(b.hz)=0 THEN 0 ELSE corr(a.hz,b.hz) END,6) AS fc FROM br a JOIN br b ON a.session=b.session AND a.bin=b.bin AND a.region<b.region GROUP BY 1,2,3")
def i02(t):
    tc = rates(t).select("session", "region", F.col("bin").alias("time"), F.col("hz").alias("x"))
    return TS.functional_connectivity(tc, ["session"]).withColumn("fc", r6("fc"))


@query("i03_fc_similarity", _BR + """, fc AS (SELECT a.session, a.region AS r1, b.region AS r2, corr(a.hz,b.hz) AS fc FROM br a JOIN br b ON a.session=b.session AND a.bin=b.bin AND a.region<b.region GROUP BY 1,2,3)
 SELECT x.session, round(corr(x.fc, y.fc),6) AS similarity FROM fc x JOIN fc y ON x.r1=y.r1 AND x.r2=y.r2 AND y.session=(x.session+1)%10 GROUP BY 1""")
def i03(t):
    """Similarity of each session's correlation pattern with the next session's."""
    tc = rates(t).select("session", "region", F.col("bin").alias("time"), F.col("hz").alias("x"))
    fc = TS.functional_connectivity(tc, ["session"])
    other = fc.select(((F.col("session") + 9) % 10).alias("session"), "r1", "r2", F.col("fc").alias("fc2"))
    return fc.join(other, ["session", "r1", "r2"]).groupBy("session").agg(r6(N.safe_corr(F.col("fc"), F.col("fc2"))).alias("similarity"))


def tc_x(t):
    return timecourse(t).select("session", "region", "time", F.col("hz").alias("x"))


_BS = _TC + ", bs AS (SELECT session, region, bin, time, hz - avg(hz) FILTER (time<0) OVER (PARTITION BY session, region) AS x FROM tc)"
K2 = ["session", "region"]


@query("w14_baseline_subtraction", _BS + " SELECT session, region, round(time,6) AS time, round(x*1e6,4) AS x FROM bs")
def w14(t):
    d = TS.baseline_subtract(tc_x(t), K2)
    return d.select("session", "region", r6("time").alias("time"), F.round(F.col("x") * 1e6, 4).alias("x"))


@query("w15_peak_normalization", _BS + " SELECT session, region, round(time,6) AS time, round(CASE WHEN m>0 THEN x/m ELSE 0 END,6) AS x FROM (SELECT *, max(abs(x)) OVER (PARTITION BY session, region) AS m FROM bs)")
def w15(t):
    d = TS.peak_normalize(TS.baseline_subtract(tc_x(t), K2), K2)
    return d.select("session", "region", r6("time").alias("time"), r6("x").alias("x"))


@query("w13_temporal_derivative", _BS + " SELECT session, region, round(time,6) AS time, round(coalesce(x-lag(x) OVER (PARTITION BY session, region ORDER BY time),0)*1e6,4) AS x FROM bs")
def w13(t):
    d = TS.derivative(TS.baseline_subtract(tc_x(t), K2), K2)
    return d.select("session", "region", r6("time").alias("time"), F.round(F.col("x") * 1e6, 4).alias("x"))


@query("w16_autocorrelation", _BR + " SELECT session, region, round(CASE WHEN stddev_pop(hz)=0 OR stddev_pop(p)=0 THEN 0 ELSE corr(p,hz) END,6) AS r FROM (SELECT *, lag(hz,2) OVER (PARTITION BY session, region ORDER BY bin) AS p FROM br) WHERE p IS NOT NULL GROUP BY 1,2")
def w16(t):
    tc = rates(t).select("session", "region", F.col("bin").alias("time"), F.col("hz").alias("x"))
    return TS.autocorrelation(tc, K2, 2).withColumn("r", r6("r"))


@query("w17_first_crossing", _BR + ", th AS (SELECT session, region, avg(hz)+1.5*stddev_pop(hz) AS thr FROM br WHERE bin<8 GROUP BY 1,2) SELECT session, region, min(CASE WHEN bin>=8 AND hz>thr+1e-12 THEN bin-8 END)::DOUBLE AS latency FROM br JOIN th USING (session, region) GROUP BY 1,2")
def w17(t):
    tc = rates(t).select("session", "region", F.col("bin").cast("double").alias("time"), (F.col("hz") - 1e-12).alias("x"))
    base = tc.withColumn("x", F.when(F.col("time") < 8, F.col("x") + 1e-12).otherwise(F.col("x")))
    return TS.first_crossing(base, K2, 8.0, 1.5)


@query("w18_peak_latency", _TC + " SELECT session, region, round(time,6) AS latency FROM (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY round(hz,12) DESC, time) AS rn FROM tc WHERE time>0 AND time<=7200) WHERE rn=1")
def w18(t):
    tc = tc_x(t).withColumn("x", F.round("x", 12))
    return TS.peak_latency(tc, K2, 7200.0).withColumn("latency", r6("latency"))


@query("w19_lead_lag", _TC + """, p AS (SELECT session, region, hz AS x, row_number() OVER (PARTITION BY session, region ORDER BY time) AS s FROM tc WHERE time>0 AND time<=7200),
 sc AS (SELECT a.session, a.region AS l, b.region AS r, lag, CASE WHEN count(*)<3 OR stddev_pop(a.x)=0 OR stddev_pop(b.x)=0 THEN NULL ELSE round(corr(a.x,b.x),9) END AS score
  FROM p a CROSS JOIN (SELECT unnest(range(-2,3)) AS lag) g JOIN p b ON b.session=a.session AND b.s=a.s+lag AND a.region<b.region GROUP BY 1,2,3,4)
 SELECT session, l AS left, r AS right, CASE WHEN max(score) IS NULL THEN 0 ELSE sign(first(lag ORDER BY coalesce(score,-2) DESC, lag)) END::BIGINT AS sign FROM sc GROUP BY 1,2,3""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def w19(t):
    return TS.lead_lag(tc_x(t), ["session"], 7200.0, 2)


@query("e04_evoked_amplitude", _TC + " SELECT session, region, round((avg(hz) FILTER (time>=0 AND time<3600) - avg(hz) FILTER (time<0))*1e6,4) AS amplitude FROM tc GROUP BY 1,2")
def e04(t):
    d = TS.evoked_amplitude(tc_x(t), K2, 0.0, 3600.0)
    return d.withColumn("amplitude", F.round(F.col("amplitude") * 1e6, 4))


@query("e05_power_spectrum", _TC + """, c AS (SELECT session, region, bin, hz-avg(hz) OVER (PARTITION BY session, region) AS x FROM tc)
 SELECT session, region, k, round(k/(12*900.0)*1e6,3) AS frequency, round((pow(sum(x*cos(2*pi()*k*bin/12)),2)+pow(sum(x*sin(2*pi()*k*bin/12)),2))/12*1e12,3) AS power FROM c CROSS JOIN range(7) r(k) GROUP BY 1,2,3""")
def e05(t):
    d = TS.power_spectrum(tc_x(t), K2, 900.0)
    return d.select("session", "region", "k", F.round(F.col("frequency") * 1e6, 3).alias("frequency"), F.round(F.col("power") * 1e12, 3).alias("power"))


def two_runs(t):
    """Odd-event and even-event timecourses as baseline and perturbed trajectories."""
    return timecourse(t).select("session", "region", "time", F.col("odd_hz").alias("a"), F.col("even_hz").alias("b"))


@query("e06_trajectory_change", _TC + " SELECT session, region, round((avg(even_hz)-avg(odd_hz))*1e6,4) AS mean_change, round(avg(abs(even_hz-odd_hz))*1e6,4) AS mean_difference, abs(avg(even_hz)-avg(odd_hz))>0.000002 AS affected FROM tc GROUP BY 1,2")
def e06(t):
    change = F.avg("b") - F.avg("a")
    return two_runs(t).groupBy("session", "region").agg(
        F.round(change * 1e6, 4).alias("mean_change"), F.round(F.avg(F.abs(F.col("b") - F.col("a"))) * 1e6, 4).alias("mean_difference"), (F.abs(change) > 0.000002).alias("affected"))


@query("w20_recovery_time", _TC + """, d AS (SELECT session, time, round(avg(abs(even_hz-odd_hz))*1e6,4) AS x FROM tc GROUP BY 1,2)
 SELECT d.session, round(min(d.time) FILTER (d.time>=0 AND NOT EXISTS (SELECT 1 FROM d e WHERE e.session=d.session AND e.time>=d.time AND e.x>1.6)),6) AS recovery FROM d GROUP BY 1""")
def w20(t):
    d = two_runs(t).groupBy("session", "time").agg(F.round(F.avg(F.abs(F.col("b") - F.col("a"))) * 1e6, 4).alias("x"))
    return TS.recovery_time(d, ["session"], 0.0, 1.6).withColumn("recovery", r6("recovery"))


@query("j15_trial_means", """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS frame, value FROM events), tr AS (SELECT user_id, k AS trial, k*10 AS start, k*10+7 AS stop FROM (SELECT user_id, count(*) AS n FROM f GROUP BY 1) CROSS JOIN range(100000) r(k) WHERE k <= n//10)
 SELECT tr.user_id, trial, round(avg(value),6) AS mean FROM tr LEFT JOIN f ON f.user_id=tr.user_id AND frame>=start AND frame<stop GROUP BY 1,2""")
def j15(t):
    e = t.events.select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    f = ranking.value_rank(e, ["user_id"], F.col("us"), [F.col("event_id")]).select("user_id", (F.col("rn") - 1).alias("frame"), "value")
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    trials = n.select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / 10))).alias("trial"))
    trials = trials.withColumn("start", F.col("trial") * 10).withColumn("stop", F.col("trial") * 10 + 7)
    return TS.mean_in_intervals(f, trials, ["user_id"], 10.0).withColumn("mean", r6("mean"))


@query("w12_igci_slopes", """WITH d AS (SELECT l_suppkey AS pair, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT pair, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM d GROUP BY 1),
 l AS (SELECT pair, x-lag(x) OVER w AS dx, y-lag(y) OVER w AS dy FROM d WINDOW w AS (PARTITION BY pair ORDER BY x, y))
 SELECT pair, round(avg(ln(abs((dy/sy)/(dx/sx))+1e-12)),6) AS slope_score, count(*) AS steps FROM l JOIN m USING (pair) WHERE abs(dx/sx)>1e-9 GROUP BY 1""")
def w12(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return TS.igci_slopes(d, ["pair"], "x", "y", []).withColumn("slope_score", r6("slope_score"))


# ---- region graphs -------------------------------------------------------------

def flow(t):
    """Directed weights between nations: customer nation -> supplier nation, by revenue share."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("source_id"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("target_id"))
    l = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity")
    return l.join(o, l.l_orderkey == o.o_orderkey).join(s, l.l_suppkey == s.s_suppkey).groupBy("source_id", "target_id").agg(F.sum("l_quantity").alias("weight")).filter("source_id <> target_id")


FL = """fl AS (SELECT c_nationkey AS source_id, s_nationkey AS target_id, sum(l_quantity) AS weight FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey JOIN supplier ON s_suppkey=l_suppkey WHERE c_nationkey<>s_nationkey GROUP BY 1,2),
 big AS (SELECT source_id, target_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS rn FROM fl) WHERE rn<=3)"""


def big_edges(t):
    """The three heaviest outgoing flows of each region; at most one row per region pair enters the window."""
    from pyspark.sql import Window as W

    w = W.partitionBy("source_id").orderBy(F.desc("weight"), "target_id")
    return flow(t).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn")


@query("n03_thresholded_edges", f"WITH {FL} SELECT source_id, target_id, weight FROM fl WHERE weight>(SELECT avg(weight) FROM fl)")
def n03(t):
    f = flow(t)
    cut = f.agg(F.avg("weight").alias("thr")).withColumn("_one", F.lit(1))
    return f.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one").filter("weight > thr").select("source_id", "target_id", "weight")


@query("n04_weight_normalization", f"WITH {FL} SELECT source_id, target_id, round(weight/sum(weight) OVER (PARTITION BY target_id),9) AS row_sum, round(weight/sum(weight) OVER (PARTITION BY source_id),9) AS column_sum FROM fl")
def n04(t):
    a = graph.normalize_weights(flow(t), "row_sum").select("source_id", "target_id", r9("weight").alias("row_sum"))
    b = graph.normalize_weights(flow(t), "column_sum").select("source_id", "target_id", r9("weight").alias("column_sum"))
    return a.join(b, ["source_id", "target_id"])


@query("n05_density", f"WITH {FL} SELECT round(count(*)/(25*25-25)::DOUBLE,9) AS density FROM big")
def n05(t):
    n = t.nation.agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    e = big_edges(t).filter("weight <> 0").agg(F.count("*").alias("e")).withColumn("_one", F.lit(1))
    return e.join(n, "_one").select(r9(F.col("e") / (F.col("n") * F.col("n") - F.col("n"))).alias("density"))


@query("n06_degrees", f"WITH {FL} SELECT n_nationkey::BIGINT AS id, (SELECT count(*) FROM big WHERE target_id=n_nationkey) AS in_degree, (SELECT count(*) FROM big WHERE source_id=n_nationkey) AS out_degree FROM nation")
def n06(t):
    e = big_edges(t)
    ends = e.select(F.inline(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return t.nation.select(F.col("n_nationkey").alias("id")).join(d, "id", "left").na.fill(0, ["in_degree", "out_degree"]).withColumn("id", F.col("id").cast("bigint"))


@query("n07_strength", f"WITH {FL} SELECT id::BIGINT AS id, sum(i) AS in_strength, sum(o) AS out_strength FROM (SELECT target_id AS id, weight AS i, 0 AS o FROM fl UNION ALL SELECT source_id, 0, weight FROM fl) GROUP BY 1")
def n07(t):
    ends = flow(t).select(F.inline(F.array(F.struct(F.col("target_id").alias("id"), F.col("weight").alias("i"), F.lit(0.0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0.0).alias("i"), F.col("weight").alias("o")))))
    return ends.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.sum("i").alias("in_strength"), F.sum("o").alias("out_strength"))


_HOPS = f"WITH RECURSIVE {FL}, h AS (SELECT n_nationkey AS source, n_nationkey AS node, 0 AS hops FROM nation UNION SELECT h.source, big.target_id, h.hops+1 FROM h JOIN big ON big.source_id=h.node WHERE h.hops<24), d AS (SELECT source, node, min(hops) AS hops FROM h GROUP BY 1,2)"


@query("n08_shortest_paths", _HOPS + " SELECT round(avg(hops),9) AS mean_finite_path_length, count(*)::DOUBLE AS reachable_pairs FROM d WHERE source<>node")
def n08(t):
    d = graph.path_lengths(big_edges(t), t.nation.select(F.col("n_nationkey").alias("node")))
    total = F.coalesce(F.sum("pairs"), F.lit(0))
    return d.agg(r9(F.coalesce(F.try_divide(F.sum(F.col("hops") * F.col("pairs")), total), F.lit(0.0))).alias("mean_finite_path_length"), total.cast("double").alias("reachable_pairs"))


_PART_STEPS = "e AS (SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON b.l_orderkey=a.l_orderkey AND b.l_linenumber=a.l_linenumber+1 WHERE a.l_partkey<>b.l_partkey)"


@query("n08_part_paths", f"""WITH RECURSIVE {_PART_STEPS}, h AS (SELECT p_partkey AS s, p_partkey AS v, 0 AS hops FROM part UNION SELECT h.s, e.t, h.hops+1 FROM h JOIN e ON e.s=h.v WHERE h.hops<5),
 d AS (SELECT s, v, min(hops) AS hops FROM h GROUP BY 1,2) SELECT hops::BIGINT AS hops, count(*) AS pairs FROM d WHERE hops BETWEEN 1 AND 5 GROUP BY 1""")
def n08_parts(t):
    """Hops between parts, an edge from each part to the one on the next line of an order; all edges, all pairs."""
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target_id"))
    edges = line.withColumnRenamed("l_partkey", "source_id").join(after, ["l_orderkey", "l_linenumber"]).select("source_id", "target_id")
    return graph.path_lengths(edges, t.part.select(F.col("p_partkey").alias("node")))


@query("n09_propagation_distance", _HOPS + " SELECT round(coalesce(avg(m),0),9) AS distance FROM (SELECT node, min(hops) AS m FROM d WHERE source IN (SELECT n_nationkey FROM nation WHERE n_regionkey=0) AND node IN (SELECT n_nationkey FROM nation WHERE n_regionkey<>0) GROUP BY 1)")
def n09(t):
    """One search from all perturbed sources at once: they share a label, so the first arrival is the nearest."""
    src = t.nation.filter("n_regionkey = 0").select(F.lit(0).alias("source"), F.col("n_nationkey").alias("node"))
    hit = t.nation.filter("n_regionkey <> 0").select(F.col("n_nationkey").alias("node"))
    return graph.hop_distances(big_edges(t), src).join(hit, "node", "left_semi").agg(r9(F.coalesce(F.avg("hops"), F.lit(0.0))).alias("distance"))


@query("n10_homologous_symmetry", f"WITH {FL}, pr AS (SELECT k AS l, k+12 AS r FROM range(12) x(k)), g AS (SELECT coalesce(a.weight,0) AS x, coalesce(b.weight,0) AS y FROM pr p CROSS JOIN pr q LEFT JOIN fl a ON a.target_id=p.l AND a.source_id=q.l LEFT JOIN fl b ON b.target_id=p.r AND b.source_id=q.r) SELECT round(corr(x,y),9) AS symmetry FROM g")
def n10(t):
    """Left and right submatrices meet on the pair index; only stored weights are moved."""
    f = flow(t)
    left = f.filter("source_id < 12 and target_id < 12").select(F.col("target_id").alias("p"), F.col("source_id").alias("q"), F.col("weight").alias("x"))
    right = f.filter("source_id between 12 and 23 and target_id between 12 and 23").select((F.col("target_id") - 12).alias("p"), (F.col("source_id") - 12).alias("q"), F.col("weight").alias("y"))
    j = left.join(right, ["p", "q"], "full").na.fill(0.0, ["x", "y"])
    cells = 144.0
    x, y = F.col("x"), F.col("y")
    s = j.agg(F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    num = cells * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt((cells * F.col("sxx") - F.col("sx") * F.col("sx")) * (cells * F.col("syy") - F.col("sy") * F.col("sy")))
    return s.select(r9(F.when(den == 0, 0.0).otherwise(num / den)).alias("symmetry"))


@query("n11_region_selection", "SELECT pos::BIGINT AS pos, n_nationkey, n_name FROM (VALUES (0,'NATION_3'),(1,'NATION_0'),(2,'ATLANTIS')) r(pos, name) JOIN nation ON n_name=name UNION ALL SELECT row_number() OVER (ORDER BY weight DESC)+2, n_nationkey, n_name FROM (SELECT n_nationkey, n_name, sum(l_quantity) AS weight FROM lineitem JOIN supplier ON s_suppkey=l_suppkey JOIN nation ON n_nationkey=s_nationkey GROUP BY 1,2)")
def n11(t):
    """Regions in the order of a request table (here nations by shipped quantity); unknown names drop out."""
    w = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey").agg(F.sum("l_quantity").alias("weight"))
    req = ranking.value_rank(w, [], F.col("weight"), [], descending=True).select((F.col("rn") + 2).alias("pos"), F.col("s_nationkey").alias("n_nationkey"))
    named = t.spark.createDataFrame([(0, "NATION_3"), (1, "NATION_0"), (2, "ATLANTIS")], "pos bigint, n_name string")
    first = named.join(t.nation, "n_name").select("pos", "n_nationkey", "n_name")
    return req.join(t.nation, "n_nationkey").select("pos", "n_nationkey", "n_name").unionByName(first)


@query("s14_weight_table_load", f"WITH {FL} SELECT source_id, target_id, weight, false AS bad FROM fl")
def s14(t):
    """Requested regions kept; a non-zero diagonal would raise when the column is evaluated."""
    f = flow(t)
    want = t.nation.select(F.col("n_nationkey").alias("source_id"))
    kept = f.join(want, "source_id", "left_semi").join(want.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi")
    bad = F.when(F.col("source_id") == F.col("target_id"), F.raise_error(F.lit("diagonal must be zero")).cast("boolean")).otherwise(F.lit(False))
    return kept.select("source_id", "target_id", "weight", bad.alias("bad"))


@query("a16_median_weights", "SELECT target, source, round(median(w),6) AS weight FROM (SELECT s_nationkey AS target, c_nationkey AS source, CASE WHEN s_nationkey=c_nationkey THEN 0 ELSE l_quantity*l_discount END AS w FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey JOIN supplier ON s_suppkey=l_suppkey) GROUP BY 1,2")
def a16(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("source"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("target"))
    d = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    w = F.when(F.col("source") == F.col("target"), 0.0).otherwise(F.col("l_quantity") * F.col("l_discount"))
    m = ranking.exact_median(d.select("target", "source", w.alias("w")), ["target", "source"], "w", "m")
    return m.select("target", "source", r6("m").alias("weight"))


@query("a15_region_unit_counts", f"WITH {SP} SELECT session, " + ", ".join(f"count(*) FILTER (region='{r}') AS {r}" for r in ("click", "error", "purchase", "signup", "view")) + " FROM (SELECT DISTINCT session, region, unit FROM sp) GROUP BY 1")
def a15(t):
    u = spikes(t).select("session", "region", "unit").distinct()
    return u.groupBy("session").pivot("region", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("a17_population_trace", "SELECT day, round(avg(value),6) AS mean, count(value) AS n FROM (SELECT floor((epoch_us(ts)-1704067200000000)/86400000000.0)::BIGINT AS day, CASE WHEN value>=1 THEN value END AS value FROM events) GROUP BY 1")
def a17(t):
    """Missing samples arrive as NaN, become null once and are then skipped by the mean."""
    v = F.when(F.col("value") >= 1, F.col("value")).otherwise(F.lit(float("nan")))
    s = spikes(t).select(F.floor(F.col("t") / 86400.0).alias("day"), F.when(~F.isnan(v), v).alias("value"))
    return s.groupBy("day").agg(r6(F.avg("value")).alias("mean"), F.count("value").alias("n"))


@query("j32_session_qualification", f"WITH {SP}, {UN}, g AS (SELECT s.session, r.region, coalesce(units,0) AS n FROM (SELECT DISTINCT session FROM sp) s CROSS JOIN (SELECT DISTINCT region FROM sp) r LEFT JOIN un ON un.session=s.session AND un.region=r.region) SELECT session, coalesce(string_agg(region||':'||n, '|' ORDER BY region) FILTER (n<15),'') AS reason, bool_and(n>=15) AS accepted FROM g GROUP BY 1")
def j32(t):
    regions = ("click", "error", "purchase", "signup", "view")
    u = spikes(t).select("session", "region", "unit").distinct().groupBy("session").agg(*[F.count_if(F.col("region") == r).alias(r) for r in regions])
    low = F.array_compact(F.array(*[F.when(F.col(r) < 15, F.concat(F.lit(r + ":"), F.col(r).cast("string"))) for r in regions]))
    return u.select("session", F.array_join(low, "|").alias("reason"), (F.size(low) == 0).alias("accepted"))
