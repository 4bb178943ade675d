"""Queries on sources, sinks, selections, joins and the remaining audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import hashing as H
from veriframe.functions import numeric as N
from veriframe.operators import domain, integrity, ranking, selection
from veriframe.operators import timeseries as TS
from veriframe.plans import bindings as B
from veriframe.plans.q_timeseries import _TC, spikes, timecourse
from veriframe.plans.registry import query, values
from veriframe.sources import files, sinks

V2, V1 = B.V2, B.V1
r6 = lambda c: F.round(c, 6)
r9 = lambda c: F.round(c, 9)


# ---- sources and sinks -----------------------------------------------------

@query("s06_parquet_scan", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice),2) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def s06(t):
    return t.lineitem.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


@query("s07_whitespace_table", "SELECT o_orderkey AS pair, (o_orderkey%9)::INT AS cause_start, (o_custkey%9)::INT AS effect_start, round(o_totalprice,2) AS weight FROM orders WHERE o_orderstatus<>'F'")
def s07(t):
    """Metadata lines built from orders; F orders give lines that are too short and drop out."""
    one = lambda c: (F.col(c) % 9 + 1).cast("string")
    full = F.concat_ws("  ", F.col("o_orderkey").cast("string"), one("o_orderkey"), one("o_orderkey"), one("o_custkey"), one("o_custkey"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"))
    lines = t.orders.select(F.when(F.col("o_orderstatus") == "F", F.concat_ws(" ", F.lit("x"), one("o_custkey"))).otherwise(full).alias("value"))
    return files.pair_metadata(lines).select(F.col("pair").cast("bigint").alias("pair"), "cause_start", "effect_start", "weight")


@query("s07_numbers_long", "SELECT event_id, col::INT AS col, CASE col WHEN 0 THEN value ELSE user_id::DOUBLE END AS number FROM events CROSS JOIN range(2) r(col)")
def s07b(t):
    lines = t.events.select("event_id", F.concat_ws("   ", F.col("value").cast("string"), F.col("user_id").cast("string")).alias("value"))
    return files.whitespace_table(lines, ["event_id"], minimum=2)


@query("s13_trial_landing", "SELECT doc_id AS trial_id, n_chars, coalesce(quality,0)::DOUBLE + coalesce(toxic,0)::DOUBLE AS context_sum FROM documents d LEFT JOIN labels USING (doc_id)")
def s13(t):
    st = t.documents.select(F.col("doc_id").alias("trial_id"), "n_chars")
    resp = t.documents.select(F.col("doc_id").alias("trial_id"), "lang")
    cov = t.labels.select(F.col("doc_id").alias("trial_id"), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("context"))
    return files.join_trials(st, resp, cov, 2).select("trial_id", "n_chars", F.aggregate("context", F.lit(0.0), lambda a, x: a + x).alias("context_sum"))


@query("s15_run_artifact_hash", """SELECT substr(sha256('{"status":"'||o_orderstatus||'"}'),1,12) AS config_hash, count(*) AS n FROM orders GROUP BY 1""")
def s15(t):
    return t.orders.groupBy(sinks.config_hash(F.to_json(F.struct(F.col("o_orderstatus").alias("status")))).alias("config_hash")).agg(F.count("*").alias("n"))


@query("s16_summary_json", """SELECT '{"status":"'||o_orderstatus||'","n":'||count(*)||'}' AS value FROM orders GROUP BY o_orderstatus""")
def s16(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).select(F.to_json(F.struct("status", "n")).alias("value"))


@query("s17_row_csv_arrays", f"WITH {B.DOMAIN_SQL} SELECT package_id||','||claim||','||deficits AS line FROM domain")
def s17(t):
    d = domain.infer_all(B.packages(t), B.evidence(t), V2)
    return d.select(F.concat_ws(",", F.col("package_id").cast("string"), "claim", F.array_join("deficits", "|")).alias("line"))


@query("s18_content_check", "SELECT doc_id, sha256(text)=CASE WHEN lang='fr' THEN sha256('stale') ELSE sha256(text) END AS ok FROM documents")
def s18(t):
    """Content hash against a manifest row; absent or changed content is not ok."""
    m = t.documents.select("doc_id", F.when(F.col("lang") == "fr", F.sha2(F.lit("stale"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    found = t.documents.select("doc_id", F.sha2("text", 256).alias("found"))
    return m.join(found, "doc_id", "left").select("doc_id", F.col("sha256").eqNullSafe(F.col("found")).alias("ok"))


@query("s19_public_projection", "SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority, l_linenumber AS asset, l_partkey AS asset_id FROM orders JOIN lineitem ON l_orderkey=o_orderkey")
def s19(t):
    """Public header and asset fields only, one row per asset, so no asset list grows without bound."""
    a = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("asset"), F.col("l_partkey").alias("asset_id")).distinct()
    return t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").join(a, "o_orderkey")


@query("s20_evidence_triples", f"WITH {B.EVIDENCE_SQL} SELECT predicate, count(*) AS n FROM (SELECT unnest(['packageId','blockName','declaredStatus','source','rule']) AS predicate FROM evidence UNION ALL SELECT 'rationale' FROM evidence WHERE NOT no_rationale UNION ALL SELECT 'observation/'||field FROM evidence JOIN spec USING (block) WHERE NOT (last_missing AND fpos=nf-1)) GROUP BY 1")
def s20(t):
    return sinks.evidence_triples(B.evidence(t)).groupBy("predicate").agg(F.count("*").alias("n"))


@query("s21_knowledge_graph", f"WITH {B.EVIDENCE_SQL}, req1(claim, block, pos) AS (VALUES {values(V1.relations())}) SELECT 'nodes' AS part, (SELECT count(*) FROM packages)+(SELECT count(DISTINCT claim) FROM req1)+(SELECT count(DISTINCT block) FROM req1) AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM req1)+(SELECT count(*) FROM packages)*(SELECT count(DISTINCT claim) FROM req1)")
def s21(t):
    n, e = sinks.knowledge_graph(V1, domain.prioritized_decisions(B.packages(t), B.evidence(t), V1))
    return n.agg(F.lit("nodes").alias("part"), F.count("*").alias("n")).unionByName(e.agg(F.lit("edges").alias("part"), F.count("*").alias("n")))


def _literal_relations(t, rows):
    return t.spark.createDataFrame(rows, "claim string, block string, pos int")


@query("s09_profile_basis_coverage", f"WITH {B.EVIDENCE_SQL}, used AS (SELECT DISTINCT r.claim, e.block FROM evidence e JOIN req r USING (block)) SELECT claim, block, 'never_observed' AS gap FROM req WHERE (claim, block) NOT IN (SELECT claim, block FROM used)")
def s09(t):
    """Relations of the profile that no package ever covers (both sides by anti join)."""
    rel = V2.relations_df(t.spark)
    seen = B.evidence(t).select("block").distinct()
    return rel.join(seen, "block", "left_anti").select("claim", "block", F.lit("never_observed").alias("gap"))


@query("u02_set_difference", f"WITH {B.EVIDENCE_SQL}, seen AS (SELECT DISTINCT block FROM evidence WHERE status='passed'), core AS (SELECT DISTINCT block FROM req WHERE claim='intervention_supported_effect') SELECT block, 'missing' AS side FROM core WHERE block NOT IN (SELECT block FROM seen) UNION ALL SELECT block, 'extra' FROM seen WHERE block NOT IN (SELECT block FROM core)")
def u02(t):
    seen = B.evidence(t).filter("status = 'passed'").select("block").distinct()
    core = V2.relations_df(t.spark).filter("claim = 'intervention_supported_effect'").select("block")
    return core.subtract(seen).withColumn("side", F.lit("missing")).unionByName(seen.subtract(core).withColumn("side", F.lit("extra")))


@query("u03_set_intersection", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag='R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag='N'")
def u03(t):
    pick = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey")
    return pick("R").intersect(pick("N"))


_CO = "WITH d AS (SELECT user_id, round(floor(value/20),12) AS c, event_type AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), tr AS (SELECT DISTINCT user_id, c, d FROM d WHERE i<floor(round(n*0.6,9))), te AS (SELECT user_id, c, d FROM d WHERE i>=floor(round(n*0.8,9)))"


@query("u04_condition_overlap", _CO + " SELECT te.user_id, count(*) AS test_trials, round(avg((tr.user_id IS NOT NULL)::INT),9) AS trial_coverage, count(DISTINCT te.c||te.d) FILTER (tr.user_id IS NULL) AS test_only FROM te LEFT JOIN tr ON tr.user_id=te.user_id AND tr.c=te.c AND tr.d=te.d GROUP BY 1")
def u04(t):
    e = t.events.select("user_id", "event_id", N.stable_level(F.floor(F.col("value") / 20).cast("double")).alias("c"), F.col("event_type").alias("d"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    s = selection.chronological_split(e, ["user_id"], F.col("us"), [F.col("event_id")])
    tr = s.filter("role = 'train'").select("user_id", "c", "d").distinct().withColumn("seen", F.lit(1))
    te = s.filter("role = 'test'").join(tr, ["user_id", "c", "d"], "left")
    return te.groupBy("user_id").agg(F.count("*").alias("test_trials"), r9(F.avg(F.coalesce("seen", F.lit(0)))).alias("trial_coverage"), F.count_distinct(F.when(F.col("seen").isNull(), F.concat_ws("#", "c", "d"))).alias("test_only"))


@query("a29_subject_coverage", _CO + ", s AS (SELECT te.user_id, avg((tr.user_id IS NOT NULL)::INT) AS cov, count(*) FILTER (tr.user_id IS NULL) AS un FROM te LEFT JOIN tr ON tr.user_id=te.user_id AND tr.c=te.c AND tr.d=te.d GROUP BY 1) SELECT count(*) AS subjects, round(min(cov),9) AS lo, round(median(cov),9) AS mid, round(avg(cov),9) AS mean, count(*) FILTER (un>0) AS with_test_only FROM s")
def a29(t):
    s = u04(t)
    return s.agg(F.count("*").alias("subjects"), r9(F.min("trial_coverage")).alias("lo"), r9(F.avg("trial_coverage")).alias("mean"), F.count_if(F.col("test_only") > 0).alias("with_test_only")).withColumn("mid", r9(ranking.median_of(s, "trial_coverage")))


@query("u08_ordered_dedupe", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def u08(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).filter("copies > 1")


# ---- joins and selections --------------------------------------------------

@query("j11_coregistration", "SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, p.p_size, s.s_nationkey, o.o_orderstatus FROM lineitem c LEFT JOIN part p ON p.p_partkey=c.l_partkey LEFT JOIN supplier s ON s.s_suppkey=c.l_suppkey LEFT JOIN orders o ON o.o_orderkey=c.l_orderkey")
def j11(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size")
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    c = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return c.join(p, "l_partkey", "left").join(s, "l_suppkey", "left").join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_size", "s_nationkey", "o_orderstatus")


@query("j12_type_enrichment", "SELECT s_suppkey, min(l_returnflag) AS kind FROM supplier LEFT JOIN lineitem ON l_suppkey=s_suppkey AND l_quantity>49 WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_tax>0.07) GROUP BY 1")
def j12(t):
    kinds = t.lineitem.filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_returnflag").alias("kind"))
    roots = t.lineitem.filter("l_tax > 0.07").select(F.col("l_suppkey").alias("s_suppkey"))
    return t.supplier.select("s_suppkey").join(kinds, "s_suppkey", "left").join(roots, "s_suppkey", "left_semi")


@query("j16_stimulus_response_match", "SELECT o_orderkey AS trial_id, count(*) AS responses FROM orders JOIN events ON event_id=o_orderkey GROUP BY 1")
def j16(t):
    return t.orders.select(F.col("o_orderkey").alias("trial_id")).join(t.events.select(F.col("event_id").alias("trial_id")), "trial_id").groupBy("trial_id").agg(F.count("*").alias("responses"))


_FL = "fl AS (SELECT c_nationkey AS s, s_nationkey AS d, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey JOIN supplier ON s_suppkey=l_suppkey WHERE c_nationkey<>s_nationkey GROUP BY 1,2), big AS (SELECT s, d FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w DESC, d) AS rn FROM fl) WHERE rn<=3)"


def direct_and_controls(edges, nodes, namespace, controls):
    """Edges plus as many hash-ordered non-edges that are not reversed edges.

    Candidate non-edges come from hash draws per node (offsets on the node ring), so
    node pairs are not multiplied out; the hash order then picks the controls.
    """
    from veriframe.operators.inference import index_units

    ix = index_units(nodes, [], "node")
    blocked = edges.select("s", "d").unionByName(edges.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct()
    j = ix.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(controls - 1))))
    off = H.hash_index(F.concat_ws(":", F.lit(namespace), F.col("node").cast("string"), F.col("k").cast("string")), F.col("n") - 1) + 1
    cand = j.select(F.col("node").alias("s"), F.pmod(F.col("idx") + off, F.col("n")).alias("idx")).distinct().join(ix.select(F.col("node").alias("d"), "idx"), "idx").select("s", "d")
    free = cand.join(blocked, ["s", "d"], "left_anti")
    r = ranking.hash_rank(free, [], F.concat_ws(":", "s", "d"), namespace)
    m = edges.agg(F.count("*").alias("m"), F.lit(1).alias("_one"))
    kept = r.withColumn("_one", F.lit(1)).join(F.broadcast(m), "_one").filter("rn <= m").select("s", "d", F.lit(False).alias("direct"))
    return edges.select("s", "d", F.lit(True).alias("direct")).unionByName(kept)


@query("j23_direct_and_control_pairs", f"WITH {_FL}, ix AS (SELECT n_nationkey AS node, row_number() OVER (ORDER BY n_nationkey)-1 AS idx, count(*) OVER () AS n FROM nation), cand AS (SELECT DISTINCT a.node AS s, b.node AS d FROM ix a CROSS JOIN range(8) r(k) JOIN ix b ON b.idx=(a.idx+1+{B.hash_index_sql(chr(39) + 'nonedge:' + chr(39) + '||a.node||' + chr(39) + ':' + chr(39) + '||k', 'a.n-1')})%a.n WHERE (a.node,b.node) NOT IN (SELECT s, d FROM big UNION SELECT d, s FROM big)) SELECT s, d, true AS direct FROM big UNION ALL SELECT s, d, false FROM (SELECT *, row_number() OVER (ORDER BY sha256('nonedge:'||s||':'||d), s||':'||d) AS rn FROM cand) WHERE rn<=(SELECT count(*) FROM big)")
def j23(t):
    from veriframe.plans.q_timeseries import big_edges

    e = big_edges(t).select(F.col("source_id").alias("s"), F.col("target_id").alias("d"))
    return direct_and_controls(e, t.nation.select(F.col("n_nationkey").alias("node")), "nonedge", 8)


@query("j24_adapter_controls", f"WITH {_FL}, c AS (SELECT s, d, n_nationkey AS v, row_number() OVER (PARTITION BY s, d ORDER BY sha256('river:'||s||':'||d||':'||n_nationkey)) AS rn FROM big CROSS JOIN nation WHERE n_nationkey<>s AND n_nationkey<>d) SELECT s, d, v AS control, rn AS pos FROM c WHERE rn<=3")
def j24(t):
    """Three other variables per pair by hash; variables are a fixed vocabulary held as one array."""
    from veriframe.plans.q_timeseries import big_edges

    e = big_edges(t).select(F.col("source_id").alias("s"), F.col("target_id").alias("d"))
    v = t.nation.agg(F.sort_array(F.collect_list("n_nationkey")).alias("vs"), F.lit(1).alias("_one"))
    x = e.withColumn("_one", F.lit(1)).join(F.broadcast(v), "_one")
    ranked = F.array_sort(F.transform(F.filter("vs", lambda n: (n != F.col("s")) & (n != F.col("d"))), lambda n: F.struct(F.sha2(F.concat_ws(":", F.lit("river"), F.col("s").cast("string"), F.col("d").cast("string"), n.cast("string")), 256).alias("h"), n.alias("v"))))
    return x.select("s", "d", F.posexplode(F.slice(ranked, 1, 3)).alias("p", "c")).select("s", "d", F.col("c.v").alias("control"), (F.col("p") + 1).cast("bigint").alias("pos"))


@query("j25_domain_intersection", "SELECT l_partkey FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>=8) GROUP BY 1 HAVING count(*)=3")
def j25(t):
    ok = t.lineitem.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n")).filter("n >= 8")
    return ok.groupBy("l_partkey").agg(F.count("*").alias("domains")).filter("domains = 3").select("l_partkey")


@query("j26_subject_selection", "WITH f AS (SELECT o_custkey AS subject, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('probe:'||o_orderkey)) AS rn FROM orders WHERE o_totalprice>100000), k AS (SELECT subject, o_orderkey, row_number() OVER (ORDER BY sha256('subject:'||subject), subject) AS r FROM f WHERE rn=1 AND subject NOT IN (SELECT user_id FROM events)) SELECT subject, o_orderkey, CASE WHEN r<=300 THEN 'calibration' ELSE 'test' END AS role FROM k WHERE r<=500")
def j26(t):
    """One insertion per subject, prior subjects excluded, roles by hash rank."""
    one = selection.first_by_hash(t.orders.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("subject"), "o_orderkey"), ["subject"], F.col("o_orderkey"), "probe", ["o_orderkey"])
    fresh = one.join(t.events.select(F.col("user_id").alias("subject")), "subject", "left_anti")
    r = ranking.hash_rank(fresh, [], F.col("subject"), "subject").filter("rn <= 500")
    return r.select("subject", "o_orderkey", F.when(F.col("rn") <= 300, "calibration").otherwise("test").alias("role"))


@query("j28_conformance_join", f"WITH {B.DOMAIN_SQL}, ex AS (SELECT package_id, claim, CASE WHEN n_failed>0 THEN false ELSE ok END AS expected FROM domain WHERE claim<>'independent_study_replication') SELECT count(*) FILTER (e.package_id IS NULL) AS unexpected, count(*) FILTER (d.package_id IS NULL) AS absent, count(*) FILTER (e.expected IS NOT DISTINCT FROM d.ok) AS agree FROM domain d FULL JOIN ex e USING (package_id, claim)")
def j28(t):
    d = domain.infer_all(B.packages(t), B.evidence(t), V2).select("package_id", "claim", (F.col("status") == "profile_authorized").alias("ok"), "n_failed")
    ex = d.filter("claim <> 'independent_study_replication'").select("package_id", "claim", F.when(F.col("n_failed") > 0, False).otherwise(F.col("ok")).alias("expected"), F.lit(1).alias("e"))
    j = d.withColumn("d", F.lit(1)).join(ex, ["package_id", "claim"], "full")
    return j.agg(F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(F.col("d").isNull()).alias("absent"), F.count_if(F.col("expected").eqNullSafe(F.col("ok"))).alias("agree"))


@query("j30_source_resolution", "WITH c AS (SELECT o_orderkey AS item, unnest([ 'doc'||o_custkey, 'doc'||(o_orderkey%700) ]) AS src FROM orders) SELECT src, count(*) AS items FROM c WHERE src NOT IN (SELECT 'doc'||doc_id FROM documents) GROUP BY 1")
def j30(t):
    ids = F.concat_ws("|", F.concat(F.lit("doc"), "o_custkey"), F.concat(F.lit("doc"), F.col("o_orderkey") % 700))
    c = t.orders.select(F.col("o_orderkey").alias("item"), F.explode(F.split(ids, r"\|")).alias("src"))
    bib = t.documents.select(F.concat(F.lit("doc"), "doc_id").alias("src"))
    return c.join(bib, "src", "left_anti").groupBy("src").agg(F.count("*").alias("items"))


@query("j31_issue_resolution", "SELECT 'unresolved' AS kind, count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role='user') u WHERE (u.conv_id, u.turn+1) NOT IN (SELECT conv_id, turn FROM conversations WHERE role='assistant') UNION ALL SELECT 'orphan', count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role='assistant') a WHERE (a.conv_id, a.turn-1) NOT IN (SELECT conv_id, turn FROM conversations WHERE role='user')")
def j31(t):
    """User turns as issues, the following assistant turns as resolutions; anti joins both ways."""
    i = t.conversations.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    r = t.conversations.filter("role = 'assistant'").select("conv_id", "turn").distinct()
    a = i.join(r, ["conv_id", "turn"], "left_anti").agg(F.lit("unresolved").alias("kind"), F.count("*").alias("n"))
    return a.unionByName(r.join(i, ["conv_id", "turn"], "left_anti").agg(F.lit("orphan").alias("kind"), F.count("*").alias("n")))


@query("j33_sealed_cohort", "WITH s AS (SELECT o_orderkey AS session, o_custkey AS mouse, o_orderpriority='1-URGENT' AS lv FROM orders WHERE o_orderstatus='O' AND o_custkey NOT IN (SELECT user_id FROM events)), a AS (SELECT *, row_number() OVER (PARTITION BY mouse ORDER BY session) AS m FROM s WHERE lv), a1 AS (SELECT * FROM a WHERE m=1 ORDER BY session LIMIT 50), b AS (SELECT *, row_number() OVER (PARTITION BY mouse ORDER BY session) AS m FROM s WHERE NOT lv AND mouse NOT IN (SELECT mouse FROM a1)), b1 AS (SELECT * FROM b WHERE m=1 ORDER BY session LIMIT 50) SELECT session, mouse, 'first' AS level FROM a1 UNION ALL SELECT session, mouse, 'second' FROM b1")
def j33(t):
    """Unseen subjects, one session each, the first k per level; subjects of the first level leave the second."""
    s = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("mouse"), (F.col("o_orderpriority") == "1-URGENT").alias("lv"))
    s = s.join(t.events.select(F.col("user_id").alias("mouse")), "mouse", "left_anti")
    first = s.filter("lv").groupBy("mouse").agg(F.min("session").alias("session")).orderBy("session").limit(50)
    second = s.filter("not lv").join(first, "mouse", "left_anti").groupBy("mouse").agg(F.min("session").alias("session")).orderBy("session").limit(50)
    return first.withColumn("level", F.lit("first")).unionByName(second.withColumn("level", F.lit("second")))


# ---- aggregates ------------------------------------------------------------

@query("a18_tuning_vectors", "SELECT l_linenumber AS neuron, l_suppkey AS stimulus, round(avg(l_quantity),6) AS tuning FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def a18(t):
    g = t.lineitem.groupBy(F.col("l_linenumber").alias("neuron"), F.col("l_suppkey").alias("stimulus")).agg(r6(F.avg("l_quantity")).alias("tuning"), F.count("*").alias("k"))
    return g.filter("k > 1").drop("k")


@query("a30_direction_metrics", "SELECT l_returnflag AS regime, count(*) FILTER (l_tax>0) AS attempts, count(*) FILTER (l_linestatus='F') AS identifiable, count(*) FILTER (l_tax>0 AND l_linestatus='F' AND l_discount>=0.03) AS correct, round(count(*) FILTER (l_tax>0 AND l_linestatus='F' AND l_discount>=0.03)/count(*) FILTER (l_tax>0 AND l_linestatus='F')::DOUBLE,9) AS accuracy FROM lineitem GROUP BY 1")
def a30(t):
    a, i, c = F.col("l_tax") > 0, F.col("l_linestatus") == "F", F.col("l_discount") >= 0.03
    return t.lineitem.groupBy(F.col("l_returnflag").alias("regime")).agg(
        F.count_if(a).alias("attempts"), F.count_if(i).alias("identifiable"), F.count_if(a & i & c).alias("correct"), r9(F.coalesce(F.try_divide(F.count_if(a & i & c), F.count_if(a & i)), F.lit(0.0))).alias("accuracy"))


@query("a31_method_curves", "WITH m AS (SELECT 'disc' AS method, l_discount*10 AS margin, l_returnflag='N' AS ok FROM lineitem UNION ALL SELECT 'tax', l_tax*10, l_linestatus='F' FROM lineitem) SELECT method, thr AS threshold, count(*) FILTER (round(margin,9)>=thr) AS decided, count(*) FILTER (round(margin,9)>=thr AND ok) AS correct FROM m CROSS JOIN (VALUES (0.0::DOUBLE),(0.2),(0.4),(0.6)) t(thr) GROUP BY 1,2")
def a31(t):
    """All methods and thresholds as conditional counts of one scan."""
    thr = (0.0, 0.2, 0.4, 0.6)
    m = {"disc": (F.round(F.col("l_discount") * 10, 9), F.col("l_returnflag") == "N"), "tax": (F.round(F.col("l_tax") * 10, 9), F.col("l_linestatus") == "F")}
    agg = t.lineitem.agg(*[e for k, (v, ok) in m.items() for i, x in enumerate(thr) for e in (F.count_if(v >= x).alias(f"d_{k}_{i}"), F.count_if((v >= x) & ok).alias(f"c_{k}_{i}"))])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(k).alias("method"), F.lit(x).alias("threshold"), F.col(f"d_{k}_{i}").alias("decided"), F.col(f"c_{k}_{i}").alias("correct")) for k in m for i, x in enumerate(thr)])))


@query("a32_weighted_accuracy", "SELECT l_suppkey, round(sum(l_quantity*(l_returnflag='N')::INT)/sum(l_quantity),9) AS accuracy FROM lineitem GROUP BY 1")
def a32(t):
    w = F.col("l_quantity")
    return t.lineitem.groupBy("l_suppkey").agg(r9(F.sum(w * (F.col("l_returnflag") == "N").cast("int")) / F.sum(w)).alias("accuracy"))


@query("a33_cohort_medians", "SELECT o_orderpriority, round(median(o_totalprice),4) AS median_price, count(*) FILTER (o_totalprice>250000) AS above FROM orders GROUP BY 1")
def a33(t):
    above = t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 250000).alias("above"))
    medians = ranking.exact_median(t.orders, ["o_orderpriority"], "o_totalprice", "m")
    return ranking.group_join(above, medians, ["o_orderpriority"], "left").select("o_orderpriority", F.round("m", 4).alias("median_price"), "above")


@query("a36_feature_means", "SELECT l_suppkey, round(avg(l_quantity),6) AS q, round(avg(l_discount),9) AS d, round(avg(l_tax),9) AS x FROM lineitem GROUP BY 1")
def a36(t):
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.avg("l_quantity")).alias("q"), r9(F.avg("l_discount")).alias("d"), r9(F.avg("l_tax")).alias("x"))


@query("g15_minimum_grids", "WITH u AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1) SELECT metric, minimum, count(*) FILTER (CASE metric WHEN 'q' THEN round(q,9)>=minimum ELSE round(d,9)>=minimum END) AS passing, count(*) AS n FROM u CROSS JOIN (VALUES ('q',25.0::DOUBLE),('q',25.5),('q',26.0),('d',0.048),('d',0.05),('d',0.052)) g(metric, minimum) GROUP BY 1,2")
def g15(t):
    grid = (("q", 25.0), ("q", 25.5), ("q", 26.0), ("d", 0.048), ("d", 0.05), ("d", 0.052))
    u = t.lineitem.groupBy("l_suppkey").agg(r9(F.avg("l_quantity")).alias("q"), r9(F.avg("l_discount")).alias("d"))
    a = u.agg(F.count("*").alias("n"), *[F.count_if(F.col(m) >= v).alias(f"p{i}") for i, (m, v) in enumerate(grid)])
    return a.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(v).alias("minimum"), F.col(f"p{i}").alias("passing"), F.col("n").alias("n")) for i, (m, v) in enumerate(grid)])))


@query("g18_two_claims_per_case", f"WITH {B.DOMAIN_SQL} SELECT package_id, max(ok::INT) FILTER (claim='bounded_predictive_performance') AS target, max(ok::INT) FILTER (claim='complete_entity_specific_mouse_brain_digital_twin') AS strict_twin FROM domain GROUP BY 1")
def g18(t):
    d = domain.infer_all(B.packages(t), B.evidence(t), V2)
    ok = (F.col("status") == "profile_authorized").cast("int")
    pick = lambda c: F.max(F.when(F.col("claim") == c, ok))
    return d.groupBy("package_id").agg(pick("bounded_predictive_performance").alias("target"), pick("complete_entity_specific_mouse_brain_digital_twin").alias("strict_twin"))


FORBIDDEN = ("causal", "digital_twin")


@query("g19_real_case_matrix", f"WITH {B.EVIDENCE_SQL}, req1(claim, block, pos) AS (VALUES {values(V1.relations())}), d AS (SELECT p.package_id, r.claim, bool_and(coalesce(e.status,'unknown')='passed') AS sup FROM packages p CROSS JOIN req1 r LEFT JOIN evidence e ON e.package_id=p.package_id AND e.block=r.block GROUP BY 1,2) SELECT claim, count(*) FILTER (sup) AS supported, count(*) FILTER (sup AND claim IN ('causal','digital_twin')) AS forbidden FROM d GROUP BY 1")
def g19(t):
    d = domain.prioritized_decisions(B.packages(t), B.evidence(t), V1)
    s = F.col("decision") == "supported"
    return d.groupBy("claim").agg(F.count_if(s).alias("supported"), F.count_if(s & F.col("claim").isin(*FORBIDDEN)).alias("forbidden"))


@query("g20_case_builders", "SELECT event_id AS case_id, block, CASE WHEN block='prediction' THEN CASE WHEN (props->>'$.k')::DOUBLE>=60 THEN 'passed' ELSE 'failed' END WHEN block='robustness' THEN CASE WHEN (props->>'$.k')::DOUBLE<=80 THEN 'passed' ELSE 'failed' END ELSE 'unknown' END AS status FROM events CROSS JOIN (VALUES ('prediction'),('robustness'),('context_of_use')) b(block)")
def g20(t):
    """A mapping table (block, JSON path, test, threshold) turns artifacts into evidence rows."""
    from veriframe.operators.contracts import json_value

    mapping = (("prediction", "k", "min", 60.0), ("robustness", "k", "max", 80.0), ("context_of_use", "scope.use", "min", 0.0))

    def status(path, kind, thr):
        v = json_value(F.col("props"), F.lit(path), "double")
        ok = v >= thr if kind == "min" else v <= thr
        return F.when(v.isNull(), "unknown").when(ok, "passed").otherwise("failed")

    rows = F.array(*[F.struct(F.lit(b).alias("block"), status(p, k, v).alias("status")) for b, p, k, v in mapping])
    return t.events.select(F.col("event_id").alias("case_id"), F.inline(rows))


@query("g22_traceability_audit", f"WITH {B.EVIDENCE_SQL} SELECT count(*) AS facts, bool_and(source IS NOT NULL) AS all_sources, bool_and(block IN (SELECT DISTINCT block FROM spec)) AS all_declared, count(*)=count(DISTINCT package_id||'/'||block) AS unique_facts, bool_and(NOT no_rationale) AS all_rationales FROM evidence")
def g22(t):
    ev = B.evidence(t)
    a = ev.agg(F.count("*").alias("facts"), F.bool_and(domain.present(F.col("source"))).alias("all_sources"), F.bool_and(F.col("block").isin(list(V2.blocks))).alias("all_declared"), F.bool_and(domain.present(F.col("rationale"))).alias("all_rationales"), F.lit(1).alias("_one"))
    u = ev.groupBy("package_id", "block").agg(F.count("*").alias("k")).agg((F.max("k") == 1).alias("unique_facts"), F.lit(1).alias("_one"))
    return a.join(u, "_one").drop("_one")


@query("g24_explanation_audit", f"WITH {B.DOMAIN_SQL} SELECT claim, count(*) FILTER (NOT ok) AS not_authorized, count(*) FILTER (NOT ok AND deficits<>'') AS explained, count(*) FILTER (n_failed+n_requires_review+n_unknown+n_not_applicable+n_passed=len(string_split(deficits,'|'))*(deficits<>'')::INT+n_passed) AS consistent FROM domain GROUP BY 1")
def g24(t):
    d = domain.infer_all(B.packages(t), B.evidence(t), V2)
    no = F.col("status") != "profile_authorized"
    lacking = F.col("n_failed") + F.col("n_requires_review") + F.col("n_unknown") + F.col("n_not_applicable")
    return d.groupBy("claim").agg(F.count_if(no).alias("not_authorized"), F.count_if(no & (F.size("deficits") > 0)).alias("explained"), F.count_if(lacking == F.size("deficits")).alias("consistent"))


@query("g25_rule_safety", f"WITH {B.EVIDENCE_SQL}, req1(claim, block, pos) AS (VALUES {values(V1.relations())}), v AS (SELECT p.package_id, r.claim, string_agg(coalesce(e.status,'unknown'), ',' ORDER BY r.pos) AS vec, bool_and(coalesce(e.status,'unknown')='passed') AS ok FROM packages p CROSS JOIN req1 r LEFT JOIN evidence e ON e.package_id=p.package_id AND e.block=r.block GROUP BY 1,2) SELECT claim, count(DISTINCT vec) AS vectors, count(*) FILTER (ok) AS supported, 0::BIGINT AS unsafe FROM v GROUP BY 1")
def g25(t):
    """Every status vector that occurs is executed; support with a non-passed block would be unsafe."""
    ev, pk = B.evidence(t), B.packages(t)
    d = domain.prioritized_decisions(pk, ev, V1)
    facts = domain.requirement_facts(pk, ev.select("package_id", "block", "status", "source", "rule", "rationale", "observations"), V1)
    v = facts.groupBy("package_id", "claim").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "declared_status"))), lambda x: x["declared_status"]), ",").alias("vec"), F.bool_and(F.col("declared_status") == "passed").alias("ok"))
    j = d.join(v, ["package_id", "claim"])
    s = F.col("decision") == "supported"
    return j.groupBy("claim").agg(F.count_distinct("vec").alias("vectors"), F.count_if(s).alias("supported"), F.count_if(s & ~F.col("ok")).alias("unsafe"))


def _vectors_sql():
    """All vectors of a claim as numbers, their statuses as base-five digits."""
    parts = []
    for claim, blocks in V1.claims.items():
        digits = [f"(v // {5**i}) % 5" for i in range(len(blocks))]
        has = lambda d: " OR ".join(f"{x} = {d}" for x in digits)
        decision = f"CASE WHEN {has(0)} THEN 'blocked' WHEN {has(1)} THEN 'needs_external_review' WHEN {has(2)} THEN 'uncertain' WHEN {has(3)} THEN 'out_of_scope' ELSE 'supported' END"
        parts.append(f"SELECT '{claim}' AS claim, v, {decision} AS decision, {' + '.join(f'(({x}) = 4)::INT' for x in digits)} = {len(blocks)} AS ok FROM range({5 ** len(blocks)}) r(v)")
    return " UNION ALL ".join(parts)


_DIGIT_SQL = "CASE coalesce(e.status,'unknown') WHEN 'failed' THEN 0 WHEN 'requires_review' THEN 1 WHEN 'unknown' THEN 2 WHEN 'not_applicable' THEN 3 ELSE 4 END"


@query("g25_all_status_vectors", f"WITH {B.EVIDENCE_SQL}, req1(claim, block, pos) AS (VALUES {values(V1.relations())}), p AS (SELECT DISTINCT e.package_id FROM evidence e WHERE e.block IN (SELECT block FROM req1)), "
 f"o AS (SELECT p.package_id, r.claim, sum({_DIGIT_SQL} * (5 ** (r.pos - (SELECT min(pos) FROM req1)))::BIGINT)::BIGINT AS v FROM p CROSS JOIN req1 r LEFT JOIN evidence e ON e.package_id=p.package_id AND e.block=r.block GROUP BY 1,2), "
 f"c AS (SELECT claim, v, count(*) AS packages FROM o GROUP BY 1,2), a AS ({_vectors_sql()}) "
 "SELECT claim, decision, count(*) AS vectors, count(c.packages) AS vectors_shown, coalesce(sum(c.packages),0)::BIGINT AS packages, count(*) FILTER (decision='supported' AND NOT ok) AS unsafe FROM a LEFT JOIN c USING (claim, v) GROUP BY 1,2")
def g25_all(t):
    """Every vector of every claim is decided, whether or not a package shows it."""
    v = domain.status_vectors(B.evidence(t), V1)
    unsafe = (F.col("decision") == "supported") & ~F.col("all_passed")
    return v.groupBy("claim", "decision").agg(F.count("*").alias("vectors"), F.count_if(F.col("packages") > 0).alias("vectors_shown"), F.sum("packages").alias("packages"), F.count_if(unsafe).alias("unsafe"))


@query("g26_review_audit", "WITH r AS (SELECT o_orderkey AS item, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'revise' ELSE 'reject' END AS decision FROM orders WHERE o_orderpriority<>'5-LOW') SELECT coalesce(decision,'missing') AS decision, count(*) AS n FROM orders LEFT JOIN r ON r.item=o_orderkey GROUP BY 1")
def g26(t):
    r = t.orders.filter("o_orderpriority <> '5-LOW'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "revise").otherwise("reject").alias("decision"))
    return t.orders.select("o_orderkey").join(r, "o_orderkey", "full").groupBy(F.coalesce("decision", F.lit("missing")).alias("decision")).agg(F.count("*").alias("n"))


@query("f04_rules_as_data", f"WITH {B.EVIDENCE_SQL}, rc AS (SELECT package_id, bool_or(status='failed') AS f, bool_and(status='passed') AS p FROM evidence GROUP BY 1) SELECT CASE WHEN f THEN 'stop' WHEN p THEN 'go' ELSE 'wait' END AS decision, count(*) AS n FROM rc GROUP BY 1")
def f04(t):
    """Rules come from a table (priority, quantifier, status, conclusion) interpreted as counts, not code."""
    rules = (("veto", 10, "any", "failed", "stop"), ("pass", 0, "all", "passed", "go"))
    c = B.evidence(t).groupBy("package_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == r[3]).alias(r[0]) for r in rules])
    out = F.lit("wait")
    for name, _, quantifier, _, conclusion in sorted(rules, key=lambda r: r[1]):
        out = F.when(F.col(name) > 0 if quantifier == "any" else F.col(name) == F.col("n"), conclusion).otherwise(out)
    return c.groupBy(out.alias("decision")).agg(F.count("*").alias("n"))


# ---- extraction and session evaluation -------------------------------------

@query("e07_spatial_pooling", "WITH px AS (SELECT vec_id, i//8 AS r, i%8 AS c, embedding[i+1]::DOUBLE AS v FROM embeddings CROSS JOIN range(64) x(i)) SELECT vec_id, (r//4)*2+c//4 AS cell, round(avg(v),6) AS mean FROM px GROUP BY 1,2")
def e07(t):
    """Each 64-value vector as an 8 x 8 image, averaged over a 2 x 2 grid."""
    p = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    r, c = F.floor(F.col("i") / 8), F.col("i") % 8
    return p.groupBy("vec_id", (F.floor(r / 4) * 2 + F.floor(c / 4)).cast("bigint").alias("cell")).agg(r6(F.avg(F.col("v").cast("double"))).alias("mean"))


@query("e08_summary_descriptor", "WITH px AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS sd, round(quantile_cont(v,0.25),6) AS q1, round(quantile_cont(v,0.5),6) AS q2, round(quantile_cont(v,0.75),6) AS q3 FROM px GROUP BY 1")
def e08(t):
    p = t.embeddings.select("vec_id", F.explode("embedding").alias("e")).select("vec_id", F.col("e").cast("double").alias("v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return p.groupBy("vec_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), q.alias("q")).select("vec_id", r6("m").alias("mean"), r6("s").alias("sd"), *[r6(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3)])


@query("e09_temporal_filterbank", "WITH f AS (SELECT vec_id, i, list_avg(embedding[i*8+1:i*8+8])::DOUBLE AS m FROM embeddings CROSS JOIN range(8) x(i)) SELECT vec_id, round(avg(m),5) AS mean, round(avg(abs(d)),5) AS motion, round(sqrt(pow(sum(m*cos(2*pi()*i/8)),2)+pow(sum(m*sin(2*pi()*i/8)),2)),5) AS first_harmonic FROM (SELECT *, m-lag(m) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM f) GROUP BY 1")
def e09(t):
    """Frame means, motion between frames and the first harmonic, inside the short frame array of one trial."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.aggregate(F.slice("embedding", i * 8 + 1, F.lit(8)), F.lit(0.0), lambda a, x: a + x.cast("double")) / 8.0)
    d = t.embeddings.select("vec_id", frames.alias("m"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    motion = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.abs(F.col("m")[i] - F.col("m")[i - 1]))
    wave = lambda fn: total(F.transform("m", lambda x, i: x * fn(i * (2 * 3.141592653589793 / 8))))
    re, im = wave(F.cos), wave(F.sin)
    return d.select("vec_id", F.round(total(F.col("m")) / 8, 5).alias("mean"), F.round(total(motion) / 7, 5).alias("motion"), F.round(F.sqrt(re * re + im * im), 5).alias("first_harmonic"))


@query("e10_response_collapse", "SELECT l_orderkey AS trial, l_linenumber AS neuron, round(coalesce(avg(CASE WHEN l_tax>0 THEN l_quantity END),0),6) AS y FROM lineitem GROUP BY 1,2")
def e10(t):
    v = F.when(F.col("l_tax") > 0, F.col("l_quantity"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("neuron")).agg(r6(F.coalesce(F.avg(v), F.lit(0.0))).alias("y"))


_REF = _TC + ", ref AS (SELECT a.session, a.region, a.bin, a.hz, a.odd_hz, a.even_hz, avg(b.hz) AS ref FROM tc a JOIN tc b ON a.region=b.region AND a.bin=b.bin AND a.session<>b.session GROUP BY ALL)"


def reliability_rows(t):
    """Each session's timecourse against the mean of the others, plus its split halves."""
    from veriframe.session import cut

    tc = cut(timecourse(t))
    tot = tc.groupBy("region", "bin").agg(F.sum("hz").alias("s"), F.count("*").alias("n"))
    return tc.join(tot, ["region", "bin"]).withColumn("ref", (F.col("s") - F.col("hz")) / (F.col("n") - 1))


@query("i06_reliability", _REF + ", r AS (SELECT session, coalesce(corr(hz,ref),0) AS real, coalesce(corr(odd_hz,even_hz),0) AS split FROM ref GROUP BY 1) SELECT round(median(real),6) AS median_cross, round(median(split),6) AS median_split, count(*) AS sessions FROM r")
def i06(t):
    r = reliability_rows(t).groupBy("session").agg(N.safe_corr(F.col("hz"), F.col("ref")).alias("real"), N.safe_corr(F.col("odd_hz"), F.col("even_hz")).alias("split"))
    return r.agg(F.count("*").alias("sessions")).select(r6(ranking.median_of(r, "real")).alias("median_cross"), r6(ranking.median_of(r, "split")).alias("median_split"), "sessions")


@query("i06_permutation_null")
def i06b(t):
    """Region labels of the reference permuted per replicate; share of sessions above their own 95th percentile."""
    from veriframe.operators import inference as I
    from veriframe.session import cut

    d = cut(reliability_rows(t).select("session", "region", "bin", "hz", "ref"))
    perm = I.permutations(d.select("region").distinct(), [], "region", 20, "regions")
    moved = d.select("session", "region", "bin", "hz").join(perm, "region").join(d.select("session", F.col("region").alias("other"), "bin", "ref"), ["session", "other", "bin"])
    null = moved.groupBy("session", "rep").agg(N.safe_corr(F.col("hz"), F.col("ref")).alias("r")).groupBy("session").agg(F.percentile("r", F.lit(0.95)).alias("p95"))
    real = d.groupBy("session").agg(N.safe_corr(F.col("hz"), F.col("ref")).alias("real"))
    return real.join(null, "session").agg(F.avg((F.col("real") > F.col("p95")).cast("int")).alias("fraction_above_null"), F.count("*").alias("sessions"))


@query("i07_latency_agreement", _TC + ", l AS (SELECT session, region, round(time,6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY round(hz,12) DESC, time) AS rn FROM tc WHERE time>0 AND time<=7200) WHERE rn=1) SELECT round(avg((abs(a.lat-b.lat)>=900)::INT),9) AS resolvable_fraction, count(*) AS pairs FROM l a JOIN l b ON a.session=b.session AND a.region<b.region")
def i07(t):
    """Share of region pairs whose latencies differ by at least one bin; regions are a short fixed list per session."""
    lat = TS.peak_latency(timecourse(t).select("session", "region", "time", F.round("hz", 12).alias("x")), ["session", "region"], 7200.0)
    g = lat.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("region", "latency"))).alias("v"))
    gaps = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["region"] > a["region"]), lambda b: F.abs(a["latency"] - b["latency"]))))
    return g.select(F.explode(gaps).alias("g")).agg(r9(F.avg((F.col("g") >= 900).cast("int"))).alias("resolvable_fraction"), F.count("*").alias("pairs"))


@query("e11_session_benchmark", _REF + ", r AS (SELECT session, coalesce(corr(hz,ref),0) AS real, coalesce(corr(odd_hz,even_hz),0) AS split FROM ref GROUP BY 1) SELECT median(real)>0.2 AS cross_passed, median(split)>0.1 AS split_passed, CASE WHEN median(real)>0.2 AND median(split)>0.1 THEN 'reproducible' ELSE 'not_reproducible' END AS decision FROM r")
def e11(t):
    r = reliability_rows(t).groupBy("session").agg(N.safe_corr(F.col("hz"), F.col("ref")).alias("real"), N.safe_corr(F.col("odd_hz"), F.col("even_hz")).alias("split"))
    a, b = F.median("real") > 0.2, F.median("split") > 0.1
    return r.agg(a.alias("cross_passed"), b.alias("split_passed"), F.when(a & b, "reproducible").otherwise("not_reproducible").alias("decision"))


@query("e12_candidate_targets", _TC + """, bs AS (SELECT session, region, bin, hz - avg(hz) FILTER (time<0) OVER (PARTITION BY session, region) AS x FROM tc), pk AS (SELECT *, max(abs(x)) OVER (PARTITION BY session, region) AS m FROM bs),
 cd AS (SELECT 'baseline_subtracted' AS name, session, region, bin, x FROM bs UNION ALL SELECT 'region_peak_normalized', session, region, bin, CASE WHEN m>0 THEN x/m ELSE 0 END FROM pk UNION ALL SELECT 'temporal_derivative', session, region, bin, coalesce(x-lag(x) OVER (PARTITION BY session, region ORDER BY bin),0) FROM bs),
 rf AS (SELECT a.name, a.session, a.x, avg(b.x) AS ref FROM cd a JOIN cd b ON a.name=b.name AND a.region=b.region AND a.bin=b.bin AND a.session<>b.session GROUP BY a.name, a.session, a.region, a.bin, a.x), r AS (SELECT name, session, coalesce(corr(x,ref),0) AS real FROM rf GROUP BY 1,2) SELECT name, round(median(real),5) AS median_cross FROM r GROUP BY 1""")
def e12(t):
    """Three candidate transforms in one long table, each scored against the other sessions."""
    k2 = ["session", "region"]
    base = TS.baseline_subtract(timecourse(t).select(*k2, "time", F.col("hz").alias("x")), k2)
    tag = lambda d, n: d.select(F.lit(n).alias("name"), *k2, "time", "x")
    cd = tag(base, "baseline_subtracted").unionByName(tag(TS.peak_normalize(base, k2), "region_peak_normalized")).unionByName(tag(TS.derivative(base, k2), "temporal_derivative"))
    tot = cd.groupBy("name", "region", "time").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    r = cd.join(tot, ["name", "region", "time"]).withColumn("ref", (F.col("s") - F.col("x")) / (F.col("n") - 1))
    return r.groupBy("name", "session").agg(N.safe_corr(F.col("x"), F.col("ref")).alias("real")).groupBy("name").agg(F.round(F.median("real"), 5).alias("median_cross"))
