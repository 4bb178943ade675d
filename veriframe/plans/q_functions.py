"""Queries on scalar functions, filters, windows, sorts and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import hashing as H
from veriframe.functions import numeric as N
from veriframe.operators import ranking, selection
from veriframe.plans import bindings as B
from veriframe.plans.registry import query, values

r9 = lambda c: F.round(c, 9)
r6 = lambda c: F.round(c, 6)


@query("h01_stable_key", "SELECT o_orderkey, sha256('study:' || o_orderkey) AS key FROM orders")
def h01(t):
    return t.orders.select("o_orderkey", H.stable_key("study", F.col("o_orderkey")).alias("key"))


@query("h02_hash_modulo_partition", f"SELECT o_orderkey, {B.hash_mod_sql('o_custkey || chr(58) || o_orderkey', 5)} AS slot, CASE WHEN {B.hash_mod_sql('o_custkey || chr(58) || o_orderkey', 5)} IN (0,1,2) THEN 'calibration_context' ELSE 'locked_test' END AS role, {B.hash_mod_sql('o_custkey || chr(58) || o_orderkey', 3)} AS fold FROM orders")
def h02(t):
    text = F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    slot = H.hash_mod(text, 5)
    return t.orders.select("o_orderkey", slot.alias("slot"), F.when(slot.isin(0, 1, 2), "calibration_context").otherwise("locked_test").alias("role"), H.hash_mod(text, 3).alias("fold"))


@query("h05_whitespace_normalization", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest, length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS n FROM documents")
def h05(t):
    x = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return t.documents.select("doc_id", F.sha2(x, 256).alias("digest"), F.length(x).cast("bigint").alias("n"))


@query("h07_vector_parse", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem")
def h07(t):
    text = F.concat(F.lit("["), F.col("l_quantity").cast("string"), F.lit("  "), F.col("l_discount").cast("string"), F.lit(" "), F.col("l_tax").cast("string"), F.lit("]"))
    v = N.parse_vector(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


@query("h08_circular_similarity", "SELECT event_id, round(1 - least(r, 180-r)/90.0, 9) AS sim FROM (SELECT event_id, abs(value*3 - user_id) % 180 AS r FROM events)")
def h08(t):
    return t.events.select("event_id", r9(N.circular_similarity(F.col("value") * 3, F.col("user_id").cast("double"), 180.0)).alias("sim"))


@query("h09_zscore", "SELECT event_type, round(sum(z*z),6) AS ss, round(max(z),6) AS hi FROM (SELECT event_type, (value-m)/CASE WHEN s=0 THEN 1 ELSE s END AS z FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) USING (event_type)) GROUP BY 1")
def h09(t):
    m = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = t.events.join(m, "event_type").withColumn("z", N.zscore(F.col("value"), F.col("m"), F.col("s")))
    return z.groupBy("event_type").agg(r6(F.sum(F.col("z") * F.col("z"))).alias("ss"), r6(F.max("z")).alias("hi"))


@query("h10_signed_log1p", "SELECT c_custkey, round(sign(c_acctbal)*ln(1+abs(c_acctbal)),9) AS y FROM customer")
def h10(t):
    return t.customer.select("c_custkey", r9(N.signed_log1p(F.col("c_acctbal"))).alias("y"))


@query("h12_negative_log10", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(CASE WHEN d=0 THEN 300 WHEN d<0 THEN 0 ELSE -log10(greatest(d,1e-300)) END,9) AS y FROM (SELECT *, l_discount-l_tax AS d0, CASE WHEN l_discount<l_tax THEN -1.0 ELSE l_discount END AS d FROM lineitem)")
def h12(t):
    p = F.when(F.col("l_discount") < F.col("l_tax"), -1.0).otherwise(F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", r9(N.negative_log10(p)).alias("y"))


@query("h13_contrast_features", "SELECT event_id, round(ln(1+value),9) AS c, round(sin(radians(user_id*3)),9) AS s, round(cos(radians(user_id*3)),9) AS k, round(ln(1+value)*sin(radians(user_id*3)),9) AS cs, round(ln(1+value)*cos(radians(user_id*3)),9) AS ck FROM events")
def h13(t):
    c, a = F.log1p("value"), F.radians(F.col("user_id") * 3)
    return t.events.select("event_id", r9(c).alias("c"), r9(F.sin(a)).alias("s"), r9(F.cos(a)).alias("k"), r9(c * F.sin(a)).alias("cs"), r9(c * F.cos(a)).alias("ck"))


@query("h14_descriptor_vector", "SELECT s_suppkey, round(list_sum(v),9) AS total, len(v) AS width FROM (SELECT s_suppkey, [ln(1+s_acctbal), sign(q)*ln(1+abs(q)), d, x] AS v FROM (SELECT l_suppkey, avg(l_quantity) AS q, ln(1+avg(l_discount)) AS d, ln(1+max(l_tax)) AS x FROM lineitem GROUP BY 1) JOIN (SELECT s_suppkey, abs(s_acctbal) AS s_acctbal FROM supplier) ON s_suppkey=l_suppkey)")
def h14(t):
    """Numeric coercion and signed log of the descriptor columns, packed as one array."""
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.max("l_tax").alias("x"))
    d = t.supplier.withColumn("a", F.abs("s_acctbal")).join(per, "s_suppkey")
    v = F.array(*[N.signed_log1p(F.col(c).cast("string").try_cast("double")) for c in ("a", "q", "d", "x")])
    return d.select("s_suppkey", r9(F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e)).alias("total"), F.size(v).cast("bigint").alias("width"))


@query("h15_rounded_levels", "SELECT round(l_discount,12) AS level, count(*) AS n FROM lineitem GROUP BY 1")
def h15(t):
    return t.lineitem.groupBy(N.stable_level(F.col("l_discount")).alias("level")).agg(F.count("*").alias("n"))


_Z = "1.959963984540054"


@query("h16_wilson_interval", f"SELECT l_suppkey, k, n, round(greatest(0,(p+{_Z}*{_Z}/(2*n))/(1+{_Z}*{_Z}/n) - {_Z}*sqrt(p*(1-p)/n+{_Z}*{_Z}/(4*n*n))/(1+{_Z}*{_Z}/n)),9) AS low, round(least(1,(p+{_Z}*{_Z}/(2*n))/(1+{_Z}*{_Z}/n) + {_Z}*sqrt(p*(1-p)/n+{_Z}*{_Z}/(4*n*n))/(1+{_Z}*{_Z}/n)),9) AS high FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag='R') AS k, count(*) AS n, count(*) FILTER (l_returnflag='R')::DOUBLE/count(*) AS p FROM lineitem GROUP BY 1)".replace(_Z, f"({_Z}::DOUBLE)"))
def h16(t):
    d = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    lo, hi = N.wilson(F.col("k"), F.col("n"))
    return d.select("l_suppkey", "k", "n", r9(lo).alias("low"), r9(hi).alias("high"))


@query("h20_r_squared", "SELECT l_suppkey, round(CASE WHEN var_pop(l_extendedprice)=0 THEN 0 ELSE 1 - sum(pow(l_extendedprice-1400*l_quantity,2))/(var_pop(l_extendedprice)*count(*)) END,6) AS r2 FROM lineitem GROUP BY 1")
def h20(t):
    y, p = F.col("l_extendedprice"), F.col("l_quantity") * 1400
    v = F.var_pop(y)
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.when(v == 0, 0.0).otherwise(1 - F.sum((y - p) * (y - p)) / (v * F.count("*")))).alias("r2"))


@query("h21_tjur_r_squared", "SELECT l_suppkey, round(CASE WHEN count(DISTINCT l_linestatus)<2 THEN 0 ELSE avg(l_discount) FILTER (l_linestatus='F') - avg(l_discount) FILTER (l_linestatus='O') END,9) AS tjur FROM lineitem GROUP BY 1")
def h21(t):
    y = F.col("l_linestatus") == "F"
    diff = F.avg(F.when(y, F.col("l_discount"))) - F.avg(F.when(~y, F.col("l_discount")))
    return t.lineitem.groupBy("l_suppkey").agg(r9(F.coalesce(diff, F.lit(0.0))).alias("tjur"))


def confusion_scores(df, observed, predicted):
    """Macro recall and multiclass correlation from the (observed, predicted) counts."""
    cells = df.groupBy(F.col(observed).alias("o"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy("o").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("o") == F.col("p"), F.col("n")).otherwise(0.0)).alias("hit"))
    cols = cells.groupBy(F.col("p").alias("o")).agg(F.sum("n").alias("pt"))
    j = rows.join(cols, "o", "full").na.fill(0.0, ["t", "hit", "pt"])
    a = j.agg(F.avg(F.when(F.col("t") > 0, F.col("hit") / F.col("t"))).alias("macro_recall"), F.sum("hit").alias("c"), F.sum("t").alias("s"),
              F.sum(F.col("t") * F.col("pt")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("pt") * F.col("pt")).alias("pp"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return a.select("macro_recall", F.when(den == 0, 0.0).otherwise((F.col("c") * F.col("s") - F.col("tp")) / den).alias("mcc"))


@query("h22_macro_recall_and_mcc", """WITH c AS (SELECT l_returnflag AS o, CASE WHEN l_tax<0.03 THEN 'A' WHEN l_discount<0.05 THEN 'N' ELSE 'R' END AS p, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1,2),
 r AS (SELECT o, sum(n) AS t, sum(CASE WHEN o=p THEN n ELSE 0 END) AS hit FROM c GROUP BY 1), q AS (SELECT p AS o, sum(n) AS pt FROM c GROUP BY 1)
 SELECT round(avg(hit/t),9) AS macro_recall, round((sum(hit)*sum(t)-sum(t*pt))/sqrt((sum(t)*sum(t)-sum(pt*pt))*(sum(t)*sum(t)-sum(t*t))),9) AS mcc FROM r JOIN q USING (o)""")
def h22(t):
    d = t.lineitem.select("l_returnflag", F.when(F.col("l_tax") < 0.03, "A").when(F.col("l_discount") < 0.05, "N").otherwise("R").alias("guess"))
    return confusion_scores(d, "l_returnflag", "guess").select(r9("macro_recall").alias("macro_recall"), r9("mcc").alias("mcc"))


@query("h23_boolean_coercion", "SELECT flag, count(*) AS n FROM (SELECT CASE o_custkey%4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE NULL END AS flag FROM orders) GROUP BY 1")
def h23(t):
    text = F.element_at(F.array(F.lit(" TRUE"), F.lit("1"), F.lit("False "), F.lit("maybe")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return t.orders.groupBy(N.truthy(text).alias("flag")).agg(F.count("*").alias("n"))


@query("h24_subject_key", "SELECT CASE WHEN s_suppkey%2=0 THEN 'dynamic'||s_suppkey ELSE s_name END AS key, s_suppkey FROM supplier")
def h24(t):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("run/dynamic"), "s_suppkey", F.lit("-abc"))).otherwise(F.col("s_name"))
    return t.supplier.select(N.mouse_key(name).alias("key"), "s_suppkey")


@query("h28_block_replacement", f"WITH {B.EVIDENCE_SQL} SELECT package_id, block, CASE WHEN block='prediction' AND o_orderstatus='F' THEN 'failed' ELSE status END AS status FROM evidence JOIN packages USING (package_id)")
def h28(t):
    ev = B.evidence(t).select("package_id", "block", "status")
    new = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("package_id"), F.lit("prediction").alias("block"), F.lit("failed").alias("status"))
    joined = ev.join(new.withColumnRenamed("status", "replacement"), ["package_id", "block"], "left")
    return joined.select("package_id", "block", F.coalesce("replacement", "status").alias("status"))


@query("h29_split_roles", "SELECT CASE WHEN o_orderkey%5 IN (0,1,2) THEN 'model_fit' WHEN o_orderkey%5=3 THEN 'threshold_calibration' ELSE 'locked_development_audit' END AS role, count(*) AS n FROM orders GROUP BY 1")
def h29(t):
    return t.orders.groupBy(N.split_role(F.col("o_orderkey")).alias("role")).agg(F.count("*").alias("n"))


_BLOCKS = tuple(B.V2.block_index())
_STATUSES = ("passed", "failed", "requires_review", "unknown", "not_applicable")
_HOT = [f"max((block='{b}' AND status='{s}')::INT)::DOUBLE AS {b}__{s}" for b in _BLOCKS for s in _STATUSES]
_HOT += [f"1.0::DOUBLE - max((block='{b}')::INT) AS {b}__missing" for b in _BLOCKS]


@query("h27_block_one_hot", f"WITH {B.EVIDENCE_SQL} SELECT package_id, {', '.join(_HOT)} FROM evidence GROUP BY 1")
def h27(t):
    """Every status of every block of the profile, and whether the block is absent."""
    hot = []
    for b in _BLOCKS:
        for s in _STATUSES:
            hot.append(F.max(F.when((F.col("block") == b) & (F.col("status") == s), 1.0).otherwise(0.0)).alias(f"{b}__{s}"))
        hot.append((F.lit(1.0) - F.max(F.when(F.col("block") == b, 1.0).otherwise(0.0))).alias(f"{b}__missing"))
    return B.evidence(t).groupBy("package_id").agg(*hot)


# ---- filters ---------------------------------------------------------------

@query("p08_unit_quality_filter", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag='N' AND l_linestatus='F' AND l_discount<0.1 AND l_quantity/50>0.9 AND l_tax<0.05")
def p08(t):
    d = t.lineitem
    # Amplitude cutoff below 0.1, presence ratio above 0.9, violations below 0.5 (here tax times ten).
    good = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.1) & (F.col("l_quantity") / 50 > 0.9) & (F.col("l_tax") < 0.05)
    return d.filter(good).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("p09_change_event_filter", "SELECT event_id, user_id FROM events WHERE event_type='error' AND value>=1 AND value<150")
def p09(t):
    return t.events.filter((F.col("event_type") == "error") & (F.col("value") >= 1) & (F.col("value") < 150)).select("event_id", "user_id")


@query("p10_usable_units", "SELECT l_suppkey AS root_id, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem WHERE l_discount>0) WHERE rn=1")
def p10(t):
    """First usable row per root, as a minimum over (file order) instead of a sort per root."""
    usable = t.lineitem.withColumn("probe", F.when(F.col("l_discount") > 0, F.col("l_discount"))).dropna(subset=["probe"])
    first = usable.groupBy(F.col("l_suppkey").alias("root_id")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("f"))
    return first.select("root_id", "f.l_orderkey", "f.l_linenumber")


@query("p11_usable_edges", "SELECT l_suppkey AS pre, l_partkey%(SELECT count(*) FROM supplier) AS post, count(*) AS n, round(sum(CASE WHEN l_tax=0 THEN 1.0 ELSE l_tax END),6) AS size FROM lineitem WHERE l_suppkey<>l_partkey%(SELECT count(*) FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>0) AND l_partkey%(SELECT count(*) FROM supplier) IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>0) GROUP BY 1,2")
def p11(t):
    n = t.supplier.count()
    roots = t.supplier.filter("s_acctbal > 0").select("s_suppkey")
    e = t.lineitem.select(F.col("l_suppkey").alias("pre"), (F.col("l_partkey") % n).alias("post"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("size")).filter("pre <> post")
    e = e.join(roots.withColumnRenamed("s_suppkey", "pre"), "pre", "left_semi").join(roots.withColumnRenamed("s_suppkey", "post"), "post", "left_semi")
    return e.groupBy("pre", "post").agg(F.count("*").alias("n"), r6(F.sum(F.coalesce("size", F.lit(1.0)))).alias("size"))


@query("p12_usable_trials", "WITH u AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS rightward, round(sum(100*((CASE WHEN event_type='click' THEN value ELSE 0 END) - (CASE WHEN event_type='view' THEN value ELSE 0 END))),4) AS signed FROM events WHERE event_type IN ('click','view') GROUP BY 1) SELECT user_id, n, rightward::BIGINT AS rightward, signed FROM u WHERE n>=10")
def p12(t):
    e = t.events.withColumn("choice", F.when(F.col("event_type") == "click", "-1").when(F.col("event_type") == "view", "1").otherwise("none").try_cast("double"))
    right = F.when(F.col("event_type") == "click", F.col("value"))
    left = F.when(F.col("event_type") == "view", F.col("value"))
    ok = e.filter(F.col("choice").isin(-1.0, 1.0)).withColumn("signed", 100.0 * (F.coalesce(right, F.lit(0.0)) - F.coalesce(left, F.lit(0.0))))
    g = ok.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == -1.0).alias("rightward"), F.round(F.sum("signed"), 4).alias("signed"))
    return g.filter("n >= 10")


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("p13_eligible_columns", "SELECT name, n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, stddev_pop({c}) AS s FROM lineitem" for c in _NUM) + ") WHERE n>=100 AND s>1e-8")
def p13(t):
    """All candidate columns in one pass, unpivoted after the aggregate."""
    agg = t.lineitem.agg(*[F.count(c).alias(f"n_{c}") for c in _NUM], *[F.stddev_pop(c).alias(f"s_{c}") for c in _NUM])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("s")) for c in _NUM])
    return agg.select(F.explode(rows).alias("r")).select("r.*").filter("n >= 100 and s > 1e-8").select("name", "n")


@query("p14_strong_perturbations", "SELECT p_partkey, split_part(p_name,' ',-1) AS gene FROM (SELECT l_partkey, count(*) AS cells, sum(CAST(l_discount AS DECIMAL(18,6))) AS total, count(l_discount) AS n, count(DISTINCT l_suppkey) AS degs FROM lineitem GROUP BY 1) JOIN part ON p_partkey=l_partkey WHERE degs>5 AND total>=0.03*n AND cells>25")
def p14(t):
    """Knock-down (-10 times the mean discount) of -0.3 or less; the mean is exact, so that a part on the limit doesn't hang on the order of a sum."""
    per = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("cells"), F.sum(F.col("l_discount").cast("decimal(18,6)")).alias("total"), F.count("l_discount").alias("n"), F.count_distinct("l_suppkey").alias("degs"))
    ok = per.filter("degs > 5 and total >= 0.03 * n and cells > 25")
    return ok.join(t.part, "p_partkey").select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("gene"))


@query("p15_clean_revision", "SELECT l_suppkey, count(*) FILTER (l_returnflag<>'R' AND l_linestatus='F') AS clean, count(*) AS n FROM lineitem GROUP BY 1")
def p15(t):
    rev = F.when(F.col("l_returnflag") == "R", F.lit("abc-dirty")).when(F.col("l_linestatus") == "O", F.lit("unknown")).otherwise(F.lit("abc"))
    clean = rev.isNotNull() & ~rev.endswith("-dirty") & (rev != "unknown")
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(clean).alias("clean"), F.count("*").alias("n"))


@query("p16_asset_choice", "SELECT o_custkey, count(*) FILTER (o_orderstatus='F' AND o_orderpriority IN ('1-URGENT','2-HIGH')) AS n_default, CASE WHEN count(*) FILTER (o_orderstatus='F' AND o_orderpriority IN ('1-URGENT','2-HIGH'))=1 THEN min(o_orderkey) FILTER (o_orderstatus='F' AND o_orderpriority IN ('1-URGENT','2-HIGH')) END AS chosen FROM orders GROUP BY 1")
def p16(t):
    """Default, quality-passed, public assets per subject; only a unique one is chosen."""
    ok = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    g = t.orders.groupBy("o_custkey").agg(F.count_if(ok).alias("n_default"), F.min(F.when(ok, F.col("o_orderkey"))).alias("only"))
    return g.select("o_custkey", "n_default", F.when(F.col("n_default") == 1, F.col("only")).alias("chosen"))


@query("p17_catalog_path_selection", "SELECT user_id, min(path) AS path FROM (SELECT user_id, 'sub-'||user_id||'/'||event_type||'_'||event_id||'.nwb' AS path, event_type FROM events) WHERE event_type='view' GROUP BY 1")
def p17(t):
    path = F.concat(F.lit("sub-"), "user_id", F.lit("/"), "event_type", F.lit("_"), "event_id", F.lit(".nwb"))
    ok = t.events.withColumn("path", path).filter(F.col("path").endswith(".nwb") & F.col("path").contains("/view_"))
    return ok.groupBy("user_id").agg(F.min_by("path", "path").alias("path"))


@query("p19_gate_audit", """WITH g AS (SELECT l_orderkey, bool_or(l_returnflag='N') AS prediction, bool_or(l_tax=0.0) AS ood, max(l_quantity)>40 AS twin FROM lineitem GROUP BY 1), w(wording, needs) AS (VALUES ('predictive model','prediction'),('robust model','prediction'),('robust model','ood'),('digital twin','prediction'),('digital twin','ood'),('digital twin','twin'))
 SELECT l_orderkey AS case_id, wording, bool_and(CASE needs WHEN 'prediction' THEN prediction WHEN 'ood' THEN ood ELSE twin END) AS allowed, coalesce(string_agg(needs,'|' ORDER BY needs) FILTER (NOT CASE needs WHEN 'prediction' THEN prediction WHEN 'ood' THEN ood ELSE twin END),'') AS missing FROM g CROSS JOIN w GROUP BY 1,2""")
def p19(t):
    """Wording is allowed only if each of its flag gates holds; gates are a literal table."""
    table = {"predictive model": ["prediction"], "robust model": ["ood", "prediction"], "digital twin": ["ood", "prediction", "twin"]}
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.bool_or(F.col("l_returnflag") == "N").alias("prediction"), F.bool_or(F.col("l_tax") == 0.0).alias("ood"), (F.max("l_quantity") > 40).alias("twin"))
    rows = F.array(*[F.struct(F.lit(w).alias("wording"), F.array_compact(F.array(*[F.when(~F.col(f), F.lit(f)) for f in flags])).alias("missing")) for w, flags in table.items()])
    return g.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.wording", (F.size("r.missing") == 0).alias("allowed"), F.array_join("r.missing", "|").alias("missing"))


@query("p20_manifest_pilot_gate", "SELECT l_suppkey, CASE WHEN r<2 THEN 'missing_fields' WHEN n>=500 AND d>=50 THEN 'ready_for_pilot' ELSE 'insufficient_size' END AS decision FROM (SELECT l_suppkey, count(DISTINCT l_linestatus) AS r, count(*) AS n, count(DISTINCT l_partkey) AS d FROM lineitem WHERE l_tax<0.08 GROUP BY 1)")
def p20(t):
    g = t.lineitem.filter("l_tax < 0.08").groupBy("l_suppkey").agg(F.collect_set("l_linestatus").alias("have"), F.count("*").alias("n"), F.count_distinct("l_partkey").alias("d"))
    missing = F.size(F.array_except(F.array(F.lit("F"), F.lit("O")), F.col("have"))) > 0
    return g.select("l_suppkey", F.when(missing, "missing_fields").when((F.col("n") >= 500) & (F.col("d") >= 50), "ready_for_pilot").otherwise("insufficient_size").alias("decision"))


@query("p21_failure_taxonomy", "SELECT CASE WHEN l_tax=0 THEN 'semantic_gate' WHEN l_discount<0.02 THEN 'low_score' WHEN l_returnflag='R' THEN 'false_authorization' WHEN l_linestatus='O' THEN 'missed_positive' ELSE 'correct' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def p21(t):
    reason = (F.when(F.col("l_tax") == 0, "semantic_gate").when(F.col("l_discount") < 0.02, "low_score").when(F.col("l_returnflag") == "R", "false_authorization")
              .when(F.col("l_linestatus") == "O", "missed_positive").otherwise("correct"))
    return t.lineitem.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


SCOPE = {"domain": "o_orderstatus", "population": "o_orderpriority"}


@query("p23_scope_check", "SELECT status AS decision, blockers, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus='F' AND o_orderpriority='1-URGENT' AND o_totalprice<=400000 THEN 'in_scope' ELSE 'outside_guarantee' END AS status, concat_ws('|', CASE WHEN o_orderstatus<>'F' THEN 'domain' END, CASE WHEN o_orderpriority<>'1-URGENT' THEN 'population' END, CASE WHEN o_totalprice>400000 THEN 'detected_shift' END) AS blockers FROM orders) GROUP BY 1,2")
def p23(t):
    """Null-safe comparison of the target scope with the calibration scope, plus a shift flag."""
    cal = {"domain": "F", "population": "1-URGENT"}
    checks = [F.when(~F.col(SCOPE[k]).eqNullSafe(v), F.lit(k)) for k, v in cal.items()] + [F.when(F.col("o_totalprice") > 400000, F.lit("detected_shift"))]
    b = F.array_compact(F.array(*checks))
    return t.orders.select(F.when(F.size(b) == 0, "in_scope").otherwise("outside_guarantee").alias("decision"), F.array_join(b, "|").alias("blockers")).groupBy("decision", "blockers").agg(F.count("*").alias("n"))


@query("p24_scope_fingerprint", """SELECT sha256('{"domain":"' || o_orderstatus || '","population":"' || o_orderpriority || '"}') AS fingerprint, count(*) AS n FROM orders GROUP BY 1""")
def p24(t):
    body = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in sorted(SCOPE.items())]))
    return t.orders.groupBy(F.sha2(body, 256).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("p25_pair_preparation", """WITH r AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY sha256('pair:'||l_orderkey||'-'||l_linenumber||'-'||l_partkey), l_orderkey||'-'||l_linenumber||'-'||l_partkey) AS rn FROM lineitem WHERE l_tax>0),
 s AS (SELECT * FROM r WHERE rn<=200), m AS (SELECT l_suppkey, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, count(*) AS n FROM s GROUP BY 1 HAVING count(*)>=20)
 SELECT l_suppkey AS pair, max(n) AS n, round(sum((x-mx)/sx*(y-my)/sy),5) AS xy FROM s JOIN m USING (l_suppkey) GROUP BY 1""")
def p25(t):
    """Finite rows, hash subsample, at least 20 rows, standardized, flat pairs refused."""
    d = t.lineitem.filter("l_tax > 0 and not isnan(l_quantity) and not isnan(l_extendedprice)").select(
        F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    s = ranking.hash_rank(d, ["pair"], F.col("id"), "pair").filter("rn <= 200").drop("n")
    m = s.groupBy("pair").agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"), F.count("*").alias("n")).filter("n >= 20 and sx > 0 and sy > 0")
    z = s.join(m, "pair").withColumn("xy", N.zscore(F.col("x"), F.col("mx"), F.col("sx")) * N.zscore(F.col("y"), F.col("my"), F.col("sy")))
    return z.groupBy("pair").agg(F.max("n").alias("n"), F.round(F.sum("xy"), 5).alias("xy"))


# ---- windows ---------------------------------------------------------------

@query("w01_balanced_folds", "SELECT c_custkey, (rn-1)%3 AS fold FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('folds:'||c_custkey), c_custkey) AS rn FROM customer) WHERE (rn-1)//3 < 15")
def w01(t):
    return selection.balanced_folds(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], F.col("c_custkey"), "folds", 3, 15).select("c_custkey", "fold")


@query("w02_unit_folds", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('units:'||o_orderkey), o_orderkey)-1)%3 AS fold FROM orders")
def w02(t):
    return selection.balanced_folds(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], F.col("o_orderkey"), "units").select("o_orderkey", "fold")


_EV_RANK = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n"
def micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("w03_chronological_split", f"SELECT event_id, CASE WHEN rn-1 < floor(round(n*0.6,9)) THEN 'train' WHEN rn-1 >= floor(round(n*0.8,9)) THEN 'test' ELSE 'between' END AS role FROM (SELECT event_id, {_EV_RANK} FROM events)")
def w03(t):
    return selection.chronological_split(t.events.select("event_id", "user_id", micros().alias("us")), ["user_id"], F.col("us"), [F.col("event_id")]).select("event_id", "role")


@query("w04_odd_even_split", f"SELECT user_id, (rn-1)%2 AS half, count(*) AS n, round(avg(value),6) AS mean FROM (SELECT user_id, value, {_EV_RANK} FROM events) GROUP BY 1,2")
def w04(t):
    d = ranking.value_rank(t.events.select("event_id", "user_id", "value", micros().alias("us")), ["user_id"], F.col("us"), [F.col("event_id")])
    return d.groupBy("user_id", ((F.col("rn") - 1) % 2).alias("half")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("w05_first_second_half", f"SELECT user_id, rn > n//2 AS second, count(*) AS cnt, round(avg(value),6) AS mean FROM (SELECT user_id, value, {_EV_RANK} FROM events) GROUP BY 1,2")
def w05(t):
    d = ranking.value_rank(t.events.select("event_id", "user_id", "value", micros().alias("us")), ["user_id"], F.col("us"), [F.col("event_id")])
    return d.groupBy("user_id", (F.col("rn") > F.floor(F.col("n") / 2)).alias("second")).agg(F.count("*").alias("cnt"), r6(F.avg("value")).alias("mean"))


def repeat_reliability(trials):
    """Halves of the repeats per (neuron, stimulus), correlated per neuron."""
    d = ranking.hash_rank(trials, ["neuron", "stimulus"], F.col("trial"), "repeat").filter("n > 1")
    half = d.groupBy("neuron", "stimulus").agg(
        F.avg(F.when(F.col("rn") <= F.floor(F.col("n") / 2), F.col("y"))).alias("a"), F.avg(F.when(F.col("rn") > F.floor(F.col("n") / 2), F.col("y"))).alias("b"))
    return half.groupBy("neuron").agg(N.safe_corr(F.col("a"), F.col("b")).alias("r"))


@query("w06_repeat_reliability", """WITH t AS (SELECT l_linenumber AS neuron, l_suppkey AS stimulus, l_orderkey||'-'||l_partkey AS trial, l_quantity AS y FROM lineitem),
 d AS (SELECT *, row_number() OVER (PARTITION BY neuron, stimulus ORDER BY sha256('repeat:'||trial), trial, y) AS rn, count(*) OVER (PARTITION BY neuron, stimulus) AS n FROM t),
 h AS (SELECT neuron, stimulus, avg(y) FILTER (rn<=n//2) AS a, avg(y) FILTER (rn>n//2) AS b FROM d WHERE n>1 GROUP BY 1,2), r AS (SELECT neuron, corr(a,b) AS r FROM h GROUP BY 1)
 SELECT round(median(r),9) AS median_reliability, count(*) AS neurons FROM r""")
def w06(t):
    tr = t.lineitem.select(F.col("l_linenumber").alias("neuron"), F.col("l_suppkey").alias("stimulus"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("trial"), F.col("l_quantity").alias("y"))
    r = repeat_reliability(tr)
    return r.agg(F.count("*").alias("neurons")).withColumn("median_reliability", r9(ranking.median_of(r, "r")))


@query("w07_strided_cohort", "WITH d AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), c AS (SELECT o_orderkey, row_number() OVER (ORDER BY i) - 1 AS j, count(*) OVER () AS n FROM d WHERE i%5=2), p AS (SELECT DISTINCT floor(round(k*(n-1)/999.0,9))::BIGINT AS pos FROM (SELECT max(n) AS n FROM c), range(1000) r(k)) SELECT o_orderkey FROM c WHERE n<=1000 OR j IN (SELECT pos FROM p)")
def w07(t):
    d = ranking.value_rank(t.orders.select("o_orderkey"), [], F.col("o_orderkey"), [])
    cohort = d.filter((F.col("rn") - 1) % 5 == 2).select("o_orderkey")
    return selection.thin_evenly(cohort, [], F.col("o_orderkey"), [], 1000).select("o_orderkey")


def p_table(t):
    return t.part.select("p_partkey", "p_brand", H.hash_unit(F.concat(F.lit("p:"), F.col("p_partkey").cast("string"))).alias("p"))


_P = f"SELECT p_partkey, p_brand, {B.hash_unit_sql(chr(39) + 'p:' + chr(39) + '||p_partkey')} AS p FROM part"


@query("w08_benjamini_hochberg", f"WITH a AS ({_P}), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS rk, count(*) OVER (PARTITION BY p_brand) AS n FROM a) SELECT p_partkey, round(least(1.0, min(p*n/rk) OVER (PARTITION BY p_brand ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),9) AS q FROM r")
def w08(t):
    return ranking.benjamini_hochberg(p_table(t), ["p_brand"], "p").select("p_partkey", r9("q").alias("q"))


@query("w09_holm", f"WITH a AS (SELECT p_partkey, p_brand, p*p*p*p*p AS p FROM ({_P})), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS rk, count(*) OVER (PARTITION BY p_brand) AS n FROM a) SELECT p_partkey, min((p <= 0.05/(n-rk+1))::INT) OVER (PARTITION BY p_brand ORDER BY rk) = 1 AS rejected FROM r")
def w09(t):
    d = p_table(t).withColumn("p", F.col("p") * F.col("p") * F.col("p") * F.col("p") * F.col("p"))
    return ranking.holm(d, ["p_brand"], "p", "p_partkey", 0.05).select("p_partkey", "rejected")


@query("w10_bonferroni", f"WITH a AS ({_P}) SELECT p_partkey, round(least(1.0, p*n),9) AS adjusted, round(1-0.05/n,9) AS confidence FROM a JOIN (SELECT p_brand, count(*) AS n FROM a GROUP BY 1) USING (p_brand)")
def w10(t):
    d = p_table(t)
    n = d.groupBy("p_brand").agg(F.count("*").alias("n"))
    return d.join(n, "p_brand").select("p_partkey", r9(F.least(F.lit(1.0), F.col("p") * F.col("n"))).alias("adjusted"), r9(1 - 0.05 / F.col("n")).alias("confidence"))


def reference_bins(values, column, reference, ref_column, q):
    """Right-closed bins from the quantiles of a reference; outer edges are open."""
    cuts = ranking.exact_quantiles(reference, [], ref_column, [i / q for i in range(1, q)]).select(F.array_distinct("q"))
    edges = reference.agg(F.min(ref_column).alias("lo"), F.max(ref_column).alias("hi")).withColumn("e", cuts.scalar())
    edges = edges.select(F.filter("e", lambda x: (x > F.col("lo")) & (x < F.col("hi"))).alias("edges"), (F.col("lo") < F.col("hi")).alias("ok"))
    one = values.withColumn("_one", F.lit(1)).join(F.broadcast(edges.withColumn("_one", F.lit(1))), "_one")
    return one.withColumn("bin", F.when(F.col("ok"), F.size(F.filter("edges", lambda e: e < F.col(column))).cast("bigint"))).drop("_one", "edges", "ok")


@query("w11_reference_bins", "SELECT c_custkey, (SELECT count(*) FROM (SELECT unnest(quantile_cont(s_acctbal,[0.2,0.4,0.6,0.8])) AS e FROM supplier) WHERE e < c_acctbal) AS bin FROM customer")
def w11(t):
    return reference_bins(t.customer, "c_acctbal", t.supplier, "s_acctbal", 5).select("c_custkey", "bin")


_MODELS = ("N", "A", "R")


# Mean discount to four places, halves away from zero, from whole millionths: no half hangs on the order of a sum.
_CORR4 = "CASE WHEN m < 0 THEN -1 ELSE 1 END * ((2 * abs(m) + 100 * n) {div} (200 * n)) / 1e4"


@query("w21_best_model", f"SELECT subject, model, corr FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY corr DESC, CASE model WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS rn FROM (SELECT subject, model, {_CORR4.format(div='//')} AS corr FROM (SELECT l_suppkey AS subject, l_returnflag AS model, sum(CAST(round(l_discount*1e6) AS BIGINT)) AS m, count(l_discount) AS n FROM lineitem GROUP BY 1,2))) WHERE rn=1")
def w21(t):
    pos = F.create_map(*[x for i, m in enumerate(_MODELS) for x in (F.lit(m), F.lit(i))])[F.col("model")]
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("model")).agg(
        F.sum(F.round(F.col("l_discount") * 1e6).cast("bigint")).alias("m"), F.count("l_discount").alias("n"))
    per = per.select("subject", "model", F.expr(_CORR4.format(div="div")).alias("corr"))
    best = per.groupBy("subject").agg(F.max_by(F.struct("model", "corr"), F.struct("corr", -pos)).alias("b"))
    return best.select("subject", "b.model", "b.corr")


@query("w22_one_per_subject", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('probe:'||event_id), event_id) AS rn FROM events) WHERE rn=1")
def w22(t):
    return selection.first_by_hash(t.events, ["user_id"], F.col("event_id"), "probe", ["event_id"])


@query("w23_stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('items:'||doc_id), doc_id) AS rn FROM documents) WHERE rn<=30 ORDER BY sha256('items:'||doc_id) LIMIT 100")
def w23(t):
    return selection.stratified_sample(t.documents.select("doc_id", "lang"), "lang", F.col("doc_id"), "items", 30, 100).select("doc_id", "lang")


_SIZES = [(100, 0), (100, 1), (500, 0), (500, 1)]


@query("w24_subsamples", "WITH r AS (SELECT o_orderkey, k AS repeat, row_number() OVER (PARTITION BY k ORDER BY sha256('sub:'||k||':'||o_orderkey), o_orderkey) AS rn FROM orders, range(2) x(k)), z(size) AS (VALUES (100),(500)) SELECT size::INT AS size, repeat::INT AS repeat, o_orderkey FROM r JOIN z ON rn<=size")
def w24(t):
    return selection.subsamples(t.orders.select("o_orderkey"), F.col("o_orderkey"), _SIZES, "sub").select("size", "repeat", "o_orderkey")


def spearman(df, group, x, y):
    """Rank correlation from tie-averaged ranks joined back on the values."""
    rx = ranking.average_ranks(df, group, x).select(*group, x, F.col("avg_rank").alias("rx"))
    ry = ranking.average_ranks(df, group, y).select(*group, y, F.col("avg_rank").alias("ry"))
    d = df.select(*group, x, y).join(rx, [*group, x]).join(ry, [*group, y])
    return d.groupBy(*group).agg(N.safe_corr(F.col("rx"), F.col("ry")).alias("rho"), F.count("*").alias("n"))


@query("w25_spearman", "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity)-1)/2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount)-1)/2.0 AS ry FROM lineitem) SELECT l_returnflag, round(corr(rx::DOUBLE, ry::DOUBLE),9) AS rho, count(*) AS n FROM r GROUP BY 1")
def w25(t):
    return spearman(t.lineitem, ["l_returnflag"], "l_quantity", "l_discount").withColumn("rho", r9("rho"))


@query("w26_risk_coverage_area", """WITH g AS (SELECT k/10.0::DOUBLE AS thr, avg((l_discount*10>=k/10.0)::INT) AS cov, coalesce(avg((l_returnflag='R')::INT) FILTER (l_discount*10>=k/10.0),0) AS risk FROM lineitem, range(11) r(k) GROUP BY 1),
 l AS (SELECT *, lag(cov) OVER (ORDER BY cov, thr DESC) AS lc, lag(risk) OVER (ORDER BY cov, thr DESC) AS lr FROM g) SELECT round(sum((cov-lc)*(risk+lr)/2),9) AS area, count(*) AS points FROM l""")
def w26(t):
    """Grid counts in one pass over the rows; the trapezoid runs over the eleven grid points."""
    from pyspark.sql import Window as W

    thr = [k / 10.0 for k in range(11)]
    score, bad = F.col("l_discount") * 10, F.col("l_returnflag") == "R"
    agg = t.lineitem.agg(F.count("*").alias("n"), *[F.count_if(score >= v).alias(f"c{i}") for i, v in enumerate(thr)], *[F.count_if((score >= v) & bad).alias(f"b{i}") for i, v in enumerate(thr)])
    rows = F.array(*[F.struct(F.lit(v).alias("thr"), (F.col(f"c{i}") / F.col("n")).alias("cov"), F.coalesce(F.try_divide(F.col(f"b{i}"), F.col(f"c{i}")), F.lit(0.0)).alias("risk")) for i, v in enumerate(thr)])
    g = agg.select(F.explode(rows).alias("r")).select("r.*")
    w = W.partitionBy(F.lit(0)).orderBy("cov", F.col("thr").desc())
    d = g.select("cov", "risk", F.lag("cov").over(w).alias("lc"), F.lag("risk").over(w).alias("lr"))
    return d.agg(r9(F.sum((F.col("cov") - F.col("lc")) * (F.col("risk") + F.col("lr")) / 2)).alias("area"), F.count("*").alias("points"))


@query("w27_train_standardization", "WITH m AS (SELECT l_suppkey, avg(l_quantity) AS m, CASE WHEN stddev_pop(l_quantity)=0 THEN 1 ELSE stddev_pop(l_quantity) END AS s FROM lineitem WHERE l_returnflag<>'R' GROUP BY 1) SELECT l_suppkey, round(avg((l_quantity-m)/s),9) AS z FROM lineitem JOIN m USING (l_suppkey) WHERE l_returnflag='R' GROUP BY 1")
def w27(t):
    m = t.lineitem.filter("l_returnflag <> 'R'").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    test = t.lineitem.filter("l_returnflag = 'R'").join(m, "l_suppkey")
    return test.groupBy("l_suppkey").agg(r9(F.avg(N.zscore(F.col("l_quantity"), F.col("m"), F.col("s")))).alias("z"))


# ---- sorts and limits --------------------------------------------------------

@query("t02_hash_top_n", "SELECT p_partkey FROM part ORDER BY sha256('genes:'||p_partkey) LIMIT 60")
def t02(t):
    return selection.top_by_hash(t.part.select("p_partkey"), F.col("p_partkey"), "genes", 60)


@query("t03_offset_limit", "SELECT s_suppkey FROM supplier WHERE s_acctbal>0 ORDER BY s_suppkey LIMIT 30 OFFSET 20")
def t03(t):
    return t.supplier.filter("s_acctbal > 0").select("s_suppkey").orderBy("s_suppkey").offset(20).limit(30)


@query("t04_top_categories", "SELECT category, n FROM (SELECT p_brand||'->'||p_type AS category, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, category LIMIT 5")
def t04(t):
    return t.part.groupBy(F.concat_ws("->", "p_brand", "p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(5)


@query("t05_top_tests", f"WITH a AS ({_P}), r AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS n FROM a), q AS (SELECT p_partkey, least(1.0, min(p*n/rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, p FROM r) SELECT p_partkey, round(q,9) AS q FROM q ORDER BY q, p LIMIT 10")
def t05(t):
    return ranking.benjamini_hochberg(p_table(t), [], "p").orderBy("q", "p").limit(10).select("p_partkey", r9("q").alias("q"))


@query("t10_pareto_frontier", """WITH p AS (SELECT l_suppkey AS id, round(avg(l_extendedprice),2) AS cost, round(avg(l_discount),6) AS gain, (l_suppkey%4) AS claims FROM lineitem GROUP BY 1)
 SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.cost<=a.cost AND b.gain>=a.gain AND b.claims>=a.claims AND (b.cost<a.cost OR b.gain>a.gain OR b.claims>a.claims))""")
def t10(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.avg("l_extendedprice"), 2).alias("cost"), F.round(F.avg("l_discount"), 6).alias("gain")).withColumn("claims", F.col("id") % 4)
    return selection.pareto_frontier(p, "cost", "gain", "claims")


@query("t10_continuous_frontier", """WITH p AS (SELECT l_partkey AS id, round(avg(l_extendedprice),2) AS cost, round(avg(l_discount),6) AS gain, round(avg(l_quantity*(1-l_tax)),6) AS extra FROM lineitem GROUP BY 1)
 SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.cost<=a.cost AND b.gain>=a.gain AND b.extra>=a.extra AND (b.cost<a.cost OR b.gain>a.gain OR b.extra>a.extra))""")
def t10_continuous(t):
    """Parts by mean price, discount and net quantity: three objectives with as many levels as parts."""
    means = {"cost": (F.col("l_extendedprice"), 2), "gain": (F.col("l_discount"), 6), "extra": (F.col("l_quantity") * (1 - F.col("l_tax")), 6)}
    p = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(*[F.round(F.avg(c), d).alias(n) for n, (c, d) in means.items()])
    return selection.pareto_frontier(p, "cost", "gain", "extra")



@query("s05_pruned_even_thinning", "WITH d AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)-1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT DISTINCT event_type, floor(round(k*(n-1)/199.0,9))::BIGINT AS pos FROM (SELECT DISTINCT event_type, n FROM d), range(200) r(k)) SELECT event_id FROM d WHERE n<=200 OR (event_type, i) IN (SELECT event_type, pos FROM p)")
def s05(t):
    d = t.events.select("event_id", "event_type", micros().alias("us"))
    return selection.thin_evenly(d, ["event_type"], F.col("us"), [F.col("event_id")], 200).select("event_id")
