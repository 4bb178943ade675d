"""Queries on text claims and retrieval over documents, benchmark items and labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.functions import text as X
from veriframe.operators import retrieval as R
from veriframe.operators.top_retrieval import bm25_top_k
from veriframe.plans.registry import query, values
from veriframe.session import stored

r6 = lambda c: F.round(c, 6)


def manuscripts(t):
    """Documents with common function words turned into claim vocabulary, so that patterns apply."""
    x = F.col("text")
    for a, b in WORDS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return t.documents.select("doc_id", x.alias("text"))


WORDS = ((" the ", " causal effect "), (" and ", " not "), (" that ", " prediction "), (" les ", " state of the art "), (" die ", " shows bootstrap "), (" for ", " complete digital twin "))


def _man_sql():
    x = "text"
    for a, b in WORDS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"man AS (SELECT doc_id, {x} AS text FROM documents)"


def q_(s):
    return "'" + s.replace("'", "''") + "'"


_SENT = _man_sql() + r""", cl AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '%[^\n]*', ' ', 'g'), '\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?', ' ', 'g'), '\s+', ' ', 'g') AS x FROM man),
 parts AS (SELECT doc_id, unnest(string_split(regexp_replace(x, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(x, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM cl),
 sent AS (SELECT doc_id, i, trim(s) AS s FROM parts WHERE length(trim(s)) BETWEEN 40 AND 600)"""


@query("h04_tokenizer", f"SELECT doc_id, len(tk) AS n, sha256(array_to_string(tk,' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w)>2 AND w NOT IN ({', '.join(map(q_, X.STOP_WORDS))})) AS tk FROM documents)")
def h04(t):
    k = X.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(k).cast("bigint").alias("n"), F.sha2(F.array_join(k, " "), 256).alias("digest"))


@query("h06_sentences", f"WITH {_SENT} SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars, min(sha256(s)) AS lo FROM sent GROUP BY 1")
def h06(t):
    s = manuscripts(t).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), F.min(F.sha2("s", 256)).alias("lo"))


def wb(p):
    """Word boundaries that count accented letters as word characters."""
    return p.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])")


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(s, {q_(wb(p))}, 'i') THEN '{n}'" for n, p in X.CLAIM_PATTERNS) + " END"
_C01 = f"""WITH {_SENT}, typed AS (SELECT *, {_TYPE} AS claim_type, regexp_matches(s, {q_(wb(X.NEGATION))}, 'i') AS negated FROM sent),
 ded AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY i) AS d FROM typed WHERE claim_type IS NOT NULL),
 cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM ded WHERE d=1)"""


def candidates(docs, limit=None):
    """Distinct claim sentences of each text in order; with ``limit`` only the first ones of a text."""
    s = docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "s"))
    s = s.withColumn("claim_type", X.claim_type(F.col("s"))).filter(F.col("claim_type").isNotNull() & X.claim_like(F.col("s")))
    first = s.groupBy("doc_id", F.lower("s").alias("key")).agg(F.min(F.struct("i", "s", "claim_type")).alias("f")).select("doc_id", "f.*")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("i"))
    ranked = first.withColumn("rank", rank.cast("bigint"))
    ranked = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return ranked.withColumn("negated", X.matches(F.col("s"), X.NEGATION))


@query("c01_candidate_claims", _C01 + " SELECT doc_id, rank, claim_type, negated, sha256(s) AS digest FROM cand")
def c01(t):
    return candidates(manuscripts(t)).select("doc_id", "rank", "claim_type", "negated", F.sha2("s", 256).alias("digest"))


@query("h26_claim_types", f"WITH {_SENT} SELECT coalesce({_TYPE},'none') AS claim_type, regexp_matches(s, {q_(wb(X.NEGATION))}, 'i') AS negated, regexp_matches(s, {q_(wb(X.STRONG_VERBS))}, 'i') AS strong, count(*) AS n FROM sent GROUP BY ALL")
def h26(t):
    s = manuscripts(t).select(F.explode(X.sentences(F.col("text"))).alias("s"))
    c = F.col("s")
    return s.groupBy(F.coalesce(X.claim_type(c), F.lit("none")).alias("claim_type"), X.matches(c, X.NEGATION).alias("negated"), X.matches(c, X.STRONG_VERBS).alias("strong")).agg(F.count("*").alias("n"))


@query("c02_external_candidates", _C01 + ", ext AS (SELECT conv_id AS doc_id, 'external' AS source, count(*) AS n FROM conversations WHERE role='assistant' GROUP BY 1) SELECT source, count(*) AS texts, sum(n)::BIGINT AS candidates, false AS authoritative FROM (SELECT doc_id, 'deterministic' AS source, count(*) AS n FROM cand GROUP BY 1 UNION ALL SELECT * FROM ext) GROUP BY 1")
def c02(t):
    """A second candidate source is merged by name; neither source is authoritative."""
    own = candidates(manuscripts(t)).select("doc_id", F.col("s").alias("text"), F.lit("deterministic").alias("source"), "claim_type")
    ext = t.conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), "text", F.lit("external").alias("source"))
    m = own.unionByName(ext, allowMissingColumns=True)
    per = m.groupBy("doc_id", "source").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n").alias("candidates"), F.lit(False).alias("authoritative"))


def _hits_sql():
    rows = []
    for rid, sev, fam, pat, ctx in X.RISK_PATTERNS:
        p, c = q_("(?i)" + pat), q_("(?i)" + wb(ctx))
        rows.append(f"""SELECT doc_id, '{rid}' AS risk_id, st AS start, hit, regexp_matches(substr(text, greatest(0,st-180)::BIGINT+1, least(180,st)::BIGINT), {c}) AS negated FROM (
   SELECT doc_id, text, m[i] AS hit, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))),0) AS st FROM (
   SELECT doc_id, text, p, m, unnest(range(1,len(m)+1)) AS i FROM (SELECT doc_id, text, string_split_regex(text, {p}) AS p, regexp_extract_all(text, {p}) AS m FROM man WHERE regexp_matches(text, {p}))))""")
    return "hits AS (" + " UNION ALL ".join(rows) + ")"


def _labelled(rid, sev, fam, ctx):
    def build(h):
        return F.struct(F.lit(rid).alias("risk_id"), F.lit(sev).alias("severity"), F.lit(fam).alias("claim_family"), h["start"].alias("start"),
                        h["hit"].alias("hit"), X.negated_before(F.col("text"), h["start"], ctx).alias("negated"))

    return build


def hits(docs):
    """Every risky phrase with offset, text and local negation."""
    per = []
    for rid, sev, fam, pat, ctx in X.RISK_PATTERNS:
        found = X.pattern_hits(F.col("text"), pat)
        per.append(F.transform(found, _labelled(rid, sev, fam, ctx)))
    return docs.select("doc_id", F.explode(F.concat(*per)).alias("h")).select("doc_id", "h.*")


@query("c03_risk_pattern_hits", f"WITH {_man_sql()}, {_hits_sql()} SELECT doc_id, risk_id, start::BIGINT AS start, hit, negated FROM hits")
def c03(t):
    return hits(manuscripts(t)).select("doc_id", "risk_id", F.col("start").cast("bigint").alias("start"), "hit", "negated")


@query("h25_local_negation", f"WITH {_man_sql()}, {_hits_sql()} SELECT risk_id, negated, count(*) AS n FROM hits GROUP BY 1,2")
def h25(t):
    return hits(manuscripts(t)).groupBy("risk_id", "negated").agg(F.count("*").alias("n"))


@query("c04_wording_audit", f"""WITH {_man_sql()}, {_hits_sql()}, nd AS (SELECT doc_id, trim(regexp_replace(lower(text),'\\s+',' ','g')) AS body FROM documents), nw AS (SELECT item_id, trim(regexp_replace(lower(text),'\\s+',' ','g')) AS needle FROM benchmark),
 inn AS (SELECT item_id, doc_id FROM nw JOIN nd ON contains(body, needle)), risky AS (SELECT DISTINCT doc_id FROM hits WHERE NOT negated)
 SELECT b.item_id, count(inn.doc_id) AS texts, count(risky.doc_id) AS risky_texts, count(inn.doc_id)>0 AND b.item_id%2=1 AS unsupported_present FROM benchmark b LEFT JOIN inn ON inn.item_id=b.item_id LEFT JOIN risky ON risky.doc_id=inn.doc_id GROUP BY b.item_id""")
def c04(t):
    """Where a claim's wording occurs, whether that text has unnegated risky phrases, and whether the claim is unsupported."""
    w = t.benchmark.select(F.col("item_id").alias("wording_id"), F.col("text").alias("wording"))
    inn = R.contains_wording(t.documents, w)
    risky = hits(manuscripts(t)).filter(~F.col("negated")).select("doc_id").distinct().withColumn("risky", F.lit(1))
    per = inn.join(risky, "doc_id", "left").groupBy(F.col("wording_id").alias("item_id")).agg(F.count("*").alias("texts"), F.count("risky").alias("risky_texts"))
    return t.benchmark.select("item_id").join(per, "item_id", "left").na.fill(0, ["texts", "risky_texts"]).withColumn("unsupported_present", (F.col("texts") > 0) & (F.col("item_id") % 2 == 1))


# ---- retrieval -------------------------------------------------------------

def claims(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def cited(t):
    """Labelled documents are cited by one claim each; their labels give the evidence label."""
    n = F.broadcast(t.benchmark.agg(F.count("*").alias("n"), F.lit(1).alias("_one")))
    lab = F.when(F.col("toxic") == 1, "CONTRADICT").when((F.col("quality") == 1) & (F.floor(F.col("doc_id") / F.col("n")) % 2 == 0), "SUPPORT").otherwise("NOT_ENOUGH_INFO")
    return t.labels.withColumn("_one", F.lit(1)).join(n, "_one").select((F.col("doc_id") % F.col("n")).alias("query_id"), "doc_id", lab.alias("label"))


_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w)>2 AND w NOT IN ({', '.join(map(q_, X.STOP_WORDS))}))"
_IDX = f"""dt AS (SELECT doc_id, {_TOK} AS tk FROM documents), ix AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS tok FROM dt) GROUP BY 1,2), dl AS (SELECT doc_id, len(tk) AS doc_len FROM dt),
 st AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM dl), dfx AS (SELECT tok, count(*) AS df, ln(1+((SELECT n FROM st)-count(*)+0.5)/(count(*)+0.5)) AS idf FROM ix GROUP BY 1),
 qt AS (SELECT item_id, tok, least(count(*),2) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS tok FROM benchmark) GROUP BY 1,2)"""
_BM = _IDX + """, bm AS (SELECT item_id, doc_id, sum(idf*(tf*2.5)/(tf+1.5*(1-0.75+0.75*doc_len/avgdl))*qtf) AS score FROM qt JOIN ix USING (tok) JOIN dfx USING (tok) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY 1,2),
 allp AS (SELECT b.item_id, d.doc_id, round(coalesce(bm.score,0),9) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN bm ON bm.item_id=b.item_id AND bm.doc_id=d.doc_id),
 topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM allp) WHERE rank<=5)"""


@query("c06_inverted_index", f"WITH {_IDX} SELECT tok AS token, df, round(idf,9) AS idf FROM dfx")
def c06(t):
    idx = R.inverted_index(t.documents)
    return R.document_frequencies(idx, R.corpus_stats(t.documents)).withColumn("idf", F.round("idf", 9))


@query("c07_bm25_scores", f"WITH {_BM} SELECT item_id AS query_id, doc_id, round(score,6) AS score FROM bm")
def c07(t):
    return R.bm25(t.documents, claims(t)).withColumn("score", r6("score"))


@query("j27_retrieval_token_join", f"WITH {_IDX} SELECT item_id AS query_id, count(*) AS postings, sum(tf*qtf)::BIGINT AS weight FROM qt JOIN ix USING (tok) GROUP BY 1")
def j27(t):
    q = R.query_terms(claims(t))
    return R.inverted_index(t.documents).join(q, "token").groupBy("query_id").agg(F.count("*").alias("postings"), F.sum(F.col("tf") * F.col("qtf")).alias("weight"))


def top5(t):
    return bm25_top_k(t.documents, claims(t), 5)


@query("t01_bm25_top_k", f"WITH {_BM} SELECT item_id AS query_id, rank, doc_id, round(score,6) AS score FROM topk")
def t01(t):
    return top5(t).withColumn("score", r6("score"))


_RAT = _BM + f""", qs AS (SELECT item_id, list_distinct({_TOK}) AS q FROM benchmark), ln1 AS (SELECT t.item_id, t.doc_id, unnest(string_split(d.text, chr(10))) AS text FROM topk t JOIN documents d USING (doc_id) WHERE rank=1),
 lt AS (SELECT item_id, doc_id, list_distinct({_TOK}) AS s FROM ln1), rat AS (SELECT item_id, max(CASE WHEN len(q)=0 OR len(s)=0 THEN 0 ELSE len(list_intersect(q,s))::DOUBLE/(len(q)+len(s)-len(list_intersect(q,s))) END) AS rationale FROM lt JOIN qs USING (item_id) GROUP BY 1)"""


@query("c08_best_rationale", f"WITH {_RAT} SELECT item_id AS query_id, round(rationale,9) AS rationale FROM rat")
def c08(t):
    top = top5(t).filter("rank = 1").select("query_id", "doc_id")
    return R.best_rationale(top, claims(t), t.documents).select("query_id", F.round("rationale", 9).alias("rationale"))


_CIT = "cit AS (SELECT doc_id%(SELECT count(*) FROM benchmark) AS item_id, doc_id, CASE WHEN toxic=1 THEN 'CONTRADICT' WHEN quality=1 AND (doc_id//(SELECT count(*) FROM benchmark))%2=0 THEN 'SUPPORT' ELSE 'NOT_ENOUGH_INFO' END AS label FROM labels)"
_LEX = f"""lq AS (SELECT DISTINCT item_id, unnest({_TOK}) AS tok FROM benchmark), ld AS (SELECT DISTINCT cit.item_id, ix.tok FROM cit JOIN ix USING (doc_id)),
 lex AS (SELECT b.item_id, CASE WHEN nq=0 OR coalesce(nd,0)=0 THEN 0 ELSE coalesce(nb,0)/sqrt(nq*nd) END AS lexical FROM benchmark b LEFT JOIN (SELECT item_id, count(*) AS nq FROM lq GROUP BY 1) USING (item_id)
 LEFT JOIN (SELECT item_id, count(*) AS nd FROM ld GROUP BY 1) USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS nb FROM lq JOIN ld USING (item_id, tok) GROUP BY 1) USING (item_id))"""


@query("c05_lexical_overlap", f"WITH {_IDX}, {_CIT}, {_LEX} SELECT item_id AS query_id, round(lexical,9) AS lexical FROM lex")
def c05(t):
    return R.lexical_overlap(claims(t), cited(t).select("query_id", "doc_id"), t.documents).withColumn("lexical", F.round("lexical", 9))


_GOLD = "gold AS (SELECT item_id, label AS gold_label FROM (SELECT item_id, label, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, min(doc_id)) AS rn FROM cit GROUP BY 1,2) WHERE rn=1)"


@query("c10_gold_labels", f"WITH {_CIT}, {_GOLD} SELECT b.item_id AS query_id, coalesce(gold_label,'NOT_ENOUGH_INFO') AS gold_label, (SELECT count(*) FROM cit WHERE cit.item_id=b.item_id) AS n_docs FROM benchmark b LEFT JOIN gold USING (item_id)")
def c10(t):
    ev = cited(t)
    n = ev.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    g = claims(t).select("query_id").join(R.gold(ev), "query_id", "left").join(n, "query_id", "left")
    return g.select("query_id", F.coalesce("gold_label", F.lit("NOT_ENOUGH_INFO")).alias("gold_label"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


# Lexical support and abstention thresholds, retrieval support thresholds.
SUPPORT, ABSTAIN, BM_SUPPORT, RATIONALE_SUPPORT = 0.18, 0.12, 4.0, 0.18
_AUD = f"""WITH {_RAT}, {_CIT}, {_LEX}, {_GOLD}, a AS (SELECT b.item_id, coalesce(gold_label,'NOT_ENOUGH_INFO') AS gold_label, lexical, rationale, t1.score AS top_score, t1.doc_id AS top_doc, t2.score AS second, (SELECT len({_TOK}) FROM benchmark bb WHERE bb.item_id=b.item_id) AS nt,
 EXISTS (SELECT 1 FROM topk JOIN cit ON cit.doc_id=topk.doc_id AND cit.item_id=topk.item_id WHERE topk.item_id=b.item_id) AS retrieved, EXISTS (SELECT 1 FROM cit WHERE cit.item_id=b.item_id) AS has_gold
 FROM benchmark b LEFT JOIN gold USING (item_id) JOIN lex USING (item_id) JOIN topk t1 ON t1.item_id=b.item_id AND t1.rank=1 LEFT JOIN topk t2 ON t2.item_id=b.item_id AND t2.rank=2 JOIN rat ON rat.item_id=b.item_id)"""


def audit_rows(t):
    """One row per claim with retrieval features, labels and policy decisions."""
    q, top, ev = claims(t), stored(top5(t)), cited(t)  # five rows a claim, read three times
    one = top.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("top_doc"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    rat = R.best_rationale(top.filter("rank = 1").select("query_id", "doc_id"), q, t.documents).select("query_id", "rationale")
    got = top.join(ev.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("retrieved", F.lit(True))
    has = ev.select("query_id").distinct().withColumn("has_gold", F.lit(True))
    size = q.select("query_id", F.size(X.tokens(F.col("text"))).alias("nt"))
    d = size.join(one, "query_id").join(rat, "query_id", "left").join(R.lexical_overlap(q, ev.select("query_id", "doc_id"), t.documents), "query_id")
    d = d.join(R.gold(ev), "query_id", "left").join(got, "query_id", "left").join(has, "query_id", "left")
    d = d.na.fill(False, ["retrieved", "has_gold"]).na.fill("NOT_ENOUGH_INFO", ["gold_label"]).na.fill(0.0, ["rationale"])
    lex = F.round("lexical", 9)
    return (
        d.withColumn("retrieval_label", F.when((F.col("top_score") >= BM_SUPPORT) & (F.col("rationale") >= RATIONALE_SUPPORT), "SUPPORT").otherwise("NOT_ENOUGH_INFO"))
        .withColumn("shortcut", lex >= SUPPORT).withColumn("abstained", lex < ABSTAIN).withColumn("gold_support", F.col("gold_label") == "SUPPORT")
    )


@query("c09_retrieval_features", _AUD + " SELECT item_id AS query_id, round(ln(1+greatest(0,top_score)),6) AS f0, round(rationale,6) AS f1, round(lexical,6) AS f2, round(ln(1+nt),6) AS f3, round(ln(1+greatest(0,top_score-coalesce(second,0))),6) AS f4, CASE WHEN top_score>=4.0 AND rationale>=0.18 THEN 'SUPPORT' ELSE 'NOT_ENOUGH_INFO' END AS retrieval_label FROM a")
def c09(t):
    return features(audit_rows(t)).select("query_id", *[r6(f"f{i}").alias(f"f{i}") for i in range(5)], "retrieval_label")


def features(rows):
    zero = F.lit(0.0)
    return (
        rows.withColumn("f0", F.log1p(F.greatest(zero, F.col("top_score")))).withColumn("f1", F.col("rationale")).withColumn("f2", F.col("lexical"))
        .withColumn("f3", F.log1p(F.col("nt").cast("double"))).withColumn("f4", F.log1p(F.greatest(zero, F.col("top_score") - F.col("second"))))
    )


@query("c12_abstaining_policy", _AUD + " SELECT item_id AS query_id, CASE WHEN round(lexical,9)<0.12 THEN 'abstain' WHEN round(lexical,9)>=0.18 THEN 'support' ELSE 'no_support' END AS decision FROM a")
def c12(t):
    d = R.lexical_overlap(claims(t), cited(t).select("query_id", "doc_id"), t.documents)
    s = F.round("lexical", 9)
    return d.select("query_id", F.when(s < ABSTAIN, "abstain").when(s >= SUPPORT, "support").otherwise("no_support").alias("decision"))


def _rate(cond, base):
    return f"coalesce(count(*) FILTER ({cond} AND {base})::DOUBLE/nullif(count(*) FILTER ({base}),0),0)"


@query("a35_retrieval_evaluation", _AUD + f""" SELECT count(*) AS claims, round({_rate('retrieved', 'has_gold')},9) AS recall_at_5, round({_rate("lexical>=0.18", "gold_label<>'SUPPORT'")},9) AS shortcut_fpr, round({_rate("lexical<0.18", "gold_label='SUPPORT'")},9) AS shortcut_fnr,
 round({_rate("top_score>=4.0 AND rationale>=0.18", "gold_label<>'SUPPORT'")},9) AS retrieval_fpr, round({_rate("NOT (top_score>=4.0 AND rationale>=0.18)", "gold_label='SUPPORT'")},9) AS retrieval_fnr FROM a""")
def a35(t):
    return evaluation(audit_rows(t))


def evaluation(a):
    rate = lambda cond, base: F.round(F.coalesce(F.try_divide(F.count_if(cond & base), F.count_if(base)), F.lit(0.0)), 9)
    pos, ret = F.col("gold_support"), F.col("retrieval_label") == "SUPPORT"
    return a.agg(
        F.count("*").alias("claims"), rate(F.col("retrieved"), F.col("has_gold")).alias("recall_at_5"),
        rate(F.col("shortcut"), ~pos).alias("shortcut_fpr"), rate(~F.col("shortcut"), pos).alias("shortcut_fnr"),
        rate(ret, ~pos).alias("retrieval_fpr"), rate(~ret, pos).alias("retrieval_fnr"))


@query("c11_retrieval_audit", _AUD + " SELECT gold_label, count(*) AS n, round(avg(lexical),9) AS mean_lexical, round(avg((lexical>=0.18)::INT),9) AS shortcut_rate, count(*) FILTER (has_gold AND NOT retrieved) AS retrieval_misses FROM a GROUP BY 1")
def c11(t):
    a = audit_rows(t)
    return a.groupBy("gold_label").agg(
        F.count("*").alias("n"), F.round(F.avg("lexical"), 9).alias("mean_lexical"), F.round(F.avg(F.col("shortcut").cast("int")), 9).alias("shortcut_rate"),
        F.count_if(F.col("has_gold") & ~F.col("retrieved")).alias("retrieval_misses"))


def support_scores(rows):
    """Support classifier on standardized features, fitted on the training queries; scores of all, told apart by ``train``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from veriframe.session import cut

    data = cut(features(rows).withColumn("label", F.col("gold_support").cast("double")))
    data = VectorAssembler(inputCols=[f"f{i}" for i in range(5)], outputCol="raw").transform(data)
    train = F.pmod(F.xxhash64("query_id"), F.lit(2)) == 0
    data = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(data.filter(train)).transform(data)
    model = LogisticRegression(regParam=0.1, standardization=False, maxIter=200).fit(data.filter(train))
    scored = model.transform(data).withColumn("p", vector_to_array("probability")[1])
    return scored.select("query_id", "gold_label", "gold_support", "p", train.alias("train"))


@query("m17_support_classifier")
def m17(t):
    return support_scores(audit_rows(t)).filter("NOT train").select("query_id", "gold_support", F.round("p", 4).alias("probability"))


def operating_point(scored, max_fpr=0.10):
    """Threshold with the highest true-positive rate under a false-positive limit; ties take the lower threshold."""
    from veriframe.operators.ranking import cumulative

    one = F.lit(1).cast("bigint")
    y = F.col("positive")
    c = cumulative(scored, [], "p", {"tp": F.sum(F.when(y, one).otherwise(0)), "fp": F.sum(F.when(~y, one).otherwise(0))}, descending=True)
    ok = c.withColumn("tpr", F.coalesce(F.try_divide(F.col("cum_tp"), F.col("all_tp")), F.lit(0.0))).withColumn("fpr", F.coalesce(F.try_divide(F.col("cum_fp"), F.col("all_fp")), F.lit(0.0))).filter(F.col("fpr") <= max_fpr)
    return ok.agg(F.max_by(F.struct("p", "tpr", "fpr"), F.struct("tpr", -F.col("p"))).alias("b")).select(F.coalesce("b.p", F.lit(1.0)).alias("threshold"), "b.tpr", "b.fpr")


@query("t09_operating_point", """WITH s AS (SELECT round(length(text)/20001.0,9) AS p, quality=1 AS positive FROM documents JOIN labels USING (doc_id)), c AS (SELECT p, (SELECT count(*) FROM s x WHERE x.p>=s.p AND x.positive) AS tp, (SELECT count(*) FROM s x WHERE x.p>=s.p AND NOT x.positive) AS fp FROM s GROUP BY 1),
 r AS (SELECT p, tp::DOUBLE/(SELECT count(*) FROM s WHERE positive) AS tpr, fp::DOUBLE/(SELECT count(*) FROM s WHERE NOT positive) AS fpr FROM c) SELECT p AS threshold, round(tpr,9) AS tpr, round(fpr,9) AS fpr FROM r WHERE fpr<=0.10 ORDER BY tpr DESC, p LIMIT 1""")
def t09(t):
    s = t.documents.join(t.labels, "doc_id").select(F.round(F.length("text") / 20001.0, 9).alias("p"), (F.col("quality") == 1).alias("positive"))
    return operating_point(s).select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("m17_operating_point")
def m17_point(t):
    """The threshold is chosen on the training queries' scores under the false-positive limit and judged on the others."""
    scores = stored(support_scores(audit_rows(t)))
    chosen = operating_point(scores.filter("train").select("p", F.col("gold_support").alias("positive")))
    chosen = chosen.select("threshold", F.col("tpr").alias("train_tpr"), F.col("fpr").alias("train_fpr"), F.lit(1).alias("_one"))
    held = scores.filter("NOT train").withColumn("_one", F.lit(1)).join(F.broadcast(chosen), "_one")
    hit, y = F.col("p") >= F.col("threshold"), F.col("gold_support")
    rate = lambda c, base: F.round(F.coalesce(F.try_divide(F.count_if(c & base), F.count_if(base)), F.lit(0.0)), 6)
    return held.groupBy("threshold", "train_tpr", "train_fpr").agg(F.count("*").alias("claims"), rate(hit, y).alias("tpr"), rate(hit, ~y).alias("fpr"))


@query("c13_annotation_package", f"""{_C01}, s AS (SELECT doc_id, rank, claim_type, sha256('annotation:'||doc_id||'-'||rank) AS h, row_number() OVER (PARTITION BY claim_type ORDER BY sha256('annotation:'||doc_id||'-'||rank)) AS k FROM cand),
 z AS (SELECT *, row_number() OVER (ORDER BY h) AS r FROM s WHERE k<=20) SELECT printf('ITEM-%03d', r) AS item_id, doc_id, rank, claim_type, '' AS annotator_label FROM z WHERE r<=60""")
def c13(t):
    """Balanced sample of candidates with running item ids and empty annotation columns."""
    from veriframe.operators.selection import stratified_sample
    from veriframe.functions.hashing import stable_key

    c = candidates(manuscripts(t)).select("doc_id", "rank", "claim_type", F.concat_ws("-", "doc_id", "rank").alias("key"))
    s = stratified_sample(c, "claim_type", F.col("key"), "annotation", 20, 60).withColumn("h", stable_key("annotation", F.col("key")))
    r = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("h"))  # at most 60 rows
    return s.select(F.format_string("ITEM-%03d", r).alias("item_id"), "doc_id", "rank", "claim_type", F.lit("").alias("annotator_label"))
