"""Ranked retrieval: inverted index, BM25, rationale and lexical scores as joins."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.functions.text import tokens

# BM25 parameters, cap on the query term frequency.
K1, B_, QUERY_TF_CAP = 1.5, 0.75, 2


def inverted_index(docs: DataFrame) -> DataFrame:
    """``doc_id, token, tf, doc_len``; docs: doc_id, text."""
    t = docs.select("doc_id", tokens(F.col("text")).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("bigint"))
    return t.select("doc_id", "doc_len", F.explode("tokens").alias("token")).groupBy("doc_id", "token", "doc_len").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    n = F.size(tokens(F.col("text")))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(n).alias("avgdl"))


def document_frequencies(index: DataFrame, stats: DataFrame) -> DataFrame:
    df = index.groupBy("token").agg(F.count("*").alias("df")).withColumn("_one", F.lit(1))
    one = F.broadcast(stats.withColumn("_one", F.lit(1)))
    return df.join(one, "_one").select("token", "df", F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, token, qtf`` with the repeat cap; queries: query_id, text."""
    t = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token"))
    return t.groupBy("query_id", "token").agg(F.least(F.count("*"), F.lit(QUERY_TF_CAP)).alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Score of every (query, document) that shares a token.

    Postings are cut to the query vocabulary before they are counted or moved.
    """
    q = query_terms(queries)
    stats = corpus_stats(docs)
    t = docs.select("doc_id", tokens(F.col("text")).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("bigint"))
    words = t.select("doc_id", "doc_len", F.explode("tokens").alias("token"))
    vocab = q.select("token").distinct()
    index = words.join(vocab, "token", "left_semi").groupBy("token", "doc_id", "doc_len").agg(F.count("*").alias("tf"))
    idf = document_frequencies(index, stats)
    one = F.broadcast(stats.select(F.col("avgdl"), F.lit(1).alias("_one")))
    joined = index.join(idf, "token").join(q, "token").withColumn("_one", F.lit(1)).join(one, "_one")
    norm = F.col("tf") + K1 * (1.0 - B_ + B_ * F.col("doc_len") / F.col("avgdl"))
    part = F.col("idf") * (F.col("tf") * (K1 + 1.0)) / norm * F.col("qtf")
    return joined.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best k documents per query: score descending, then lower id; unscored documents fill short lists.

    The cut runs first inside document buckets, so no task sorts all hits of a
    query.  The k lowest ids always hold enough unscored documents for the fill.
    """
    s = scores.select("query_id", "doc_id", F.round("score", 9).alias("score"))
    low = docs.select("doc_id").orderBy("doc_id").limit(k)
    low = low.agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.lit(1).alias("_one"))
    fill = queries.select("query_id", F.lit(1).alias("_one")).join(F.broadcast(low), "_one").select("query_id", F.explode("ids").alias("doc_id"), F.lit(0.0).alias("score"))
    fill = fill.join(s.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = s.unionByName(fill).withColumn("_b", F.pmod(F.hash("doc_id"), F.lit(64)))
    order = [F.desc("score"), F.asc("doc_id")]
    local = both.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "_b").orderBy(*order))).filter(F.col("_r") <= k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return local.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def best_rationale(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Highest token-set overlap of a query with one sentence (line) of a paired document."""
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    d = docs.select("doc_id", "text")
    s = pairs.join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", "q", F.explode(F.split("text", "\n")).alias("line"))
    s = s.withColumn("s", F.array_distinct(tokens(F.col("line"))))
    overlap = F.when((F.size("q") == 0) | (F.size("s") == 0), 0.0).otherwise(F.size(F.array_intersect("q", "s")) / F.size(F.array_union("q", "s")))
    return s.groupBy("query_id", "doc_id").agg(F.max(overlap).alias("rationale"))


def lexical_overlap(queries: DataFrame, cited: DataFrame, docs: DataFrame) -> DataFrame:
    """Cosine of token sets between a query and the union of its cited documents.

    The union is kept as (query, token) rows, never as one array per query.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    words = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    c = cited.join(words, "doc_id").select("query_id", "token").distinct()
    tag = q.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(c.withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    per = tag.groupBy("query_id", "token").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = per.groupBy("query_id").agg(F.sum("a").alias("nq"), F.sum("b").alias("nd"), F.sum(F.col("a") * F.col("b")).alias("both"))
    score = F.when((F.col("nq") == 0) | (F.col("nd") == 0), 0.0).otherwise(F.col("both") / F.sqrt(F.col("nq") * F.col("nd")))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce(score, F.lit(0.0)).alias("lexical"))


def gold(evidence: DataFrame) -> DataFrame:
    """Majority label per query, first seen on ties; evidence: query_id, doc_id, label."""
    c = evidence.groupBy("query_id", "label").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return c.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("gold_label"))


def contains_wording(docs: DataFrame, wordings: DataFrame, anchor: int = 5, short_block: int = 1000) -> DataFrame:
    """(doc_id, wording_id) where the normalized document contains the normalized wording.

    Long wordings meet documents on a run of inner words (which must occur whole) and are
    then verified; short ones are compared directly, ``short_block`` of them at a time, however many there are.
    """
    from veriframe.functions.text import normalize

    d = docs.select("doc_id", normalize(F.col("text")).alias("body"))
    w = wordings.select("wording_id", normalize(F.col("wording")).alias("needle"))
    w = w.withColumn("words", F.split("needle", " "))
    long = w.filter(F.size("words") >= anchor + 2).withColumn("key", F.xxhash64(F.array_join(F.slice("words", 2, anchor), " ")))
    runs = d.withColumn("words", F.split("body", " ")).filter(F.size("words") >= anchor)
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - anchor + 1), lambda i: F.xxhash64(F.array_join(F.slice(F.col("words"), i, anchor), " "))))
    near = runs.select("doc_id", F.explode(keys).alias("key")).join(long.select("key", "wording_id"), "key").select("doc_id", "wording_id").distinct()
    hit = near.join(d, "doc_id").join(long.select("wording_id", "needle"), "wording_id").filter(F.contains(F.col("body"), F.col("needle"))).select("doc_id", "wording_id")
    # Wordings without a long inner run meet all documents, a block of them at a time.
    short = w.filter(F.size("words") < anchor + 2).select("wording_id", "needle").toLocalIterator()
    while block := list(islice(short, short_block)):
        tests = F.array_compact(F.array(*[F.when(F.contains(F.col("body"), F.lit(r["needle"])), F.lit(r["wording_id"])) for r in block]))
        hit = hit.unionByName(d.select("doc_id", F.explode(tests).alias("wording_id")))
    return hit
