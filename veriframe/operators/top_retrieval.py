"""BM25 top-k without moving scored pairs.

Documents are read once: each keeps its length and its term frequencies over the queries'
vocabulary, written to the shared folder. Document frequencies, the mean length and the
greatest share any document gives a term come from that table. Then every task keeps the best k
documents of each query for its own documents and returns those alone. Terms of a query are ordered by
their greatest possible share (upper bound times weight); once k documents are held, postings
of terms whose bounds together cannot lift a document over the k-th score aren't opened to find
documents, only to finish the score of those found by the other terms; a query whose bounds within a batch of documents
can't reach it is passed over.

Queries are sent to the tasks in blocks of at most ``BLOCK_TERMS`` query terms, so what is
sent is bounded however many queries there are; each block meets all documents.

Scores are compared rounded to nine decimals, ties go to the lower document id, and
unscored documents (score zero) fill short lists. A null text has no terms; documents without an id are left
out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.functions.text import STOP_WORDS
from veriframe.operators.retrieval import B_, K1, query_terms
from veriframe.session import stored

#: (query, term) pairs sent to the tasks at a time.
BLOCK_TERMS = 1_000_000
#: Documents scored together.
BATCH = 4096
WORD = re.compile("[a-z0-9]+")
POSTINGS = "doc_id long, doc_len long, terms array<int>, tfs array<int>"
BEST = "query long, doc_id long, score double"


def query_blocks(queries: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """(query_id, token, qtf) rows in query order, whole queries at a time, streamed to the driver block by block."""
    rows, last = [], None
    for r in query_terms(queries).orderBy("query_id", "token").toLocalIterator():
        if len(rows) >= block_terms and r["query_id"] != last:
            yield rows
            rows = []
        rows.append((r["query_id"], r["token"], r["qtf"]))
        last = r["query_id"]
    if rows:
        yield rows


def postings(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Length and frequencies of the vocabulary's terms of every document."""
    stop = frozenset(STOP_WORDS)
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Counter(WORD.findall((text.as_py() or "").lower()))
                length, terms, tfs = 0, [], []
                for w, n in words.items():
                    if len(w) > 2 and w not in stop:
                        length += n
                        k = get(w)
                        if k is not None:
                            terms.append(k)
                            tfs.append(n)
                rows.append((doc_id, length, terms, tfs))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "doc_len", "terms", "tfs"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, POSTINGS))


def term_statistics(index: DataFrame) -> tuple[int, float, dict[int, tuple[int, float]]]:
    """Documents, mean length and, of each term, its document frequency and the greatest share of any document."""
    n_docs, mean = index.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    pair = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    norm = F.col("p.tfs") + K1 * (1.0 - B_ + B_ * F.col("doc_len") / F.lit(float(mean or 1.0)))
    per = index.select("doc_len", pair).groupBy(F.col("p.terms").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.max(F.col("p.tfs") * (K1 + 1.0) / norm).alias("most"))
    return n_docs, float(mean or 1.0), {r["term"]: (r["df"], r["most"]) for r in per.toLocalIterator()}  # a row a term of the block's vocabulary


class Best:
    """The k best documents of one query so far; ``least`` is the score that a new one has to reach."""

    def __init__(self, k: int):
        self.k, self.docs, self.scores, self.least = k, np.zeros(0, np.int64), np.zeros(0), -1.0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.concatenate([self.docs, docs]), np.concatenate([self.scores, np.round(scores, 9)])
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]
        if len(order) == self.k:
            self.least = float(self.scores[-1])


def essential(bounds: list[float], limit: float) -> int:
    """Leading terms in which a document has to be found: those after them give less than ``limit`` together."""
    rest = 0.0
    for i in range(len(bounds), 0, -1):
        rest += bounds[i - 1]
        if rest >= limit:
            return i
    return 0


class BatchIndex:
    """Postings of a batch of documents by term: positions and shares, and the greatest share of the batch."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, mean: float):
        self.doc_ids = doc_ids
        place = np.repeat(np.arange(len(doc_ids)), counts)
        share = tfs * (K1 + 1.0) / (tfs + K1 * (1.0 - B_ + B_ * lengths[place] / mean))
        order = np.argsort(terms, kind="stable")
        self.place, self.share = place[order], share[order]
        names, starts = np.unique(terms[order], return_index=True)
        ends = np.append(starts[1:], len(order))[: len(starts)]
        most = np.maximum.reduceat(self.share, starts) if len(starts) else np.zeros(0)
        self.spans = {int(t): (int(a), int(b), float(m)) for t, a, b, m in zip(names, starts, ends, most, strict=True)}

    def score(self, terms: list[int], weights: np.ndarray, best: Best) -> None:
        """Add this batch's documents that may belong to the k best of a query; its terms come in order of falling bounds."""
        present = [(t, w, *self.spans[t]) for t, w in zip(terms, weights.tolist(), strict=True) if t in self.spans]
        limit = best.least - 1e-8
        needed = essential([w * most for _, w, _, _, most in present], limit)
        if not needed:
            return
        found = np.unique(np.concatenate([self.place[a:b] for _, _, a, b, _ in present[:needed]]))
        total = np.zeros(len(self.doc_ids))
        for _, w, a, b, _ in present:
            total[self.place[a:b]] += w * self.share[a:b]
        scores = total[found]
        keep = scores >= limit
        best.add(self.doc_ids[found[keep]], scores[keep])


def best_of_partitions(index: DataFrame, queries: list[tuple[int, list[int], np.ndarray]], mean: float, k: int) -> DataFrame:
    """k rows at most of each query from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                terms, tfs = batch.column(2), batch.column(3)
                counts = np.asarray(terms.value_lengths())
                flat = (np.asarray(c.flatten(), dtype=np.int64) for c in (terms, tfs))
                part = BatchIndex(np.asarray(batch.column(0)), np.asarray(batch.column(1), dtype=float), counts, *flat, mean)
                for (_, names, weights), held in zip(queries, best, strict=True):
                    part.score(names, weights, held)
        sizes = [len(b.docs) for b in best]
        rows = [np.repeat([q for q, _, _ in queries], sizes), np.concatenate([b.docs for b in best]), np.concatenate([b.scores for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "doc_id", "score"])

    return index.mapInArrow(run, BEST)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, first within buckets of documents, so no task sorts all of a query's."""
    order = [F.desc("score"), F.asc("doc_id")]
    local = rows.withColumn("_b", F.pmod(F.hash("doc_id"), F.lit(64)))
    local = local.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "_b").orderBy(*order))).filter(F.col("_r") <= k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return local.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, doc_id, score``: best k documents of every query; docs: doc_id, text; queries: query_id (a number), text."""
    scored = None
    for block in query_blocks(queries, BLOCK_TERMS):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, t, _ in block}))}
        index = postings(docs, vocabulary)
        n_docs, mean, known = term_statistics(index)
        terms: dict[int, list[tuple[float, int, float]]] = {}
        for query, token, qtf in block:
            df, most = known.get(vocabulary[token], (0, 0.0))
            if df:
                weight = math.log(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * qtf
                terms.setdefault(query, []).append((weight * most, vocabulary[token], weight))
        ordered = [(q, [t for _, t, _ in sorted(ts, reverse=True)], np.array([w for _, _, w in sorted(ts, reverse=True)])) for q, ts in sorted(terms.items())]
        if ordered:
            part = best_of_partitions(index, ordered, mean, k)
            scored = part if scored is None else scored.unionByName(part)
    low = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).orderBy("doc_id").limit(k)
    low = low.agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.lit(1).alias("_one"))  # k ids
    fill = queries.select("query_id", F.lit(1).alias("_one")).join(F.broadcast(low), "_one").select("query_id", F.explode("ids").alias("doc_id"), F.lit(0.0).alias("score"))
    if scored is None:
        return ranked(fill, k)
    scored = stored(scored.withColumnRenamed("query", "query_id"))
    fill = fill.join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return ranked(scored.unionByName(fill), k)
