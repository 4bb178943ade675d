"""Bounded retrieval against scores of all pairs."""

import pytest
from pyspark.sql import functions as F

from veriframe.operators import retrieval, top_retrieval

DOCS = "doc_id bigint, text string"


def rows(table):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in table.collect())


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(40)
    return docs, queries


@pytest.mark.parametrize("block,batch", [(1_000_000, 4096), (60, 7)])
def test_bounds_lose_nothing(given, monkeypatch, block, batch):
    docs, queries = given
    monkeypatch.setattr(top_retrieval, "BLOCK_TERMS", block)
    monkeypatch.setattr(top_retrieval, "BATCH", batch)
    want = rows(retrieval.top_k(retrieval.bm25(docs, queries), docs, queries, 5))
    assert rows(top_retrieval.bm25_top_k(docs, queries, 5)) == want and len(want) == 5 * queries.count()


def test_copies_common_words_and_odd_texts(spark):
    texts = [None, "", "alpha beta", "alpha beta", "Alpha BETA gamma", "common " * 9, "common alpha", "the and with", *["common word"] * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    queries = spark.createDataFrame([(1, "alpha beta beta beta"), (2, "common"), (3, "nothing here"), (4, None), (5, "")], "query_id bigint, text string")
    want = rows(retrieval.top_k(retrieval.bm25(docs.na.fill(""), queries), docs, queries, 4))
    assert rows(top_retrieval.bm25_top_k(docs, queries, 4)) == want
    assert top_retrieval.bm25_top_k(spark.createDataFrame([], DOCS), queries, 4).collect() == []


def test_postings_out_of_reach_are_skipped():
    assert top_retrieval.essential([5.0, 3.0, 0.5, 0.4], -1.0) == 4  # no k documents yet
    assert top_retrieval.essential([5.0, 3.0, 0.5, 0.4], 0.4) == 4
    assert top_retrieval.essential([5.0, 3.0, 0.5, 0.4], 1.0) == 2
    assert top_retrieval.essential([5.0, 3.0, 0.5, 0.4], 8.0) == 1
    assert top_retrieval.essential([5.0, 3.0, 0.5, 0.4], 9.0) == 0  # the batch is passed over
    assert top_retrieval.essential([], 1.0) == 0


def test_any_number_of_short_wordings(spark):
    docs = spark.createDataFrame([(1, "One  two THREE four five six seven eight"), (2, "two three"), (3, None), (4, "")], DOCS)
    words = ["one", "two three", "hree f", "nine", "eight", "one two three four five six seven", "two three four five six seven eight"]
    wordings = spark.createDataFrame(list(enumerate(words)), "wording_id bigint, wording string")
    want = {(1, 0), (1, 1), (1, 2), (1, 4), (1, 5), (1, 6), (2, 1)}
    for block in (1, 2, 1000):
        assert {tuple(r) for r in retrieval.contains_wording(docs, wordings, short_block=block).collect()} == want
