"""Connected components by randomized contraction.

Each round every node joins the neighbour (or itself) of least hash under the round's seed;
edges are then drawn between the joined nodes. Nodes shrink by a constant factor a round
on average, so rounds grow with the logarithm of the graph. Minima are combined before the
shuffle; joins on a node with many edges are plain equi joins that Spark splits when skewed.
Once ``LAST_EDGES`` edges at most are left, one task of that bounded size finds their
components; the rounds before it stand for any larger graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.session import cut

LAST_EDGES = 500_000


class Forest:
    """Union of positions with labels that point at the least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                short = label[label]
                if np.array_equal(short, label):
                    break
                label[:] = short


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.unite(where[: len(a)], where[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[forest.label], pa.int64())], ["a", "r"])


def components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a and b, long); one label per component."""
    left = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while left.count() > last_edges:
        seed = F.lit(len(rounds))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("v"))
        joined = cut(near.select("a", F.least("m", own)["v"].alias("r")))
        rounds.append(joined)
        moved = left.join(joined, "a").select(F.col("r").alias("x"), F.col("b").alias("a")).join(joined, "a").where(F.col("x") != F.col("r"))
        left = cut(moved.select(F.least("x", "r").alias("a"), F.greatest("x", "r").alias("b")).distinct())
    rounds.append(left.repartition(1).mapInArrow(_last, "a long, r long"))
    labels = rounds[-1].select(F.col("a").alias("node"), F.col("r").alias("component"))
    for joined in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("r"), "component")
        labels = joined.join(later, "r", "left").select(F.col("a").alias("node"), F.coalesce("component", "r").alias("component"))
    return labels
