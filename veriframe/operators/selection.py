"""Hash-ordered folds, splits, samples and cohort choices."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.functions.hashing import stable_key
from veriframe.operators.ranking import hash_rank, value_rank
from veriframe.session import cut


def balanced_folds(df: DataFrame, group: list[str], key: Column, namespace: str, folds: int = 3, cap: int | None = None) -> DataFrame:
    """Fold = hash rank modulo ``folds``; an optional cap keeps the first ranks of each fold."""
    d = hash_rank(df, group, key, namespace).withColumn("fold", (F.col("rn") - 1) % folds)
    if cap is not None:
        d = d.filter(F.floor((F.col("rn") - 1) / folds) < cap)
    return d.drop("rn", "n")


def chronological_split(df: DataFrame, group: list[str], time: Column, ties: list[Column], train: float = 0.6, test: float = 0.8) -> DataFrame:
    """Labels the first 60 % train, the last 20 % test and the rest between."""
    d = value_rank(df, group, time, ties)
    i = F.col("rn") - 1
    role = F.when(i < F.floor(F.round(F.col("n") * train, 9)), "train").when(i >= F.floor(F.round(F.col("n") * test, 9)), "test").otherwise("between")
    return d.withColumn("role", role)


def even_positions(n: Column, k: int) -> Column:
    """The k integer positions spread evenly over 0..n-1 (all positions when n <= k)."""
    full = F.sequence(F.lit(0).cast("bigint"), n - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(F.round(i * (n - 1) / float(k - 1), 9)).cast("bigint"))
    return F.when(n <= k, full).otherwise(spread)


def thin_evenly(df: DataFrame, group: list[str], time: Column, ties: list[Column], k: int) -> DataFrame:
    """Keeps rows at evenly spaced positions of the order: a position test, no join."""
    d = value_rank(df, group, time, ties)
    i = F.col("rn") - 1
    step = (F.col("n") - 1) / float(k - 1)
    j = F.ceil(F.round(i / step, 9))
    hit = F.floor(F.round(j * step, 9)) == i
    return d.filter((F.col("n") <= k) | (hit & (j <= k - 1)))


def first_by_hash(df: DataFrame, group: list[str], key: Column, namespace: str, columns: list[str]) -> DataFrame:
    """One row per group: the smallest hash wins (an aggregate, no sort of the group)."""
    h = stable_key(namespace, key)
    best = F.min(F.struct(h.alias("h"), *[F.col(c) for c in columns])).alias("b")
    return df.groupBy(*group).agg(best).select(*group, *[F.col(f"b.{c}").alias(c) for c in columns])


def top_by_hash(df: DataFrame, key: Column, namespace: str, n: int) -> DataFrame:
    return df.withColumn("_h", stable_key(namespace, key)).orderBy("_h").limit(n).drop("_h")


def stratified_sample(df: DataFrame, kind: str, key: Column, namespace: str, per_kind: int, target: int) -> DataFrame:
    """At most ``per_kind`` rows of each kind in hash order, then ``target`` rows overall."""
    d = hash_rank(df, [kind], key, namespace).filter(F.col("rn") <= per_kind)
    return d.withColumn("_h", stable_key(namespace, key)).orderBy("_h").limit(target).drop("_h", "rn", "n")


def subsamples(df: DataFrame, key: Column, sizes: list[tuple[int, int]], seed: str) -> DataFrame:
    """Hash subsamples for (size, repeat) pairs; each row is hashed once per repeat."""
    repeats = sorted({r for _, r in sizes})
    x = df.withColumn("repeat", F.explode(F.array(*map(F.lit, repeats))))
    x = hash_rank(x, ["repeat"], key, F.concat_ws(":", F.lit(seed), F.col("repeat")))
    want = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(r).alias("r")) for s, r in sizes])
    x = x.withColumn("w", F.explode(F.filter(want, lambda w: (w["r"] == F.col("repeat")) & (F.col("rn") <= w["size"]))))
    return x.withColumn("size", F.col("w.size")).drop("w", "rn", "n")


def staircase(rows: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Undominated (cost, gain, extra) of one range of costs: by rising cost, against the maxima of gain and extra so far."""
    gains: list[float] = []  # rising, their extras falling
    extras: list[float] = []
    kept = []
    for c, g, x in sorted(set(rows), key=lambda r: (r[0], -r[1], -r[2])):
        at = bisect_left(gains, g)
        if at < len(gains) and extras[at] >= x:
            continue
        kept.append((c, g, x))
        end = at + 1 if at < len(gains) and gains[at] == g else at
        start = at
        while start > 0 and extras[start - 1] <= x:
            start -= 1
        gains[start:end], extras[start:end] = [g], [x]
    return kept


def beaten_by_cheaper(points: DataFrame, level: int) -> DataFrame:
    """Points without those that a point of the lower half of their pair of range groups beats.

    Groups of 2^level ranges are paired; costs of the lower group are at most those of the upper one, so it is enough
    that gain and extra aren't less. The greatest extra at or above a gain is a running maximum over ranges of (pair, gain)."""
    half = 1 << level
    marked = points.withColumn("_pair", F.shiftright("_r", level + 1)).withColumn("_low", F.col("_r").bitwiseAND(half) == 0)
    ranged = cut(marked.repartitionByRange(F.col("_pair"), F.col("g").desc()).withColumn("_part", F.spark_partition_id()))
    given = F.max(F.when(F.col("_low"), F.col("x")))
    own = given.over(W.partitionBy("_pair", "_part").orderBy(F.col("g").desc()).rangeBetween(W.unboundedPreceding, W.currentRow))
    totals = ranged.groupBy("_pair", "_part").agg(given.alias("_most"))  # a row a range and pair
    before = totals.select("_pair", "_part", F.max("_most").over(W.partitionBy("_pair").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    reached = ranged.withColumn("_own", own).join(before, ["_pair", "_part"])
    beaten = ~F.col("_low") & F.coalesce(F.greatest("_own", "_before") >= F.col("x"), F.lit(False))
    return reached.where(~beaten).select("c", "g", "x", "_r")


def pareto_frontier(points: DataFrame, cost: str, gain: str, extra: str) -> DataFrame:
    """Points no other point dominates (cost low, gain high, ``extra`` high; one of them strictly).

    Distinct triples are dealt by ranges of (cost, falling gain, falling extra), in which no later one dominates an earlier one; each range keeps its own frontier. Ranges are then merged in
    pairs of doubling groups, so a range meets all cheaper ones after log2(ranges) passes, and no task
    or broadcast holds more than a range. Any number of levels is taken; points with a null
    objective are left out. Numbers are compared as doubles.
    """
    triple = [F.col(c).cast("double").alias(n) for c, n in ((cost, "c"), (gain, "g"), (extra, "x"))]
    distinct = points.select(*triple).dropna().distinct()
    ranged = cut(distinct.repartitionByRange(F.col("c"), F.col("g").desc(), F.col("x").desc()).withColumn("_r", F.spark_partition_id()))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list] = {}
        for batch in batches:
            for c, g, x, r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ranges.setdefault(r, []).append((c, g, x))
        for r, rows in ranges.items():
            c, g, x = zip(*staircase(rows), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(g), pa.array(x), pa.array([r] * len(c), pa.int32())], ["c", "g", "x", "_r"])

    kept = cut(ranged.mapInArrow(local, "c double, g double, x double, _r int"))
    last = kept.agg(F.max("_r")).first()[0] or 0
    for level in range(int(last).bit_length()):
        kept = cut(beaten_by_cheaper(kept, level))
    same = (F.col(cost).cast("double") == F.col("_c")) & (F.col(gain).cast("double") == F.col("_g")) & (F.col(extra).cast("double") == F.col("_x"))
    return points.join(kept.select(F.col("c").alias("_c"), F.col("g").alias("_g"), F.col("x").alias("_x")), same, "left_semi")
