"""Ranks, running sums and neighbours without putting one group into one task.

A window over a hot group would sort that group in a single task.  Here each
group is cut into buckets (hash prefix or range of the order), ranked inside the bucket
and shifted by the sizes of the earlier buckets; only bucket totals meet per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.functions.hashing import stable_key

#: Keys in a bucket of an order, most buckets, keys drawn for each edge, and edges that one coarse edge stands for.
BUCKET_ROWS = 100_000
MAX_BUCKETS = 4096
DRAWS = 16
COARSE = 64


def group_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which a null key is a key like any other."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def shift(df: DataFrame, group: list[str], totals: dict[str, Column], few: bool = False) -> DataFrame:
    """Exclusive running totals over buckets per group, joined back on (group, bucket).

    Without groups, or with ``few``, there are few rows of totals, so they are broadcast and no row of ``df`` is moved for them.
    """
    before = _totals_before(df, group, totals)
    return group_join(df, F.broadcast(before) if few or not group else before, [*group, "_b"])


def _totals_before(df: DataFrame, group: list[str], totals: dict[str, Column]) -> DataFrame:
    """Per (group, bucket): ``_o_*`` over earlier buckets, ``_g_*`` over the whole group."""
    per = df.groupBy(*group, "_b").agg(*[c.alias(f"_t_{n}") for n, c in totals.items()])
    w = W.partitionBy(*group).orderBy("_b") if group else W.partitionBy(F.lit(0)).orderBy("_b")
    return per.select(
        *group, "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{n}") for n in totals],
        *[F.sum(f"_t_{n}").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(f"_g_{n}") for n in totals],
    )


def _shifted(df: DataFrame, group: list[str], totals: dict[str, Column], order: list[Column]) -> DataFrame:
    """``df`` in buckets with ``_o_*`` and ``_g_*`` as of `shift`; ``order`` is that of the window that follows.

    A group in one bucket has its totals from the window that orders it; only groups in several buckets have
    rows in the table that is joined: one a bucket, so one for every ``BUCKET_ROWS`` rows at most.
    """
    if not group:
        return shift(df, group, totals)
    before = _totals_before(df.where("_cut"), group, totals)
    w = W.partitionBy(*group, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = df.select("*", *[c.over(w).alias(f"_w_{n}") for n, c in totals.items()])
    d = group_join(whole, F.broadcast(before), [*group, "_b"], "left")
    own = [(f"_o_{n}", F.coalesce(F.col(f"_o_{n}"), F.lit(0))) for n in totals] + [(f"_g_{n}", F.coalesce(F.col(f"_g_{n}"), F.col(f"_w_{n}"))) for n in totals]
    return d.withColumns(dict(own)).drop("_cut", *[f"_w_{n}" for n in totals])


def hash_rank(df: DataFrame, group: list[str], key: Column, namespace: str | Column = "rank", digits: int = 2, few: bool = False) -> DataFrame:
    """Adds ``rn`` (1-based position of the key's hash in its group) and ``n`` (group size).

    ``few``: groups are a fixed short list such as replicates, whose totals are broadcast.
    """
    d = df.withColumn("_h", stable_key(namespace, key)).withColumn("_b", F.substring("_h", 1, digits)).withColumn("_k", key)
    d = shift(d.withColumn("_h", F.unhex("_h")), group, {"n": F.count("*")}, few)
    rn = F.row_number().over(W.partitionBy(*group, "_b").orderBy("_h", "_k"))
    return d.withColumn("rn", (rn + F.col("_o_n")).cast("bigint")).withColumn("n", F.col("_g_n")).drop("_h", "_b", "_k", "_o_n", "_g_n")


def _order_key(value: Column, ties: list[Column], descending: bool = False) -> Column:
    """What a row is ordered by, as a struct that compares field by field: nulls first, or last when descending."""
    own = [value.isNull(), ~F.isnan(value.cast("double")), F.negative(value)] if descending else [value]
    return F.struct(*[c.alias(f"f{i}") for i, c in enumerate([*own, *ties])])


def _bucket(df: DataFrame, key: Column, draw: list[Column], group: list[str] | None = None) -> DataFrame:
    """Adds ``_b``: how many edges lie before the row's order key.

    There is a bucket for every ``BUCKET_ROWS`` distinct keys, up to ``MAX_BUCKETS``. The edges are quantiles of
    the keys with a small hash of ``draw``, ``DRAWS`` a bucket. Both numbers come from scalar
    subqueries, so nothing runs while the plan is built, and both are the same wherever the plan
    repeats them. A value that many rows hold is cut by its ties. Edges decide only how even the
    buckets are, never a result. With groups see `_bucket_in_groups`.
    """
    if group:
        return _bucket_in_groups(df, group, key, draw)
    hashed = F.xxhash64(*draw)
    size = df.agg(F.approx_count_distinct(hashed).alias("_n")).select(
        F.col("_n"), F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("_n") / BUCKET_ROWS)).cast("int").alias("_k"))
    size = size.select(F.struct("_k", F.when(F.col("_k") > 1, DRAWS * F.col("_k") / F.col("_n")).otherwise(0.0).alias("_share"))).scalar()
    drawn = df.select(key.alias("_key"), hashed.alias("_u")).withColumn("_size", size)
    drawn = drawn.where((F.col("_u") / 2.0**64 + 0.5) < F.col("_size._share")).select("_key", F.col("_size._k").alias("_k")).distinct()
    keys = drawn.agg(F.array_sort(F.collect_list("_key")).alias("_s"), F.coalesce(F.max("_k"), F.lit(1)).alias("_k"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_k") - 1, F.lit(1))), lambda i: F.get("_s", F.floor(F.size("_s") * i / F.col("_k")).cast("int")))
    edges = keys.select(F.when((F.col("_k") > 1) & (F.size("_s") > 0), F.array_distinct(at)).otherwise(F.slice("_s", 1, 0)).alias("_e"))
    d = df.withColumn("_edges", edges.select(_with_coarse("_e")).scalar())
    return d.withColumn("_b", _edges_before(key)).drop("_edges")


def _with_coarse(edges: str) -> Column:
    return F.struct(F.col(edges).alias("_e"), F.filter(edges, lambda e, i: (i + 1) % COARSE == 0).alias("_c"))


def _edges_before(key: Column) -> Column:
    passed = F.size(F.filter("_edges._c", lambda e: e < key)) * COARSE
    rest = F.slice("_edges._e", passed + 1, COARSE)
    return passed + F.size(F.filter(rest, lambda e: e < key))


def _bucket_in_groups(df: DataFrame, group: list[str], key: Column, draw: list[Column]) -> DataFrame:
    """Adds ``_b`` and ``_cut``: only groups of more than ``BUCKET_ROWS`` rows are cut, each by edges of its own.

    The rows of other groups need no edge and stay in bucket 0. Groups that are cut, and their edges, are one for every
    ``BUCKET_ROWS`` rows at most, so they are broadcast.
    """
    rows = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET_ROWS)
    buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("_n") / BUCKET_ROWS)).cast("int")
    large = rows.select(*group, buckets.alias("_k"), (DRAWS * buckets / F.col("_n")).alias("_share"))
    keys = df.select(*group, key.alias("_key"), F.xxhash64(*draw).alias("_u"))
    drawn = group_join(keys, F.broadcast(large), group).where((F.col("_u") / 2.0**64 + 0.5) < F.col("_share")).select(*group, "_key", "_k").distinct()
    found = drawn.groupBy(*group).agg(F.array_sort(F.collect_list("_key")).alias("_s"), F.max("_k").alias("_k"))
    at = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.get("_s", F.floor(F.size("_s") * i / F.col("_k")).cast("int")))
    edges = found.select(*group, F.array_distinct(at).alias("_e")).select(*group, _with_coarse("_e").alias("_edges"))
    d = group_join(df, F.broadcast(edges), group, "left")
    cut = F.col("_edges").isNotNull()
    return d.withColumn("_cut", cut).withColumn("_b", F.when(cut, _edges_before(key)).otherwise(0)).drop("_edges")


def value_rank(df: DataFrame, group: list[str], value: Column, ties: list[Column], descending: bool = False) -> DataFrame:
    """Adds ``rn`` and ``n`` for the order (value, ties) in each group."""
    d = df.withColumn("_v", value)
    d = _bucket(d, _order_key(F.col("_v"), ties, descending), [*map(F.col, group), F.col("_v"), *ties], group)
    first = F.col("_v").desc() if descending else F.col("_v").asc()
    d = _shifted(d, group, {"n": F.count("*")}, [first, *ties])
    rn = F.row_number().over(W.partitionBy(*group, "_b").orderBy(first, *ties))
    return d.withColumn("rn", (rn + F.col("_o_n")).cast("bigint")).withColumn("n", F.col("_g_n")).drop("_v", "_b", "_o_n", "_g_n")


def cumulative(df: DataFrame, group: list[str], value: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Distinct values per group with ``name`` (own sum), ``cum_name`` (running) and ``all_name`` (total).

    Equal values are merged before anything is ordered, so a value held by a third
    of all rows is one row here.
    """
    per = df.groupBy(*group, value).agg(*[c.alias(n) for n, c in sums.items()])
    per = _bucket(per, _order_key(F.col(value), [], descending), [*map(F.col, group), F.col(value)], group)
    order = F.col(value).desc() if descending else F.col(value).asc()
    d = _shifted(per, group, {n: F.sum(n) for n in sums}, [order])
    w = W.partitionBy(*group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = d.select(
        *group, value, *sums,
        *[(F.sum(n).over(w) + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in sums],
        *[F.col(f"_g_{n}").alias(f"all_{n}") for n in sums],
    )
    return out


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float], weight: str | None = None) -> DataFrame:
    """Per group ``q``: the interpolated quantiles of the values that aren't null, ``n``: their number.

    Running counts over distinct values take the place of an aggregate that holds all distinct
    values of a group in one buffer: a group of any size is spread over buckets, and only the
    values at the wanted positions are kept. ``weight``: a column of whole numbers, how often a row counts.
    Groups without a value have no row.
    """
    times = F.count("*") if weight is None else F.sum(F.col(weight).cast("bigint"))
    rows = df.filter(F.col(value).isNotNull() if weight is None else F.col(value).isNotNull() & (F.col(weight) > 0))
    c = cumulative(rows.select(*group, value, *([weight] if weight else [])), group, value, {"_c": times})
    v = F.col(value).cast("double")
    before = F.col("cum__c") - F.col("_c")

    def at(position: Column) -> Column:
        return F.max(F.when((before <= position) & (position < F.col("cum__c")), v))

    ends = []
    for i, p in enumerate(probs):
        place = (F.col("all__c") - 1) * F.lit(float(p))
        ends += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}")]
    found = c.groupBy(*group).agg(F.max("all__c").alias("n"), *ends).filter("n is not null")

    def between(i: int, p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(p))
        part = place - F.floor(place)
        return F.when(part == 0, F.col(f"_l{i}")).otherwise(F.col(f"_l{i}") * (1 - part) + F.col(f"_h{i}") * part)

    return found.select(*group, F.array(*[between(i, p) for i, p in enumerate(probs)]).alias("q"), "n")


def exact_median(df: DataFrame, group: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """``group.., name``: the median of each group."""
    return exact_quantiles(df, group, value, [0.5], weight).select(*group, F.col("q")[0].alias(name))


def median_of(df: DataFrame, value: str) -> Column:
    """The median of a whole column as a scalar subquery; null when there is none."""
    return exact_median(df, [], value, "m").scalar()


def average_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Distinct values with their tie-averaged rank."""
    c = cumulative(df, group, value, {"cnt": F.count("*")})
    return c.select(*group, value, (F.col("cum_cnt") - (F.col("cnt") - 1) / 2.0).alias("avg_rank"), "cnt", F.col("all_cnt").alias("n"))


def suffix_min(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Adds ``sfx``: the smallest ``value`` at this or any later position of ``order``."""
    d = _bucket(df, _order_key(F.col(order), []), [*map(F.col, group), F.col(order)], group)
    per = d.groupBy(*group, "_b").agg(F.min(value).alias("_t"))
    # Read backwards: a frame that grows takes a step a row, one that shrinks (to unboundedFollowing) starts anew at every row.
    w = W.partitionBy(*group).orderBy(F.desc("_b")) if group else W.partitionBy(F.lit(0)).orderBy(F.desc("_b"))
    later = per.select(*group, "_b", F.min("_t").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    inner = F.min(value).over(W.partitionBy(*group, "_b").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    return group_join(d, later, [*group, "_b"]).withColumn("sfx", F.least(inner, F.col("_later"))).drop("_b", "_later", "_cut")


def with_previous(df: DataFrame, group: list[str], columns: list[str], k: int = 1, how: str = "left") -> DataFrame:
    """Neighbour ``k`` positions earlier as ``prev_*`` through an equi join on (group, rn)."""
    before = df.select(*group, (F.col("rn") + k).alias("rn"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return group_join(df, before, [*group, "rn"], how)


def after_neighbour(df: DataFrame, group: list[str], value: str, ties: list[Column], columns: list[str]) -> DataFrame:
    """Every row but the first of its group in the order (value, ties), with ``prev_*`` of the row before it.

    Neighbours come from the window over a bucket; the first row of a later bucket takes the last row of the
    bucket before it from a broadcast table with one row a bucket of the groups that are cut.
    """
    if not group:
        return with_previous(value_rank(df, group, F.col(value), ties), group, columns, 1, "inner")
    key = _order_key(F.col(value), ties)
    d = _bucket(df, key, [*map(F.col, group), F.col(value), *ties], group)
    row = F.struct(*columns)
    last = d.where("_cut").groupBy(*group, "_b").agg(F.max_by(row, key).alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(W.partitionBy(*group).orderBy("_b")))
    d = d.withColumn("_prev", F.lag(row).over(W.partitionBy(*group, "_b").orderBy(value, *ties)))
    d = group_join(d, F.broadcast(last), [*group, "_b"], "left").withColumn("_prev", F.coalesce("_prev", "_last")).where("_prev IS NOT NULL")
    return d.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])


def benjamini_hochberg(tests: DataFrame, group: list[str], p: str) -> DataFrame:
    """Adds ``q``: adjusted p with monotonicity enforced from the largest p downwards."""
    c = cumulative(tests, group, p, {"cnt": F.count("*")})
    raw = c.withColumn("_raw", F.col(p) * F.col("all_cnt") / F.col("cum_cnt"))
    q = suffix_min(raw, group, p, "_raw").select(*group, p, F.least(F.lit(1.0), F.col("sfx")).alias("q"))
    return group_join(tests, q, [*group, p]).withColumn("q", F.when(F.col(p).isNotNull(), F.col("q")))


def holm(tests: DataFrame, group: list[str], p: str, key: str, alpha: float) -> DataFrame:
    """Adds ``rejected``: a test is rejected while every smaller p passed its step.

    The first failing step decides, so only the smallest failing p is needed.
    """
    ranked = value_rank(tests, group, F.col(p), [F.col(key)])
    fails = F.col(p) > alpha / (F.col("n") - F.col("rn") + 1)
    first = ranked.groupBy(*group).agg(F.min(F.when(fails, F.col("rn"))).alias("_stop"))
    if not group:  # one row joined on a constant key
        ranked, first = ranked.withColumn("_one", F.lit(1)), first.withColumn("_one", F.lit(1))
    joined = group_join(ranked, F.broadcast(first) if not group else first, group or ["_one"])
    return joined.withColumn("rejected", F.coalesce(F.col("rn") < F.col("_stop"), F.lit(True))).drop("_stop", "rn", "n", "_one")
