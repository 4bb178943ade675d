"""Permutation, bootstrap and rank inference with hash-derived draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veriframe.functions.hashing import hash_index
from veriframe.functions.numeric import safe_corr
from veriframe.functions.tails import kolmogorov_tail, normal_two_sided
from veriframe.operators.ranking import average_ranks, cumulative, hash_rank, value_rank
from veriframe.session import cut


def index_units(units: DataFrame, group: list[str], key: str) -> DataFrame:
    """Dense position ``idx`` and size ``n`` of each unit in its group."""
    text = isinstance(units.schema[key].dataType, StringType)  # texts get a fixed hash order, numbers their own
    d = hash_rank(units, group, F.col(key), "place") if text else value_rank(units, group, F.col(key), [])
    return d.withColumn("idx", F.col("rn") - 1).drop("rn")


def permutations(units: DataFrame, group: list[str], key: str, reps: int, seed: str) -> DataFrame:
    """``(rep, group.., key, other)``: the unit whose place each unit takes in a replicate."""
    base = units.select(*group, key)
    text = isinstance(base.schema[key].dataType, StringType)  # texts get a fixed hash order, numbers their own
    placed = hash_rank(base, group, F.col(key), "place") if text else value_rank(base, group, F.col(key), [])
    pos = placed.select(*group, F.col(key), F.col("rn").alias("pos"))
    x = units.select(*group, key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    h = hash_rank(x, ["rep", *group], F.col(key), F.concat_ws(":", F.lit(seed), F.col("rep")), few=not group).select("rep", *group, F.col(key).alias("other"), F.col("rn").alias("pos"))
    return h.join(pos, [*group, "pos"]).drop("pos")


def permuted_values(units: DataFrame, key: str, value: str, reps: int, seed: str) -> DataFrame:
    """``idx, moved``: for each place of `index_units` the values that come there in the replicates of `permutations`."""
    x = units.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    h = hash_rank(x, ["rep"], F.col(key), F.concat_ws(":", F.lit(seed), F.col("rep")), few=True)
    rows = h.groupBy((F.col("rn") - 1).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("rep", value))).alias("_r"))
    return rows.select("idx", F.transform("_r", lambda r: r[value]).alias("moved"))


def bootstrap_counts(units: DataFrame, group: list[str], key: str, reps: int, seed: str) -> DataFrame:
    """``(rep, group.., key, times)``: how often each unit is drawn with replacement.

    Every unit owns one slot per replicate and draws an index by hash, so no list of
    slots is held anywhere and the draws spread over all tasks.
    """
    ix = index_units(units.select(*group, key), group, key)
    slots = ix.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    text = F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), *[F.col(g).cast("string") for g in group], F.col("idx").cast("string"))
    drawn = slots.select("rep", *group, hash_index(text, F.col("n")).alias("idx")).groupBy("rep", *group, "idx").agg(F.count("*").alias("times"))
    return drawn.join(ix.select(*group, key, "idx"), [*group, "idx"]).drop("idx")


def interval(values: DataFrame, by: list[str], column: str) -> DataFrame:
    p = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*by).agg(p.alias("_p")).select(*by, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def permutation_p(observed: Column, hits: Column, reps: int) -> Column:
    return (1.0 + hits) / (reps + 1.0)


def ks_statistic(points: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    """Largest gap between two empirical distributions; ``side`` is a boolean column."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    c = cumulative(points, by, value, {"a": F.sum(F.when(F.col(side), one).otherwise(zero)), "b": F.sum(F.when(F.col(side), zero).otherwise(one))})
    gap = F.abs(F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b"))
    return c.groupBy(*by).agg(F.max(gap).alias("d"), F.max("all_a").alias("n_a"), F.max("all_b").alias("n_b"))


def ks_p_value(stat: DataFrame) -> DataFrame:
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return stat.withColumn("p", kolmogorov_tail(F.col("d") * (en + 0.12 + 0.11 / en)))


def mean_abs_difference(points: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    """Energy distance of one feature from running counts over sorted distinct values.

    The mean distance between samples is an integral of the distribution functions:
    ``2 * integral (Fa - Fb)^2``, so no pair of rows is ever formed.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    c = cumulative(points, by, value, {"a": F.sum(F.when(F.col(side), one).otherwise(zero)), "b": F.sum(F.when(F.col(side), zero).otherwise(one))})
    c = c.withColumn("g", F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b"))
    r = value_rank(c, by, F.col(value), [])
    nxt = r.select(*by, (F.col("rn") - 1).alias("rn"), F.col(value).alias("_next"))
    j = r.join(nxt, [*by, "rn"])
    return j.groupBy(*by).agg((2.0 * F.sum(F.col("g") * F.col("g") * (F.col("_next") - F.col(value)))).alias("energy"))


def mann_whitney(points: DataFrame, group: str, value: str, control) -> DataFrame:
    """Rank-sum test of each group against one shared control group.

    Control values are counted once in a running table; every group joins it on its
    own distinct values, so the control rows are not copied per group.
    """
    is_control = F.col(group) == F.lit(control)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    table = cumulative(points, [], value, {"c": F.sum(F.when(is_control, one).otherwise(zero))}).select(
        value, F.col("c"), (F.col("cum_c") - F.col("c")).alias("less"), F.col("all_c").alias("n0"))
    base = table.agg(F.sum(F.pow("c", 3) - F.col("c")).alias("t0"), F.max("n0").alias("m"), F.lit(1).alias("_one"))
    mine = points.filter(~is_control).groupBy(group, value).agg(F.count("*").alias("k")).join(table, value)
    both = F.col("c") + F.col("k")
    extra = (F.pow(both, 3) - both) - (F.pow("c", 3) - F.col("c"))
    u = mine.groupBy(group).agg(F.sum("k").alias("n1"), F.sum(F.col("k") * (F.col("less") + F.col("c") / 2.0)).alias("u"), F.sum(extra).alias("te"), F.lit(1).alias("_one"))
    j = u.join(F.broadcast(base), "_one").withColumn("n", F.col("n1") + F.col("m"))
    var = F.col("n1") * F.col("m") / 12.0 * (F.col("n") + 1 - (F.col("t0") + F.col("te")) / (F.col("n") * (F.col("n") - 1)))
    big = F.greatest(F.col("u"), F.col("n1") * F.col("m") - F.col("u"))
    z = (big - F.col("n1") * F.col("m") / 2.0 - 0.5) / F.sqrt(var)
    return j.select(group, "n1", "u", z.alias("z"), F.least(F.lit(1.0), normal_two_sided(z)).alias("p"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    rx = average_ranks(df, by, x).select(*by, x, F.col("avg_rank").alias("_rx"))
    ry = average_ranks(df, by, y).select(*by, y, F.col("avg_rank").alias("_ry"))
    d = df.select(*by, x, y).join(rx, [*by, x]).join(ry, [*by, y])
    return d.groupBy(*by).agg(safe_corr(F.col("_rx"), F.col("_ry")).alias("rho"))


def rank_correlations(df: DataFrame, x: str, ys: str) -> DataFrame:
    """``rep, rho``: Spearman's coefficient of ``x`` with every place ``rep`` of the array ``ys``, none of them null.

    ``x`` is ranked once. The rows are expanded only into counts and rank sums of the distinct values of each place,
    so no row is ranked or joined for a replicate. Ranks are doubled and centred: sums are whole numbers, exact in any order.
    """
    whole = lambda c: c.cast("decimal(19,0)")
    centred = 2 * F.col("cum_k") - F.col("k") - F.col("all_k")
    counts = cut(df.groupBy(x).agg(F.count("*").alias("_n")))
    rx = cumulative(counts, [], x, {"k": F.sum("_n")}).select(x, "k", centred.alias("_x"))
    long = df.select(x, ys).join(rx.select(x, "_x"), x).select("_x", F.posexplode(ys).alias("rep", "_y"))
    per = cut(long.groupBy("rep", "_y").agg(F.count("*").alias("_n"), F.sum("_x").alias("_s")))
    ry = cumulative(per, ["rep"], "_y", {"k": F.sum("_n"), "s": F.sum("_s")}).select("rep", "k", "s", centred.alias("_c"))
    sums = ry.groupBy("rep").agg(F.sum(whole(F.col("_c")) * whole(F.col("s"))).alias("xy"), F.sum(whole(F.col("k") * F.col("_c")) * whole(F.col("_c"))).alias("yy"))
    xx = rx.agg(F.sum(whole(F.col("k") * F.col("_x")) * whole(F.col("_x"))).alias("xx")).scalar()
    size = F.sqrt(xx.cast("double")) * F.sqrt(F.col("yy").cast("double"))
    return sums.select("rep", F.when(size == 0, 0.0).otherwise(F.col("xy").cast("double") / size).alias("rho"))
