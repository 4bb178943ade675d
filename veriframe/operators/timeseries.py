"""Event-aligned counts, fixed-bin rates and trajectory statistics on long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.functions.numeric import corr, safe_corr
from veriframe.operators.ranking import after_neighbour, shift, value_rank, with_previous

#: Spikes of a unit that `event_windows` counts as columns.
FEW = 4


def interval_join(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, stop: str, width: float, how: str = "inner") -> DataFrame:
    """Points inside half-open intervals ``[start, stop)``.

    Intervals are listed in the ``width``-sized buckets they touch, so the join is
    an equi join on (key, bucket) and one key is spread over its buckets.
    """
    bucket = lambda c: F.floor(c / width).cast("bigint")
    iv = intervals.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(stop)))))
    own = set(intervals.columns) - set(key)
    pt = points.select(*[c for c in points.columns if c not in own]).withColumn("_b", bucket(F.col(at)))
    hit = iv.join(pt, [*key, "_b"], "inner").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_b")
    return hit


def event_windows(spikes: DataFrame, events: DataFrame, key: list[str], window: float) -> DataFrame:
    """Signed count per (event, unit, region): responses minus baseline.

    The spikes of a unit stand as one short list in every time bucket whose events can reach them, and an event in
    its own bucket: each row of the join is a row of the result, so pairs of events and spikes are neither moved nor grouped.
    Lists of at most ``FEW`` spikes are columns, counted in generated code; only longer ones are walked through row by row.
    """
    bucket = lambda c: F.floor(c / window).cast("bigint")
    t, at, reach = F.col("t"), F.col("at"), window * (1 + 1e-9)
    own = [c for c in events.columns if c not in key]
    lists = spikes.select(*key, "region", "unit", "t", F.explode(F.sequence(bucket(t - reach), bucket(t + reach))).alias("_b"))
    lists = lists.groupBy(*key, "_b", "region", "unit").agg(F.collect_list("t").alias("_t"))
    names = [f"_t{i}" for i in range(FEW)]
    few = lists.where(F.size("_t") <= FEW).select(*key, "_b", "region", "unit", *[F.get("_t", F.lit(i)).alias(n) for i, n in enumerate(names)])
    inside = lambda x, low, high: (x >= low) & (x < high)
    in_columns = lambda low, high: sum((F.when(inside(F.col(n), low, high), 1).otherwise(0) for n in names), F.lit(0)).cast("bigint")
    in_list = lambda low, high: F.size(F.filter("_t", lambda x: inside(x, low, high))).cast("bigint")

    def counted(rows: DataFrame, between) -> DataFrame:
        pair = events.withColumn("_b", bucket(at)).join(rows.hint("merge"), [*key, "_b"])
        out = pair.select(*key, *own, "region", "unit", between(at, at + window).alias("n_response"), between(at - window, at).alias("n_baseline"))
        return out.where("n_response + n_baseline > 0")

    return counted(few, in_columns).unionByName(counted(lists.where(F.size("_t") > FEW), in_list))


def unit_counts(spikes: DataFrame, key: list[str]) -> DataFrame:
    return spikes.groupBy(*key, "region").agg(F.count_distinct("unit").alias("units"))


def signed_sums(spikes: DataFrame, events: DataFrame, key: list[str], window: float) -> DataFrame:
    """Per (key, region) the spikes after an event minus those before it, over all events, the even and the others.

    What a spike counts for is a step function of its time that changes only at the three edges of each event,
    so edges and spikes are put in order and the changes run up, within time buckets and over their totals: no pair is formed.
    """
    edge = lambda x, change: F.struct(x.alias("x"), F.lit(change).cast("bigint").alias("c"))
    at, none = F.col("at"), F.lit(0).cast("bigint")
    edges = events.select(*key, "even", F.inline(F.array(edge(at - window, -1), edge(at, 2), edge(at + window, -1))))
    kind = spikes.schema["region"].dataType
    rows = edges.select(*key, "x", F.lit(None).cast(kind).alias("region"), none.alias("n"), "c", F.when(F.col("even"), F.col("c")).otherwise(none).alias("c0"))
    rows = rows.unionByName(spikes.select(*key, F.col("t").alias("x"), "region", F.lit(1).cast("bigint").alias("n"), none.alias("c"), none.alias("c0")))
    rows = rows.groupBy(*key, "x", "region").agg(*[F.sum(c).alias(c) for c in ("n", "c", "c0")])
    rows = shift(rows.withColumn("_b", F.floor(F.col("x") / window).cast("bigint")), key, {"c": F.sum("c"), "c0": F.sum("c0")})
    upto = W.partitionBy(*key, "_b").orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select(*key, "region", "n", *[(F.sum(c).over(upto) + F.col(f"_o_{c}")).alias(c) for c in ("c", "c0")]).where("n > 0")
    return rows.groupBy(*key, "region").agg(
        F.sum(F.col("n") * F.col("c")).alias("all"), F.sum(F.col("n") * F.col("c0")).alias("first"), F.sum(F.col("n") * (F.col("c") - F.col("c0"))).alias("second"))


def change_profile(spikes: DataFrame, events: DataFrame, key: list[str], window: float) -> DataFrame:
    """Mean signed response per region, with odd and even events apart."""
    even = F.col("ordinal") % 2 == 0
    sums = signed_sums(spikes, events.select(*key, "at", even.alias("even")), key, window)
    n = events.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(even).alias("n0"), F.count_if(~even).alias("n1"))
    out = unit_counts(spikes, key).join(n, key).join(sums, [*key, "region"], "left").na.fill(0, ["all", "first", "second"])
    scale = F.col("units") * window
    return out.select(
        *key, "region", F.col("n").alias("events"),
        (F.col("all") / F.col("n") / scale).alias("response_hz"),
        (F.col("first") / F.col("n0") / scale).alias("odd_hz"),
        (F.try_divide(F.col("second"), F.col("n1")) / scale).alias("even_hz"),
    )


def bin_counts(spikes: DataFrame, events: DataFrame, key: list[str], start: float, stop: float, bin_size: float, n_bins: int) -> DataFrame:
    """Per (key, region, bin) the spikes in that bin of an event's window: over all events ``n``, the even ``n0``, the others ``n1``.

    How many events have a time in their bin is a step function of that time, so starts of bins and spikes are put
    in order and the starts run up, as in `signed_sums`: no pair is formed. A bin starts at the first number
    that ``floor((t - start of the window) / bin_size)`` puts there, found by halving, so rounding is that of a pair.
    """
    w0, b = F.col("at") + start, F.col("b")
    near = (F.abs(w0) + (stop - start)) * 2.0**-45  # more than the rounding of the expression
    middle = lambda s: (s["lo"] + s["hi"]) / 2
    ends = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), ends(w0 + b * bin_size - near, w0 + b * bin_size + near),
        lambda s, _: F.when(F.floor((middle(s) - w0) / bin_size) >= b, ends(s["lo"], middle(s))).otherwise(ends(middle(s), s["hi"])))["hi"]
    x = F.when(b == 0, w0).when(b == n_bins, F.col("at") + stop).otherwise(found)
    kind, one, none = spikes.schema["region"].dataType, F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    edges = events.groupBy(*key, "at").agg(F.count("*").alias("c"), F.count_if("even").alias("c0")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_bins))))
    rows = edges.select(*key, x.alias("x"), F.lit(None).cast(kind).alias("region"), none.alias("n"), "b", "c", "c0")
    rows = rows.unionByName(spikes.groupBy(*key, F.col("t").alias("x"), "region").agg(F.sum(one).alias("n")).withColumns({"b": F.lit(-1), "c": none, "c0": none}))
    sums = {f"{c}_{i}": F.sum(F.when(b == i, F.col(c)).otherwise(none)) for i in range(n_bins + 1) for c in ("c", "c0")}
    rows = shift(rows.withColumn("_b", F.floor(F.col("x") / (stop - start)).cast("bigint")), key, sums)
    upto = W.partitionBy(*key, "_b").orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select(*key, "region", "n", *[(s.over(upto) + F.col(f"_o_{name}")).alias(name) for name, s in sums.items()]).where("n > 0")
    inside = lambda c, i: F.sum(F.col("n") * (F.col(f"{c}_{i}") - F.col(f"{c}_{i + 1}")))
    out = rows.groupBy(*key, "region").agg(*[inside(c, i).alias(f"{c}_in_{i}") for i in range(n_bins) for c in ("c", "c0")])
    bins = F.array(*[F.struct(F.lit(i).cast("bigint").alias("bin"), F.col(f"c_in_{i}").alias("n"), F.col(f"c0_in_{i}").alias("n0")) for i in range(n_bins)])
    return out.select(*key, "region", F.inline(bins)).withColumn("n1", F.col("n") - F.col("n0"))


def change_timecourse(spikes: DataFrame, events: DataFrame, key: list[str], start: float, stop: float, bin_size: float) -> DataFrame:
    """Zero-filled rate per (region, bin) around the events, with odd and even events apart."""
    n_bins = int(round((stop - start) / bin_size))
    even = F.col("ordinal") % 2 == 0
    c = bin_counts(spikes, events.select(*key, "at", even.alias("even")), key, start, stop, bin_size, n_bins)
    ev = events.groupBy(*key).agg(F.count("*").alias("e"), F.count_if(even).alias("e0"), F.count_if(~even).alias("e1"))
    spine = unit_counts(spikes, key).join(ev, key).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))))
    d = spine.join(c, [*key, "region", "bin"], "left").na.fill(0, ["n", "n0", "n1"])
    scale = F.col("units") * bin_size
    return d.select(
        *key, "region", "bin", (F.lit(start) + (F.col("bin") + 0.5) * bin_size).alias("time"),
        (F.col("n") / F.col("e") / scale).alias("hz"), (F.col("n0") / F.col("e0") / scale).alias("odd_hz"),
        F.coalesce(F.try_divide(F.col("n1"), F.col("e1")) / scale, F.lit(0.0)).alias("even_hz"))


def binned_rates(spikes: DataFrame, intervals: DataFrame, key: list[str], bin_size: float) -> DataFrame:
    """Rate per unit and second in fixed bins of each key's longest interval; the last bin may be short."""
    best = intervals.groupBy(*key).agg(F.max_by(F.struct("start", "stop"), F.struct(F.col("stop") - F.col("start"), -F.col("start"))).alias("i"))
    best = best.select(*key, "i.start", "i.stop").withColumn("bins", F.ceil(F.round((F.col("stop") - F.col("start")) / bin_size, 9)).cast("bigint"))
    inside = spikes.join(best, key).filter((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("stop")))
    inside = inside.withColumn("bin", F.least(F.floor((F.col("t") - F.col("start")) / bin_size).cast("bigint"), F.col("bins") - 1))
    c = inside.groupBy(*key, "region", "bin").agg(F.count("*").alias("n"))
    spine = unit_counts(spikes, key).join(best, key).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)))
    d = spine.join(c, [*key, "region", "bin"], "left").na.fill(0, ["n"])
    right = F.least(F.col("start") + (F.col("bin") + 1) * bin_size, F.col("stop"))
    left = F.col("start") + F.col("bin") * bin_size
    return d.select(*key, "region", "bin", ((left + right) / 2 - F.col("start")).alias("time"), (F.col("n") / (F.col("units") * (right - left))).alias("hz"))


def mean_in_intervals(frames: DataFrame, trials: DataFrame, key: list[str], width: float) -> DataFrame:
    """Mean trace per trial interval; an empty interval gives null."""
    hit = interval_join(frames, trials, key, "frame", "start", "stop", width)
    m = hit.groupBy(*key, "trial").agg(F.avg("value").alias("mean"))
    return trials.select(*key, "trial").join(m, [*key, "trial"], "left")


# ---- trajectory transforms on (key.., region, time, x) -----------------------

def baseline_subtract(tc: DataFrame, key: list[str]) -> DataFrame:
    base = tc.groupBy(*key).agg(F.avg(F.when(F.col("time") < 0, F.col("x"))).alias("_m"))
    return tc.join(base, key).withColumn("x", F.col("x") - F.col("_m")).drop("_m")


def peak_normalize(tc: DataFrame, key: list[str]) -> DataFrame:
    top = tc.groupBy(*key).agg(F.max(F.abs("x")).alias("_s"))
    return tc.join(top, key).withColumn("x", F.when(F.col("_s") > 0, F.col("x") / F.col("_s")).otherwise(0.0)).drop("_s")


def derivative(tc: DataFrame, key: list[str]) -> DataFrame:
    d = with_previous(value_rank(tc, key, F.col("time"), []), key, ["x"])
    return d.withColumn("x", F.coalesce(F.col("x") - F.col("prev_x"), F.lit(0.0))).drop("prev_x", "rn", "n")


def autocorrelation(tc: DataFrame, key: list[str], lag: int) -> DataFrame:
    d = with_previous(value_rank(tc, key, F.col("time"), []), key, ["x"], lag, "inner")
    return d.groupBy(*key).agg(safe_corr(F.col("prev_x"), F.col("x")).alias("r"))


def first_crossing(tc: DataFrame, key: list[str], onset: float, k: float) -> DataFrame:
    """Time from onset to the first sample above baseline mean + k deviations; null if none."""
    before = F.when(F.col("time") < onset, F.col("x"))
    base = tc.groupBy(*key).agg((F.avg(before) + k * F.stddev_pop(before)).alias("_thr"))
    over = (F.col("time") >= onset) & (F.col("x") > F.col("_thr"))
    return tc.join(base, key).groupBy(*key).agg(F.min(F.when(over, F.col("time") - onset)).alias("latency"))


def peak_latency(tc: DataFrame, key: list[str], stop: float) -> DataFrame:
    """Time of the maximum after onset; the first bin wins ties."""
    post = tc.filter((F.col("time") > 0) & (F.col("time") <= stop))
    return post.groupBy(*key).agg(F.max_by("time", F.struct("x", -F.col("time"))).alias("latency"))


def evoked_amplitude(tc: DataFrame, key: list[str], onset: float, duration: float) -> DataFrame:
    t = F.col("time")
    return tc.groupBy(*key).agg((F.avg(F.when((t >= onset) & (t < onset + duration), F.col("x"))) - F.avg(F.when(t < onset, F.col("x")))).alias("amplitude"))


def lead_lag(tc: DataFrame, key: list[str], stop: float, max_lag: int) -> DataFrame:
    """Sign of the best-correlating lag per ordered region pair; the first lag wins ties.

    The join meets equal (key, step) rows only; the partners of a row are the other
    regions at that step, and regions are a small fixed vocabulary.
    """
    post = value_rank(tc.filter((F.col("time") > 0) & (F.col("time") <= stop)), [*key, "region"], F.col("time"), []).select(*key, "region", F.col("rn").alias("step"), "x")
    left = post.select(*key, F.col("region").alias("left"), F.col("x").alias("a"), F.col("step").alias("s"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    left = left.withColumn("step", F.col("s") + F.col("lag"))
    right = post.select(*key, F.col("region").alias("right"), F.col("x").alias("b"), "step")
    pair = left.join(right, [*key, "step"]).filter("left < right")
    flat = (F.stddev_pop("a") == 0) | (F.stddev_pop("b") == 0) | (F.count("*") < 3)
    score = pair.groupBy(*key, "left", "right", "lag").agg(F.when(flat, None).otherwise(F.round(corr(F.col("a"), F.col("b")), 9)).alias("score"))
    best = score.groupBy(*key, "left", "right").agg(F.max_by("lag", F.struct(F.coalesce("score", F.lit(-2.0)), -F.col("lag"))).alias("lag"), F.max("score").alias("top"))
    return best.select(*key, "left", "right", F.when(F.col("top").isNull(), 0).otherwise(F.signum("lag")).cast("bigint").alias("sign"))


def recovery_time(diff: DataFrame, key: list[str], after: float, tolerance: float) -> DataFrame:
    """First time after which every later difference stays within tolerance.

    Only the last violation matters, so two aggregates replace a suffix scan.
    """
    late = diff.filter(F.col("time") >= after)
    last_bad = late.groupBy(*key).agg(F.max(F.when(F.col("x") > tolerance, F.col("time"))).alias("_bad"))
    ok = late.join(last_bad, key)
    good = F.col("_bad").isNull() | (F.col("time") > F.col("_bad"))
    return ok.groupBy(*key).agg(F.min(F.when(good, F.col("time") - after)).alias("recovery"))


def power_spectrum(tc: DataFrame, key: list[str], dt: float) -> DataFrame:
    """Power per frequency of the centred series by direct sums over (step, frequency)."""
    d = value_rank(tc, key, F.col("time"), [])
    m = tc.groupBy(*key).agg(F.avg("x").alias("_m"))
    d = d.join(m, key).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / 2))))
    angle = 2.0 * 3.141592653589793 * F.col("k") * (F.col("rn") - 1) / F.col("n")
    c = F.col("x") - F.col("_m")
    s = d.groupBy(*key, "k", "n").agg(F.sum(c * F.cos(angle)).alias("re"), F.sum(c * F.sin(angle)).alias("im"))
    return s.select(*key, "k", (F.col("k") / (F.col("n") * dt)).alias("frequency"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("power"))


def functional_connectivity(tc: DataFrame, key: list[str]) -> DataFrame:
    """Correlation of every region pair over time (regions are a small vocabulary)."""
    a = tc.select(*key, "time", F.col("region").alias("r1"), F.col("x").alias("a"))
    b = tc.select(*key, "time", F.col("region").alias("r2"), F.col("x").alias("b"))
    return a.join(b, [*key, "time"]).filter("r1 < r2").groupBy(*key, "r1", "r2").agg(safe_corr(F.col("a"), F.col("b")).alias("fc"))


def igci_slopes(pairs: DataFrame, key: list[str], x: str, y: str, ties: list[Column]) -> DataFrame:
    """Mean log absolute slope along the order of x after standardization."""
    m = pairs.groupBy(*key).agg(F.avg(x).alias("_mx"), F.stddev_pop(x).alias("_sx"), F.avg(y).alias("_my"), F.stddev_pop(y).alias("_sy"))
    d = after_neighbour(pairs, key, x, [F.col(y), *ties], [x, y]).join(m, key)
    dx = (F.col(x) - F.col(f"prev_{x}")) / F.col("_sx")
    dy = (F.col(y) - F.col(f"prev_{y}")) / F.col("_sy")
    use = F.abs(dx) > 1e-9
    return d.groupBy(*key).agg(F.avg(F.when(use, F.log(F.abs(dy / dx) + 1e-12))).alias("slope_score"), F.count_if(use).alias("steps"))
