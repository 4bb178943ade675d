"""Ordered unit pairs: connected pairs exactly, unconnected ones by hash draws.

All ordered pairs of n units are n*(n-1) rows and cannot be formed at scale.  The
frame holds every connected pair and, per unit, ``per_unit`` hash-drawn partners
that are not connected to it; statistics that compare connected pairs with matched
unconnected ones sample that pool anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.functions.hashing import hash_index, stable_key
from veriframe.functions.numeric import circular_similarity
from veriframe.operators.inference import index_units
from veriframe.operators.ranking import group_join, hash_rank
from veriframe.session import cut

METRICS = ("aggregate_functional", "response_profile", "orientation", "direction", "cc_norm", "readout_location")
CONTINUOUS = ("cc_abs", "cc_max", "cc_norm", "osi", "dsi", "gosi", "gdsi")


def aggregate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("pre", "post").agg(F.count("*").alias("synapse_count"), F.sum("size").alias("synapse_size_sum"))


def degrees(agg: DataFrame) -> tuple[DataFrame, DataFrame]:
    return agg.groupBy("pre").agg(F.count("*").alias("pre_degree")), agg.groupBy("post").agg(F.count("*").alias("post_degree"))


def control_pairs(units: DataFrame, agg: DataFrame, per_unit: int, seed: str) -> DataFrame:
    """Distinct unconnected ordered pairs: each unit draws ``per_unit`` offsets, never itself."""
    ix = index_units(units.select("root"), [], "root")
    draws = ix.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_unit - 1))))
    off = hash_index(F.concat_ws(":", F.lit(seed), F.col("root").cast("string"), F.col("j").cast("string")), F.col("n") - 1) + 1
    d = draws.select(F.col("root").alias("pre"), F.pmod(F.col("idx") + off, F.col("n")).alias("idx")).distinct()
    d = d.join(ix.select(F.col("root").alias("post"), "idx"), "idx").select("pre", "post")
    return d.join(agg.select("pre", "post"), ["pre", "post"], "left_anti")


def pair_frame(units: DataFrame, edges: DataFrame, per_unit: int = 32, seed: str = "control") -> DataFrame:
    # Both are read several times below: written once to the checkpoint folder.
    units, agg = cut(units), cut(aggregate_edges(edges))
    con = agg.withColumn("connected", F.lit(True))
    ctl = control_pairs(units, agg, per_unit, seed).select("pre", "post", F.lit(0).cast("bigint").alias("synapse_count"), F.lit(0.0).alias("synapse_size_sum"), F.lit(False).alias("connected"))
    out, inn = degrees(agg)
    f = con.unionByName(ctl).join(out, "pre", "left").join(inn, "post", "left").na.fill(0, ["pre_degree", "post_degree"])
    return attach_units(f, units)


def attach_units(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pair geometry and metrics from the two units' attributes."""
    cols = [c for c in units.columns if c != "root"]
    a = units.select(F.col("root").alias("pre"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = units.select(F.col("root").alias("post"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return add_metrics(pairs.join(a, "pre").join(b, "post"))


def _norm(names: list[str]):
    sq = [(F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names]
    return F.sqrt(sum(sq[1:], sq[0]))


def add_metrics(f: DataFrame) -> DataFrame:
    """Distance and six similarities; the standardized columns are ``z_*`` of the units."""
    response = -_norm([f"z_{c}" for c in CONTINUOUS])
    orientation = circular_similarity(F.col("a_pref_ori"), F.col("b_pref_ori"), 180.0)
    direction = circular_similarity(F.col("a_pref_dir"), F.col("b_pref_dir"), 360.0)
    return f.select(
        *[c for c in f.columns if c[:2] not in ("a_", "b_")],
        _norm(["x", "y", "z"]).alias("distance"), (F.col("a_kind") == F.col("b_kind")).alias("same_kind"), F.concat_ws("->", "a_kind", "b_kind").alias("kind_pair"),
        (F.col("a_quadrant") == F.col("b_quadrant")).alias("same_quadrant"), (F.col("a_reliable") & F.col("b_reliable")).alias("both_reliable"),
        (response + orientation + direction).alias("aggregate_functional"), response.alias("response_profile"), orientation.alias("orientation"), direction.alias("direction"),
        (-F.abs(F.col("a_cc_norm") - F.col("b_cc_norm"))).alias("cc_norm"), (-_norm(["readout_x", "readout_y"])).alias("readout_location"))


def prepare_units(units: DataFrame) -> DataFrame:
    """Standardized columns, readout quadrant and reliability flag from one-row population summaries."""
    stats = units.agg(
        *[F.avg(c).alias(f"m_{c}") for c in CONTINUOUS], *[F.stddev_pop(c).alias(f"s_{c}") for c in CONTINUOUS],
        F.median("readout_x").alias("mx"), F.median("readout_y").alias("my"), F.median("cc_norm").alias("mr"), F.lit(1).alias("_one"))
    u = units.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
    z = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))).alias(f"z_{c}") for c in CONTINUOUS]
    quadrant = F.concat(F.when(F.col("readout_x") >= F.col("mx"), "R").otherwise("L"), F.when(F.col("readout_y") >= F.col("my"), "U").otherwise("D"))
    return u.select(*units.columns, *z, quadrant.alias("quadrant"), (F.col("cc_norm") >= F.col("mr")).alias("reliable"))


def matched_null(frame: DataFrame, by: list[str], bins: list[str], metrics: list[str], reps: int, seed: str) -> DataFrame:
    """Null means per replicate: as many unconnected pairs per bin as there are connected ones.

    Without replacement by hash rank where the pool is large enough, otherwise each
    connected pair draws one pool member by hash; a bin without any pool falls back to
    the whole pool of its stratum.  ``frame`` has ``pair_id`` and ``connected``.
    """
    key = [*by, "_bin"]
    f = frame.withColumn("_bin", F.concat_ws("|", *[F.col(b).cast("string") for b in bins]) if bins else F.lit("all"))
    f = cut(f.select(*key, "pair_id", "connected", *metrics))
    sizes = f.groupBy(*key).agg(F.sum(F.col("connected").cast("bigint")).alias("need"), F.sum((~F.col("connected")).cast("bigint")).alias("have")).filter("need > 0")
    all_reps = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    pool = f.filter(~F.col("connected")).select(*key, "pair_id", *metrics)
    # Hashes by first digit: those before the digit that holds the last pair needed are taken as they are, only that one is ranked.
    name = F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"))
    full = group_join(pool, F.broadcast(sizes.filter("have >= need")), key).withColumn("rep", all_reps)
    full = full.withColumn("_d", F.substring(stable_key(name, F.col("pair_id")), 1, 1))
    upto = W.partitionBy(*key, "rep").orderBy("_d").rowsBetween(W.unboundedPreceding, 0)
    digits = full.groupBy(*key, "rep", "need", "_d").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    last = digits.filter((F.col("_upto") >= F.col("need")) & (F.col("_upto") - F.col("_n") < F.col("need"))).select(
        *key, "rep", F.col("_d").alias("_last"), (F.col("need") - F.col("_upto") + F.col("_n")).alias("_left"))
    full = group_join(full, F.broadcast(last), [*key, "rep"])
    taken = full.filter(F.col("_d") < F.col("_last")).select(*by, "rep", *metrics).unionByName(
        hash_rank(full.filter(F.col("_d") == F.col("_last")), [*key, "rep"], F.col("pair_id"), name).filter(F.col("rn") <= F.col("_left")).select(*by, "rep", *metrics))
    short = sizes.filter("have < need").withColumn("src", F.when(F.col("have") > 0, F.col("_bin")).otherwise(F.lit("*")))
    whole = pool.withColumn("_bin", F.lit("*"))
    wanted = short.select(*by, F.col("src").alias("_bin")).distinct().withColumn("_wanted", F.lit(True))
    members = group_join(pool.unionByName(whole), F.broadcast(wanted), key).drop("_wanted")
    members = hash_rank(members, key, F.col("pair_id"), "pool").select(*by, F.col("_bin").alias("src"), (F.col("rn") - 1).alias("slot"), *metrics, F.col("n").alias("size"))
    # A draw moves as three numbers: pools get numbers, one for each stratum and bin.
    totals = members.groupBy(*by, "src").agg(F.max("size").alias("size")).withColumn("_pool", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*by, "src")))
    slots = group_join(f.filter("connected").select(*key, "pair_id"), F.broadcast(short), key)
    slots = group_join(slots, F.broadcast(totals), [*by, "src"]).withColumn("rep", all_reps)
    text = F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("pair_id"))
    drawn = slots.select("_pool", F.col("rep").cast("short").alias("rep"), hash_index(text, F.col("size")).alias("slot"))
    found = group_join(members.drop("size"), F.broadcast(totals.drop("size")), [*by, "src"]).select("_pool", "slot", *by, *metrics)
    drawn = drawn.join(found.hint("merge"), ["_pool", "slot"]).select(*by, F.col("rep").cast("int").alias("rep"), *metrics)
    return taken.unionByName(drawn).groupBy(*by, "rep").agg(*[F.avg(m).alias(m) for m in metrics])


def null_tests(frame: DataFrame, null: DataFrame, by: list[str], metrics: list[str], reps: int) -> DataFrame:
    """Observed minus null mean and one-sided p per (stratum, metric), in long form."""
    obs = frame.filter("connected").groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_connected"))
    long = lambda d, keep: d.select(*keep, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))
    o = long(obs, [*by, "n_connected"]).withColumnRenamed("value", "observed")
    j = long(cut(null), [*by, "rep"]).join(o, [*by, "metric"])
    return j.groupBy(*by, "metric", "n_connected", "observed").agg(
        F.avg("value").alias("null_mean"), ((1 + F.count_if(F.col("value") >= F.col("observed"))) / (reps + 1.0)).alias("p")
    ).withColumn("delta", F.col("observed") - F.col("null_mean"))


def gram(frame: DataFrame, xs: list, y) -> tuple[list, list, float, int]:
    """Sums of products for a handful of columns: one aggregate, one small row on the driver."""
    k = len(xs)
    aggs = [F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(xs[i] * y).alias(f"c{i}") for i in range(k)] + [F.sum(y * y).alias("yy"), F.count("*").alias("n")]
    r = frame.agg(*aggs).first()
    g = [[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
    return g, [r[f"c{i}"] for i in range(k)], r["yy"], r["n"]


def dyadic_meat(scores: DataFrame, names: list[str]) -> list[list[float]]:
    """Score meat for pairs sharing a unit: incident sums minus sums over unordered pairs.

    Two aggregates replace the join of all pair pairs.
    """
    inc = scores.select(F.explode(F.array("pre", "post")).alias("unit"), *names).groupBy("unit").agg(*[F.sum(s).alias(s) for s in names])
    dyad = scores.groupBy(F.least("pre", "post").alias("lo"), F.greatest("pre", "post").alias("hi")).agg(*[F.sum(s).alias(s) for s in names])

    def outer(d):
        r = d.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
        return [[r[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))]

    a, b = outer(inc), outer(dyad)
    return [[a[i][j] - b[i][j] for j in range(len(names))] for i in range(len(names))]
