"""Quality rules with robust multivariate outlier rejection (DataFrame functions only).

Five counts per text and a base rule come first. The counts are transformed to a vector,
and per (lang, source) a minimum-covariance-determinant estimate gives a centre and a
covariance; texts far from the centre by Mahalanobis distance are rejected.

Defined results: a null text counts as the empty text (all counts 0, base rule failed);
null lang or source is a group of its own; repeated rows are judged each for itself and
alike; an empty table gives an empty result; columns of the input whose names clash with
the added ones are replaced. A group with under ``MIN_GROUP`` passing texts borrows the
estimate of its language, else of the whole table; with none at all every text that passes
the base rule is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.session import checkpoint_dir, cut

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of a group in the subset whose covariance determinant is made small.
SUBSET = 0.75
C_STEPS = 3
MIN_GROUP = 50
#: Rejected beyond this squared distance: six robust standard deviations.
CUT = 36.0
#: Least standard deviation of each transformed statistic; a subset of equal values has none.
FLOORS = {"x_len": 0.9, "x_word": 0.25, "x_symbol": 0.035, "x_line": 0.12, "x_repeat": 0.12, "x_caps": 0.08}
AXES = tuple(FLOORS)
#: Parameters of more groups than this are joined by shuffle, not broadcast.
BROADCAST_GROUPS = 50_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts, ``n_lines``, ``n_caps`` and ``base_failed``."""
    names = [c for c in docs.columns if c not in (*STATS, "n_lines", "n_caps", "base_failed")]
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*names, body.alias("_body"))
    df = df.select("*", F.array_remove(F.split("_body", r"[\x20\x09-\x0D]+"), "").alias("_words"))
    df = df.select("*", F.when(F.size("_words") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).alias("_keys"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_keys") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_keys"), i + d) for d in range(WINDOW)]),
    )
    df = df.select("*", F.when(F.col("_keys").isNotNull(), windows).alias("_hashes"))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select("*", F.when(F.coalesce(repeats, F.lit(False)), placed).alias("_placed"))

    def twice(x, j):
        """Equal hashes nominate a window; its words decide."""
        def equals(other):
            return (other["h"] == x["h"]) & (F.slice("_words", other["i"] + 1, WINDOW) == F.slice("_words", x["i"] + 1, WINDOW))

        placed = F.col("_placed")
        return F.coalesce(equals(F.get(placed, j - 1)), F.lit(False)) | F.coalesce(equals(F.get(placed, j + 1)), F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_placed", twice), lambda x: x["i"]))
    df = df.select("*", F.when(F.col("_placed").isNotNull(), starts).alias("_starts"))
    step = F.transform("_starts", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), j + 1) - i, F.lit(WINDOW))))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select("*", F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    df = df.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_body", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_body", r"[^A-Z]++", "")).cast("long").alias("n_caps"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def axes() -> dict[str, Column]:
    """The transformed statistics; the constants in the divisors keep short texts near zero."""
    return {
        "x_len": F.log1p(F.col("n_words").cast("double")),
        "x_word": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        "x_symbol": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 200.0)),
        "x_line": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10.0)),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50.0)),
        "x_caps": F.sqrt(F.col("n_caps") / (F.col("word_chars") + 50.0)),
    }


def _join(points: DataFrame, params: DataFrame, keys: list[str], groups: int) -> DataFrame:
    right = F.broadcast(params) if groups <= BROADCAST_GROUPS else params
    return points.join(right, keys, "inner")


def _moments(keys: list[str]):
    """Mean and covariance sums of the axes; small enough to combine before the shuffle."""
    outs = [F.count(F.lit(1)).alias("n")]
    outs += [F.avg(a).alias(f"m_{a}") for a in AXES]
    outs += [F.covar_pop(a, b).alias(f"s_{a}_{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    return outs


def _whitened(params: DataFrame, factor: float) -> DataFrame:
    """Add the Cholesky factor ``l_i_j`` of covariance * factor and its inverse ``w_i_j``.

    A diagonal entry never falls under its floor, so that directions without any spread
    in the subset stay usable. Each step is a projection of its own over one row per group,
    so no expression grows into a tree of all before it."""
    df = params
    for j, b in enumerate(AXES):
        def rest(i):
            s = F.col(f"s_{b}_{AXES[i]}") * factor
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            return s

        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest(j), F.lit(FLOORS[b] ** 2))))
        df = df.withColumns({f"l_{i}_{j}": rest(i) / F.col(f"l_{j}_{j}") for i in range(j + 1, len(AXES))})
    for i in range(len(AXES)):
        new = {f"w_{i}_{i}": 1.0 / F.col(f"l_{i}_{i}")}
        for j in range(i):
            total = F.lit(0.0)
            for k in range(j, i):
                total = total + F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
            new[f"w_{i}_{j}"] = -total / F.col(f"l_{i}_{i}")
        df = df.withColumns(new)
    return df


def _distance() -> Column:
    """Squared Mahalanobis distance: squares of the rows of the inverse factor times the offsets."""
    total = F.lit(0.0)
    for i in range(len(AXES)):
        y = F.lit(0.0)
        for k in range(i + 1):
            y = y + F.col(f"w_{i}_{k}") * (F.col(AXES[k]) - F.col(f"m_{AXES[k]}"))
        total = total + F.pow(y, F.lit(2.0))
    return total


def mcd(points: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and inverse Cholesky factor per group of ``points`` (columns ``keys`` and the axes).

    Starts from coordinate medians, then concentrates: keep the ``SUBSET`` nearest share of
    a group, take its mean and covariance, measure again. Quantiles come from mergeable
    sketches of bounded size, so no group is gathered anywhere."""
    medians = [F.percentile_approx(a, 0.5, 2000).alias(f"m_{a}") for a in AXES]
    start = points.groupBy(*keys).agg(*medians, F.count(F.lit(1)).alias("n"))
    diagonal = {f"w_{i}_{j}": F.lit(1.0 / FLOORS[a] if i == j else 0.0) for i, a in enumerate(AXES) for j in range(i + 1)}
    start = start.withColumns(diagonal)
    params = cut(start)
    groups = params.count()
    for _ in range(C_STEPS):
        near = _join(points, params, keys, groups).withColumn("_d", _distance()).select(*keys, *AXES, "_d")
        bound = near.groupBy(*keys).agg(F.percentile_approx("_d", SUBSET, 2000).alias("_h"))
        kept = _join(near, bound, keys, groups).where(F.col("_d") <= F.col("_h"))
        # The nearest three quarters understate the spread; 1.6 restores it for normal vectors of this size.
        params = cut(_whitened(kept.groupBy(*keys).agg(*_moments(keys)), 1.6))
    return params


def judge(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``distance`` and ``kept`` to rows that carry the statistics columns.

    ``stats`` is read several times, so pass a written or checkpointed table. Estimates for
    groups, languages and the whole table are made in one pass over three keys a row."""
    def part(c):
        return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))

    keys = {"_k2": F.concat(F.lit("2"), part(lang), F.lit("\n"), part(source)), "_k1": F.concat(F.lit("1"), part(lang)), "_k0": F.lit("0")}
    points = stats.where(~F.col("base_failed")).select(F.explode(F.array(*keys.values())).alias("_key"), *[c.alias(k) for k, c in axes().items()])
    names = ["n", *[f"m_{a}" for a in AXES], *[f"w_{i}_{j}" for i in range(len(AXES)) for j in range(i + 1)]]
    enough = F.when(F.col("_key") == "0", F.lit(1)).otherwise(F.lit(MIN_GROUP)) * SUBSET
    fitted = mcd(points, ["_key"]).where(F.col("n") >= enough).select("_key", F.struct(*names).alias("_p"))
    right = F.broadcast(fitted) if fitted.count() <= BROADCAST_GROUPS else fitted
    out = stats.withColumns(keys | axes())
    for k in keys:
        out = out.join(right.select(F.col("_key").alias(k), F.col("_p").alias(f"_p{k}")), k, "left")
    out = out.withColumn("_p", F.coalesce(*[F.col(f"_p{k}") for k in keys]))
    out = out.select(*stats.columns, *AXES, "_p.*").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return out.select(*stats.columns, "distance", kept.alias("kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``kept`` and ``distance`` of every document."""
    stats = cut(with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(stats).select("doc_id", *STATS, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns.

    The statistics are written beside the rows once; estimates read those columns alone."""
    table = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/quality-{uuid.uuid4().hex}"
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")  # its columns may have any names
    with_statistics(docs.select("lang", "source", "text", whole)).drop("text").write.parquet(table)
    return judge(docs.sparkSession.read.parquet(table)).where("kept").select("_row.*")
