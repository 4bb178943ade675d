"""Ridge, residual-calibrated ridge, random features, logistic and isotonic scores on tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.hashing import hash_unit
from veriframe.operators.ranking import hash_rank


def moment_sums(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Sums needed by a linear fit, one row per group; rows combine map-side."""
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    return df.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"),
        F.array(*[F.sum(x) for x in xs]).alias("sx"), F.array(*[F.sum(F.col(x) * F.col(y)) for x in xs]).alias("sxy"),
        F.array(*[F.sum(F.col(xs[i]) * F.col(xs[j])) for i, j in pairs]).alias("sxx"))


def solve_ridge(n, sy, sx, sxy, sxx, alpha):
    """Ridge on standardized columns with a free intercept, returned in raw units."""
    k = len(sx)
    sx, sxy = np.asarray(sx, float), np.asarray(sxy, float)
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = sxx
    full = full + np.triu(full, 1).T
    mu, my = sx / n, sy / n
    cov = full - n * np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
    sd[sd < 1e-12] = 1.0
    beta = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(k), (sxy - n * mu * my) / sd) / sd
    return float(my - mu @ beta), beta


def ridge_fit(df: DataFrame, by: list[str], xs: list[str], y: str, alpha: float) -> DataFrame:
    """Coefficients per group, solved on the moment rows inside tasks."""
    sums = moment_sums(df, by, xs, y)
    solver = solve_ridge
    keys = list(by)

    def fit(batches):
        for pdf in batches:
            out = [solver(r["n"], r["sy"], r["sx"], r["sxy"], r["sxx"], alpha) for _, r in pdf.iterrows()]
            res = pdf[keys].copy()
            res["intercept"] = [o[0] for o in out]
            res["coef"] = [list(map(float, o[1])) for o in out]
            yield res

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in keys)
    return sums.mapInPandas(fit, f"{schema}, intercept double, coef array<double>")


def linear(xs: list[str]) -> Column:
    return F.col("intercept") + sum((F.col("coef")[i] * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))


def residual_ridge_cv(train: DataFrame, key: Column, xs: list[str], y: str, alphas: tuple[float, ...], betas: list[float], folds: int = 5) -> dict:
    """Best (alpha, beta) of ``mean + beta * residual ridge`` by pooled held-out correlation.

    Fold moments give every held-out fit by subtraction, and the sums of a fit's predictions over a fold
    follow from the same moments, so the correlation for any beta too: one pass in all.
    """
    d = hash_rank(train, [], key, "folds").withColumn("fold", (F.col("rn") - 1) % folds).drop("rn", "n")
    rows = {r["fold"]: r for r in moment_sums(d, ["fold"], xs, y).collect()}  # one small row per fold
    add = lambda name: sum(np.asarray(r[name], float) for r in rows.values())
    total = {name: add(name) for name in ("n", "sy", "sx", "sxy", "sxx")}
    means, sums = {}, {}
    upper = np.triu_indices(len(xs))
    for f, r in rows.items():
        part = {name: total[name] - np.asarray(r[name], float) for name in total}
        means[f] = float(part["sy"] / part["n"])
        sx, sxy, sxx = np.asarray(r["sx"], float), np.asarray(r["sxy"], float), np.zeros((len(xs), len(xs)))
        sxx[upper] = r["sxx"]
        sxx = sxx + np.triu(sxx, 1).T
        own = {"fold": f, "n": r["n"], "sy": r["sy"], "syy": r["syy"]}
        for i, a in enumerate(alphas):
            b0, b = solve_ridge(float(part["n"]), float(part["sy"]), part["sx"], part["sxy"], part["sxx"], a)
            c = b0 - means[f]
            own |= {f"sp{i}": r["n"] * c + b @ sx, f"spp{i}": r["n"] * c * c + 2 * c * (b @ sx) + b @ sxx @ b, f"spy{i}": c * r["sy"] + b @ sxy}
        sums[f] = own
    best = (-2.0, None, None)
    for i, a in enumerate(alphas):
        for b in betas:
            n = sy = syy = sq = sqq = sqy = 0.0
            for r in sums.values():
                m = means[r["fold"]]
                n += r["n"]
                sy += r["sy"]
                syy += r["syy"]
                sq += r["n"] * m + b * r[f"sp{i}"]
                sqq += r["n"] * m * m + 2 * m * b * r[f"sp{i}"] + b * b * r[f"spp{i}"]
                sqy += m * r["sy"] + b * r[f"spy{i}"]
            v = (n * sqq - sq * sq) * (n * syy - sy * sy)
            c = (n * sqy - sq * sy) / math.sqrt(v) if v > 1e-12 else 0.0
            if c > best[0]:
                best = (c, a, b)
    b0, coef = solve_ridge(float(total["n"]), float(total["sy"]), total["sx"], total["sxy"], total["sxx"], best[1])
    mean = float(total["sy"] / total["n"])
    return {"score": best[0], "alpha": best[1], "beta": best[2], "mean": mean, "intercept": b0, "coef": [float(v) for v in coef]}


def residual_prediction(model: dict, xs: list[str]) -> Column:
    lin = F.lit(model["intercept"] - model["mean"]) + sum((F.lit(v) * F.col(x) for v, x in zip(model["coef"], xs, strict=True)), F.lit(0.0))
    return F.lit(model["mean"]) + F.lit(float(model["beta"])) * lin


def random_features(df: DataFrame, xs: list[str], width: int, seed: str) -> tuple[DataFrame, list[str]]:
    """Cosine features whose weights are normal draws derived from hashes on the driver."""
    rows = df.sparkSession.range(width * (len(xs) + 1)).select("id", hash_unit(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))).alias("u"),
                                                               hash_unit(F.concat_ws(":", F.lit(seed + "b"), F.col("id").cast("string"))).alias("v")).orderBy("id").collect()
    draws = [math.sqrt(-2 * math.log(max(r["u"], 1e-12))) * math.cos(2 * math.pi * r["v"]) for r in rows]
    names, cols = [], []
    for j in range(width):
        w = draws[j * len(xs): (j + 1) * len(xs)]
        phase = 2 * math.pi * rows[width * len(xs) + j]["u"]
        names.append(f"rf{j}")
        cols.append((math.sqrt(2.0 / width) * F.cos(sum((F.lit(a) * F.col(x) for a, x in zip(w, xs, strict=True)), F.lit(phase)))).alias(f"rf{j}"))
    return df.select("*", *cols), names


ADAPTERS = {}


def adapter(name: str):
    """Registry of named model adapters; an unknown name is an error at lookup."""

    def register(fn):
        ADAPTERS[name] = fn
        return fn

    return register


def get_adapter(name: str):
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter {name}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[name]


@adapter("mean")
def mean_adapter(train: DataFrame, xs: list[str], y: str) -> tuple[DataFrame, Column, list[str]]:
    m = train.agg(F.avg(y).alias("m")).first()["m"]
    return train, F.lit(float(m)), xs


@adapter("ridge")
def ridge_adapter(train: DataFrame, xs: list[str], y: str):
    r = moment_sums(train, [], xs, y).first()
    b0, b = solve_ridge(r["n"], r["sy"], r["sx"], r["sxy"], r["sxx"], 10.0)
    return train, F.lit(b0) + sum((F.lit(float(v)) * F.col(x) for v, x in zip(b, xs, strict=True)), F.lit(0.0)), xs


def fit_logistic(train: DataFrame, xs: list[str], label: str, c: float = 1.0, weight: str | None = None):
    """L2 logistic scores on standardized columns; a constant label gives a constant score."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    s = train.agg(F.avg(F.col(label).cast("double")).alias("m"), F.count("*").alias("n")).first()
    if s["m"] in (0.0, 1.0):
        constant = float(s["m"])
        return lambda df: df.withColumn("p", F.lit(constant))
    lr = LogisticRegression(featuresCol="z", labelCol="_y", regParam=1.0 / (c * s["n"]), standardization=False, maxIter=100)
    if weight:
        lr = lr.setWeightCol(weight)
    model = Pipeline(stages=[VectorAssembler(inputCols=xs, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="z", withMean=True, withStd=True), lr]).fit(
        train.withColumn("_y", F.col(label).cast("double")))

    def score(df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = model.transform(df)
        return out.withColumn("p", vector_to_array("probability")[1]).drop("_v", "z", "rawPrediction", "probability", "prediction")

    return score


def fit_isotonic(train: DataFrame, score: str, label: str):
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol="_s", labelCol="_y").fit(train.select(F.col(score).alias("_s"), F.col(label).cast("double").alias("_y")))
    return lambda df: model.setFeaturesCol("_s").setPredictionCol("calibrated").transform(df.withColumn("_s", F.col(score))).drop("_s")


def grouped_logistic(rows: DataFrame, by: list[str], xs: list[str], y: str, c: float = 1.0, rounds: int = 8) -> DataFrame:
    """One L2 logistic fit per group by Newton steps on aggregated gradients.

    Rows of a group are only summed, never gathered, so a group of any size is spread
    over tasks; each step moves one short row per group and is written to the
    checkpoint folder.  Returns ``by.., mu, sd, coef`` (intercept first, standardized).
    """
    from veriframe.session import cut

    k = len(xs) + 1
    st = rows.groupBy(*by).agg(F.array(*[F.avg(x) for x in xs]).alias("mu"), F.array(*[F.stddev_pop(x) for x in xs]).alias("sd"))
    st = cut(st.withColumn("sd", F.transform("sd", lambda s: F.when(s == 0, 1.0).otherwise(s))))
    z = [F.lit(1.0)] + [(F.col(x) - F.col("mu")[i]) / F.col("sd")[i] for i, x in enumerate(xs)]
    data = cut(rows.join(st, by).select(*by, F.col(y).cast("double").alias("_y"), *[v.alias(f"z{i}") for i, v in enumerate(z)]))
    coef = st.select(*by, F.array(*[F.lit(0.0)] * k).alias("coef"))
    keys = list(by)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in st.schema.fields if f.name in keys) + ", coef array<double>"

    def step(batches):
        for pdf in batches:
            out = []
            for w, g, h in zip(pdf["coef"], pdf["_g"], pdf["_h"], strict=True):
                w = np.asarray(w, float)
                full = np.zeros((k, k))
                full[np.triu_indices(k)] = np.asarray(h, float)
                full = full + np.triu(full, 1).T
                reg = np.diag([0.0] + [1.0 / c] * (k - 1))
                out.append(list(map(float, w - np.linalg.solve(full + reg + 1e-9 * np.eye(k), np.asarray(g, float) + reg @ w))))
            res = pdf[keys].copy()
            res["coef"] = out
            yield res

    zs = [F.col(f"z{i}") for i in range(k)]
    for _ in range(rounds):
        d = data.join(coef, by)
        eta = sum((F.col("coef")[i] * zs[i] for i in range(1, k)), F.col("coef")[0] * zs[0])
        d = d.withColumn("_p", 1.0 / (1.0 + F.exp(-eta)))
        w = F.col("_p") * (1.0 - F.col("_p"))
        sums = d.groupBy(*by).agg(
            F.array(*[F.sum((F.col("_p") - F.col("_y")) * v) for v in zs]).alias("_g"),
            F.array(*[F.sum(w * zs[i] * zs[j]) for i in range(k) for j in range(i, k)]).alias("_h"))
        coef = cut(sums.join(coef, by).mapInPandas(step, schema))
    return st.join(coef, by)


def logistic_score(xs: list[str]) -> Column:
    """Probability from columns ``mu, sd, coef`` joined to the scored rows."""
    eta = sum((F.col("coef")[i + 1] * (F.col(x) - F.col("mu")[i]) / F.col("sd")[i] for i, x in enumerate(xs)), F.col("coef")[0])
    return 1.0 / (1.0 + F.exp(-eta))


def _by_value():
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_by_value()
