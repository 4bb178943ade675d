"""Exact and asymptotic tails for small aggregated tables (vectorized pandas UDFs)."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Workers receive these helpers by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _log_beta(a, b):
    g = np.vectorize(math.lgamma, otypes=[float])
    return g(a) + g(b) - g(a + b)


def reg_beta(a, b, x, rounds: int = 400):
    """Regularized incomplete beta by the Lentz continued fraction."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    z = np.clip(z, 0.0, 1.0)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1.0 - (p + q) * z / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if m % 8 == 0 and np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - _log_beta(p, q)) / p
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1.0 - out, out)


def beta_quantile(prob, a, b):
    lo = np.zeros_like(np.asarray(a, dtype=float))
    hi = np.ones_like(lo)
    for _ in range(54):
        mid = (lo + hi) / 2.0
        below = reg_beta(a, b, mid) < prob
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2.0


def binomial_bound(successes, trials, confidence: float, side: str):
    """One-sided exact bound; 0 or 1 at the edges."""
    k, n = np.asarray(successes, dtype=float), np.asarray(trials, dtype=float)
    alpha = 1.0 - confidence
    if side == "lower":
        edge = (k <= 0) | (n <= 0)
        a, b = np.where(edge, 1.0, k), np.where(edge, 1.0, n - k + 1.0)
        return np.where(edge, 0.0, beta_quantile(alpha, a, b))
    edge = (k >= n) | (n <= 0)
    a, b = np.where(edge, 1.0, k + 1.0), np.where(edge, 1.0, n - k)
    return np.where(edge, 1.0, beta_quantile(1.0 - alpha, a, b))


def bound_column(successes, trials, confidence: float, side: str):
    @F.pandas_udf(DoubleType())
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(binomial_bound(k.to_numpy(), n.to_numpy(), confidence, side))

    return bound(successes.cast("double"), trials.cast("double"))


@F.pandas_udf(DoubleType())
def binomial_upper_tail(k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= k) for X ~ Binomial(n, 1/2)."""
    kk, nn = k.to_numpy(dtype=float), n.to_numpy(dtype=float)
    edge = kk <= 0
    return pd.Series(np.where(edge, 1.0, reg_beta(np.where(edge, 1.0, kk), nn - kk + 1.0, 0.5)))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    tt, v = t.to_numpy(dtype=float), dof.to_numpy(dtype=float)
    return pd.Series(reg_beta(v / 2.0, 0.5, v / (v + tt * tt)))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def kolmogorov_tail(x: pd.Series) -> pd.Series:
    def tail(v: float) -> float:
        if v < 0.2:
            return 1.0
        return min(1.0, max(0.0, 2.0 * sum((-1) ** (j - 1) * math.exp(-2.0 * j * j * v * v) for j in range(1, 101))))

    return x.map(tail)
