"""Scalar expressions used by the measurement operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def negative_log10(p: Column) -> Column:
    """300 at zero, 0 for missing, negative or non-finite values."""
    finite = p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf"))
    return F.when(~finite, 0.0).when(p == 0, 300.0).otherwise(-F.log10(F.greatest(p, F.lit(1e-300))))


def circular_similarity(a: Column, b: Column, period: float) -> Column:
    raw = F.pmod(F.abs(a - b), F.lit(period))
    return 1.0 - F.least(raw, F.lit(period) - raw) / (period / 2.0)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """Deviation from the mean; a flat column keeps its centred values."""
    return (x - mean) / F.when(std == 0, 1.0).otherwise(std)


def stable_level(x: Column) -> Column:
    return F.round(x, 12)


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    n = total.cast("double")
    p = successes / n
    denom = 1.0 + Z95 * Z95 / n
    centre = (p + Z95 * Z95 / (2.0 * n)) / denom
    radius = Z95 * F.sqrt(p * (1.0 - p) / n + Z95 * Z95 / (4.0 * n * n)) / denom
    none = total <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - radius)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + radius))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete rows; null when a side is flat or nothing is complete.

    Written from covariance and deviations because the built-in aggregate raises on a
    flat side under strict arithmetic.
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; zero when a side is flat or pairs are missing."""
    return F.coalesce(F.nanvl(corr(x, y), F.lit(0.0)), F.lit(0.0))


def log_choose(n: Column, k: Column) -> Column:
    """log of the binomial coefficient by a sum of logs; n is a small count."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), k.cast("int")))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.log((n - k + i) / i.cast("double")))
    return F.when(k <= 0, 0.0).otherwise(total)


def modified_kappa(cvi: Column, agreeing: Column, raters: Column) -> Column:
    chance = F.exp(log_choose(raters, agreeing) + raters * F.log(F.lit(0.5)))
    return F.when(chance < 1.0, (cvi - chance) / (1.0 - chance)).otherwise(0.0)


def truthy(c: Column) -> Column:
    """true/1 and false/0 texts, null otherwise."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def parse_vector(c: Column) -> Column:
    """Numbers of a bracketed text such as ``[1 2.5 3]``."""
    body = F.trim(F.regexp_replace(c, r"[\[\],]", " "))
    return F.transform(F.split(body, r"\s+"), lambda x: x.try_cast("double"))


def split_role(seed: Column) -> Column:
    r = F.pmod(seed, F.lit(5))
    return F.when(r.isin(0, 1, 2), "model_fit").when(r == 3, "threshold_calibration").otherwise("locked_development_audit")


def mouse_key(c: Column) -> Column:
    """Subject key inside a longer name, or the name itself."""
    found = F.regexp_extract(c, r"dynamic\d+", 0)
    return F.when(found != "", found).otherwise(c)
