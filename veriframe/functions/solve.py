"""Small dense solves on aggregated moment rows (at most a few columns each)."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def solve_normal(gram, cross, ridge=0.0, skip=1):
    """Coefficients of penalized normal equations; the first ``skip`` columns carry no penalty."""
    g = np.asarray(gram, dtype=float)
    d = np.diag([0.0 if i < skip else ridge for i in range(len(g))])
    return np.linalg.solve(g + d, np.asarray(cross, dtype=float))


def poly_fit(moments, cross, degree):
    """Least-squares polynomial from power sums ``sum x^0..x^2d`` and ``sum y x^0..x^d``."""
    k = degree + 1
    gram = [[moments[i + j] for j in range(k)] for i in range(k)]
    coef, *_ = np.linalg.lstsq(np.asarray(gram, float), np.asarray(cross[:k], float), rcond=None)
    return coef


def poly_error(moments, cross, yy, n, degree):
    """Mean squared residual of the fit, from the same sums."""
    c = poly_fit(moments, cross, degree)
    k = degree + 1
    fit = sum(c[i] * c[j] * moments[i + j] for i in range(k) for j in range(k))
    return max(0.0, (yy - 2.0 * sum(c[i] * cross[i] for i in range(k)) + fit) / n)
