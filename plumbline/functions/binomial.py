"""Exact binomial intervals and split-conformal levels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _log_beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if _log_beta_cdf(mid, a, b) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15:
            break
    return (lo + hi) / 2


def clopper_pearson_bounds(k: int, n: int, ci: float = 0.95) -> tuple[float, float]:
    """Exact interval for k successes in n trials; (0, 1) without trials."""
    if n <= 0:
        return 0.0, 1.0
    tail = (1 - ci) / 2
    return (0.0 if k <= 0 else _beta_quantile(tail, k, n - k + 1)), (1.0 if k >= n else _beta_quantile(1 - tail, k + 1, n - k))


def clopper_pearson(k: Column, n: Column, ci: float = 0.95) -> Column:
    """STRUCT<lo, hi> by an Arrow function over groups' counts (a row a group, never a row an item)."""

    @F.pandas_udf("lo double, hi double")
    def bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        pairs = [clopper_pearson_bounds(int(a), int(b), ci) for a, b in zip(k, n, strict=True)]
        return pd.DataFrame(np.array(pairs, float).reshape(-1, 2), columns=["lo", "hi"])

    return bounds(k, n)


def conformal_level(n: Column, level: float) -> Column:
    """ceil((n + 1) level) / n, or infinity without units."""
    return F.when(n > 0, F.ceil((n + 1) * level - 1e-9) / n).otherwise(F.lit(float("inf")))
