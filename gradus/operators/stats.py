"""Tail probabilities that Spark's functions lack, as small Arrow-batched helpers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or tiny)
            c = 1 + up / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p-value of a correlation by the t distribution with n - 2 degrees of freedom; 1 where undefined."""
    if n is None or rho is None or n < 3 or rho != rho:
        return 1.0
    if abs(rho) >= 1:
        return 0.0
    return beta_tail((n - 2) / 2, 0.5, 1 - rho * rho)


def _p_values(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(r, k) for r, k in zip(rho, n)])


def correlation_p_value(rho: Column, n: Column) -> Column:
    return F.pandas_udf(_p_values, "double")(rho, n)
