"""Tail probabilities that Spark lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(z: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers >= 0, to double precision: the series of
    the error function below 2, its continued fraction above, on whole arrays."""
    z = np.asarray(z, dtype=np.float64)
    out = np.full(z.shape, np.nan)
    low, high = z < 2, z >= 2
    x = z[low]
    term, total = x.copy(), x.copy()
    for n in range(1, 60):
        term = term * 2 * x * x / (2 * n + 1)
        total = total + term
    out[low] = 1 - 2 / math.sqrt(math.pi) * np.exp(-x * x) * total
    x = z[high]
    tail = np.zeros_like(x)
    for k in range(120, 0, -1):
        tail = k / 2 / (x + tail)
    out[high] = np.exp(-x * x) / math.sqrt(math.pi) / (x + tail)
    return out


def chi2_p(chi2: Column) -> Column:
    """P of a chi-squared value with one degree of freedom."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(erfc(np.sqrt(np.maximum(x.to_numpy(dtype=np.float64, na_value=np.nan), 0.0) / 2))).where(x.notna().to_numpy(), None)

    return tail(chi2)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided P of a correlation by Student's t with n-2 degrees of freedom."""
    if n < 3 or r != r:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))
