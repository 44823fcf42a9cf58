"""Distribution functions on arrays, and as Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def beta_quantile(p, a, b) -> np.ndarray:
    """Inverse of ``betainc`` in x, by bisection to the last bit."""
    p, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (p, a, b)))
    lo, hi = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = betainc(a, b, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def t_survival(t, df) -> np.ndarray:
    """P(T > t) for Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, half, 1 - half)


def t_quantile(p, df) -> np.ndarray:
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    tail = np.minimum(p, 1 - p)
    x = beta_quantile(2 * tail, df / 2, 0.5)
    size = np.sqrt(df * (1 - x) / np.maximum(x, 1e-300))
    return np.where(p < 0.5, -size, size)


@F.pandas_udf(DoubleType())
def t_survival_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_survival(t.to_numpy(), df.to_numpy()))


@F.pandas_udf(DoubleType())
def t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_quantile(p.to_numpy(), df.to_numpy()))


@F.pandas_udf(DoubleType())
def beta_quantile_udf(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(p.to_numpy(), a.to_numpy(), b.to_numpy()))
