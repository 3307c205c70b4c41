"""Quantiles of the Beta distribution, for posterior bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    log = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value, done = d.copy(), np.zeros(d.shape, bool)  # each value stops on its own, whatever it is worked out with
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            value = np.where(done, value, value * change)
        done |= np.abs(change - 1) < 1e-15
        if done.all():
            break
    out = np.where(x <= 0, 0.0, front * value)
    return np.where(flip, 1 - out, out)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The value below which a share ``q`` of Beta(a, b) lies, by bisection."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


@F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
def beta_bounds(successes: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Equal-tailed 95 % bounds of a rate after a uniform prior."""
    a, b = successes.fillna(0).to_numpy(float) + 1, (n.fillna(0) - successes.fillna(0)).to_numpy(float) + 1
    return pd.DataFrame({"lower": beta_quantile(0.025, a, b), "upper": beta_quantile(0.975, a, b)})
