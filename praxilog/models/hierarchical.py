"""Beta-binomial rates of groups, with the prior fitted to all groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, HIGH = -5.0, 8.0
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def group_counts(train: DataFrame, *keys: str) -> DataFrame:
    return train.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("s"))


def fit_prior(counts: DataFrame, penalty: float = 0.01) -> tuple[float, float]:
    """The prior's two parameters by marginal likelihood with a small penalty on their logarithms.

    Spark counts how many groups have each (n, s), which is all that the likelihood needs;
    fewer than three groups keep a uniform prior. A shrinking grid finds the best logarithms.
    """
    table = counts.groupBy("n", "s").agg(F.count("*").alias("groups")).collect()
    if sum(r["groups"] for r in table) < 3:
        return 1.0, 1.0
    n, s, w = (np.array([r[k] for r in table], float) for k in ("n", "s", "groups"))

    def value(x: float, y: float) -> float:
        a, b = math.exp(x), math.exp(y)
        each = _lgamma(s + a) + _lgamma(n - s + b) - _lgamma(n + a + b)
        base = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        return float(w @ each + w.sum() * base - penalty * (x * x + y * y))

    x, y, step = 0.0, 0.0, 2.0
    best = value(x, y)
    while step > 1e-5:
        around = [(x + i * step, y + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1) if LOW <= x + i * step <= HIGH and LOW <= y + j * step <= HIGH]
        found = max(((value(*p), p) for p in around), key=lambda v: v[0])
        if found[0] > best + 1e-12:
            best, (x, y) = found
        else:
            step /= 2
    return math.exp(x), math.exp(y)


def posteriors(counts: DataFrame, alpha: float, beta: float) -> DataFrame:
    return counts.withColumn("mean", (F.col("s") + alpha) / (F.col("n") + alpha + beta))


def predict(train: DataFrame, test: DataFrame, *keys: str, shrinkage: bool = True) -> DataFrame:
    """Posterior mean of each group; groups that train lacks have the prior's. Without ``shrinkage`` the prior is uniform."""
    counts = group_counts(train, *keys)
    a, b = fit_prior(counts) if shrinkage else (1.0, 1.0)
    return test.join(posteriors(counts, a, b).select(*keys, F.col("mean").alias("probability")), list(keys), "left").withColumn("probability", F.coalesce("probability", F.lit(a / (a + b))))
