"""Exact quantiles against numpy, in ranges of few rows and many."""

import numpy as np
import pytest

from praxilog.functions import quantiles

SHARES = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("most", [50_000, 40, 3])
@pytest.mark.parametrize("kind", ["spread", "ties", "few", "one", "skewed"])
def test_quantiles_are_exact(spark, monkeypatch, most, kind):
    monkeypatch.setattr(quantiles, "MOST", most)
    r = np.random.default_rng(3)
    values = {"spread": r.normal(size=5000), "ties": r.integers(0, 4, 3000).astype(float), "few": np.array([3.0, 1.0, 2.5]), "one": np.full(700, 7.0), "skewed": np.append(r.pareto(0.3, 2000), np.zeros(1000))}[kind]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 5, "x double").repartition(4)
    n, found, (total,) = quantiles.exact_quantiles(rows, "x", SHARES, quantiles.F.count("*"))
    assert n == len(values) and total == n + 5
    assert found == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-12)


def test_sketches_that_are_off_are_found_out(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 5)
    monkeypatch.setattr(quantiles, "SIDES", (1e-9, 1e-9, 1e-9))
    values = np.random.default_rng(1).normal(size=4000)
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert quantiles.exact_quantiles(rows, "x", [0.1, 0.5])[1] == pytest.approx(np.quantile(values, [0.1, 0.5]).tolist())


def test_nothing_has_no_quantiles(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "x int"), "x", [0.5]) == (0, [None], [])
