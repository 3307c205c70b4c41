"""Item-response fits against a plain ascent of the same objective."""

import numpy as np
import pytest

from praxilog.models import irt

P = 0.1


@pytest.fixture(scope="module")
def answers():
    r = np.random.default_rng(6)
    ability, difficulty, steep = r.normal(size=14), r.normal(size=9) + 0.7, r.uniform(0.6, 1.8, 9)
    n = r.integers(0, 5, (14, 9))
    return n, r.binomial(n, 1 / (1 + np.exp(-steep * (ability[:, None] - difficulty))))


def value(n, s, a, d, c):
    z = c * (a[:, None] - d)
    return (s * z - n * np.logaddexp(0, z)).sum() - P / 2 * ((a**2).sum() + (d**2).sum() + ((c - 1) ** 2).sum())


def ascended(n, s):
    """Newton steps of the whole objective at once, by finite differences of its gradient."""

    def slope(x):
        a, d, c = x[:14], x[14:23], x[23:]
        left = s - n / (1 + np.exp(-c * (a[:, None] - d)))
        g = np.concatenate([(c * left).sum(1) - P * a, -(c * left).sum(0) - P * d, ((a[:, None] - d) * left).sum(0) - P * (c - 1)])
        g[23:] = 0
        return g

    x, size = np.concatenate([np.zeros(23), np.ones(9)]), 23
    for _ in range(60):
        g = slope(x)
        curve = np.array([(slope(x + 1e-5 * e) - slope(x - 1e-5 * e))[:size] / 2e-5 for e in np.eye(32)[:size]])
        way = np.zeros(32)
        way[:size] = np.linalg.solve(curve - 1e-3 * np.eye(size), -g[:size])
        t = 1.0
        while t > 1e-6 and value(n, s, *np.split(x + t * way, [14, 23])) < value(n, s, *np.split(x, [14, 23])):
            t /= 2
        x = x + t * way
    assert np.abs(slope(x)).max() < 1e-6
    return np.split(x, [14, 23])


@pytest.mark.parametrize("parameters", [1, 2])
def test_fits_are_where_the_objective_is_largest(spark, answers, parameters):
    n, s = answers
    rows = spark.createDataFrame([("t", f"u{i:02d}", f"q{j}", int(n[i, j]), int(s[i, j])) for i in range(14) for j in range(9) if n[i, j]], "source_namespace string, learner_id string, question_id string, n long, s long")
    learners, items = (x.cache() for x in irt.fit(rows, parameters, rounds=30 if parameters == 1 else 10, tolerance=1e-9))
    got = np.array([r.ability for r in learners.orderBy("learner_id").collect()])
    its = np.array([(r.difficulty, r.discrimination) for r in items.orderBy("question_id").collect()])
    assert got.mean() == pytest.approx(0, abs=1e-9)
    assert irt.objective(rows, learners, items).first().value == pytest.approx(value(n, s, got, *its.T))
    if parameters == 1:
        a, d, _ = ascended(n, s)
        assert np.allclose(got, a - a.mean(), atol=1e-4) and np.allclose(its[:, 0], d - a.mean(), atol=1e-4)
        return
    # before it is centred: where the penalties of abilities and difficulties are least
    shift = -(got.sum() + its[:, 0].sum()) / 23
    x = np.concatenate([got + shift, its[:, 0] + shift, its[:, 1]])
    best = value(n, s, *np.split(x, [14, 23]))
    for k in range(32):
        for move in (-0.02, 0.02):
            moved = x + move * (np.arange(32) == k)
            if k < 23 or 0.25 <= moved[k] <= 3:
                assert value(n, s, *np.split(moved, [14, 23])) < best + 0.03


def test_nothing_fits_nothing(spark):
    rows = spark.createDataFrame([], "source_namespace string, learner_id string, question_id string, n long, s long")
    learners, items = irt.fit(rows)
    assert learners.count() == 0 and items.count() == 0
