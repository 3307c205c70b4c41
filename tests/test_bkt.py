"""The knowledge-tracing fit: its gradient, its passes, and what it finds."""

import numpy as np
import pytest

from praxilog.models import bkt

from .test_core import table

HIGH = np.array(bkt.UPPER)


def drawn(r, shape=()):
    low = np.array(bkt.LOWER)
    return low + (HIGH - low) * r.uniform(0.1, 0.9, (*shape, 5))


def sequence(r, n, p):
    """Answers of one learner under parameters; every third attempt or so belongs to the unit before."""
    known, hits = r.random() < p[0], []
    for _ in range(n):
        hits.append(bool(r.random() < (1 - p[2] if known else p[3])))
        known = r.random() >= p[4] if known else r.random() < p[1]
    return hits, np.append(True, r.random(n - 1) < 0.7)


def plain(hits, fresh, p):
    known, out = p[0], 0.0
    held = known
    for hit, opens in zip(hits, fresh, strict=True):
        held = known if opens else held
        q = held * (1 - p[2]) + (1 - held) * p[3]
        out += np.log(q if hit else 1 - q)
        known = bkt.step(known, hit, *p)[2]
    return out


@pytest.fixture(scope="module")
def own():
    r = np.random.default_rng(1)
    return [sequence(r, int(n), drawn(r)) for n in r.integers(1, 40, 30)]


def test_values_are_those_of_a_plain_fold(own):
    points = drawn(np.random.default_rng(2), (30, 2))
    ll, _ = bkt.folded([np.array(h) for h, _ in own], [f for _, f in own], points)
    assert np.allclose(ll, [[plain(*own[i], points[i, k]) for k in range(2)] for i in range(30)], atol=1e-10)


@pytest.mark.parametrize("j", range(5))
def test_gradients_are_finite_differences(own, j):
    points = drawn(np.random.default_rng(3), (30, 3))
    h, f = [np.array(h) for h, _ in own], [f for _, f in own]
    shift = np.zeros(5)
    shift[j] = 1e-6
    difference = (bkt.folded(h, f, points + shift)[0] - bkt.folded(h, f, points - shift)[0]) / 2e-6
    assert np.allclose(bkt.folded(h, f, points)[1][..., j], difference, rtol=1e-5, atol=1e-5)


def attempts(spark, skills):
    rows = []
    for name, own in skills.items():
        for k, (hits, fresh) in enumerate(own):
            units = np.cumsum(fresh)
            rows += [{"learner_id": f"{name}-{k}", "question_id": f"q{i}", "skills": [name, "other"], "correct": bool(h), "session_id": f"{name}{k}u{u}"} for i, (h, u) in enumerate(zip(hits, units, strict=True))]
    return table(spark, rows)


@pytest.fixture(scope="module")
def ten():
    """Ten skills of sequences of their own, one by far the largest, and one of too few attempts."""
    r = np.random.default_rng(5)
    out = {f"s{k}": [sequence(r, int(n), p) for n in r.integers(1, 25, 400 if k == 9 else 20)] for k, p in enumerate(drawn(r, (10,)))}
    return out | {"few": [sequence(r, 20, drawn(r))]}


@pytest.fixture(scope="module")
def data(spark, ten):
    return attempts(spark, ten).cache()


def total(own, points):
    """Summed log-likelihoods of sequences at each of the points."""
    return bkt.folded([np.array(h) for h, _ in own], [f for _, f in own], np.broadcast_to(points, (len(own), *points.shape)))[0].sum(axis=0)


def searched(own, forgetting, seed):
    """The best of 125 candidates: 60 at random and, four times, 16 about the best so far."""
    r, low, high = np.random.default_rng(seed), np.array(bkt.LOWER), HIGH * [1, 1, 1, 1, forgetting]
    best = np.array(bkt.DEFAULTS)
    for turn in range(5):
        spread = low + (high - low) * r.random((60, 5)) if not turn else best + (high - low) * 0.5 ** (turn + 1) * r.uniform(-0.5, 0.5, (16, 5))
        points = np.clip(np.concatenate([[best], spread]), np.minimum(low, high), high)
        best = points[total(own, points).argmax()]
    return total(own, best[None])[0]


@pytest.mark.parametrize("forgetting", [True])
def test_fits_are_at_least_as_good_as_a_search(spark, ten, data, forgetting):
    found = {r["skill"]: r for r in bkt.fit(spark, data, forgetting).collect()}
    assert set(found) == set(ten) and not found["few"]["fitted"] and found["few"]["initial"] == 0.2
    for k in range(10):
        r, own = found[f"s{k}"], ten[f"s{k}"]
        x = np.array([[r[n] for n in bkt.NAMES]])
        assert r["fitted"] and r["converged"] and r["passes"] < 60 and r["n"] == sum(len(h) for h, _ in own)
        assert abs(total(own, x)[0] - r["log_score"]) < 1e-6
        assert r["log_score"] >= searched(own, forgetting, k) - 1e-6
        assert forgetting or r["forgetting"] == 0


def test_planted_parameters_are_found(spark):
    r, planted = np.random.default_rng(8), (0.35, 0.15, 0.08, 0.22, 0.0)
    own = {"s": [sequence(r, 30, planted) for _ in range(400)]}
    found = bkt.fit(spark, attempts(spark, own)).first()
    assert np.allclose([found[n] for n in bkt.NAMES], planted, atol=0.05)


def test_joined_searches_and_the_columnar_fold_give_the_same(spark, data):
    seqs = bkt.fit_sequences(data)
    sizes = seqs.groupBy("skill").agg(bkt.F.sum(bkt.F.size("hits")).alias("n"))
    searches = bkt.begun(sizes, 2, True, 4).select("skill", "start", "points")
    key = lambda few: {(r["skill"], r["start"]): r["sums"] for r in bkt.evaluated(seqs, searches, few).collect()}
    few, many = key(True), key(False)
    assert few.keys() == many.keys() and all(np.allclose(few[k], many[k]) for k in few)
    columns = [bkt.F.col("points")[0][j].alias(n) for j, n in enumerate(bkt.NAMES)]
    plain = bkt.likelihoods(bkt.sequences(data), searches.select("skill", bkt.F.col("start").alias("candidate"), *columns)).collect()
    assert all(abs(few[r["skill"], r["candidate"]][0] - r["ll"]) < 1e-6 for r in plain)


def test_no_attempts_and_none_with_skills(spark, data):
    assert bkt.fit(spark, data.limit(0)).count() == 0
    assert bkt.fit(spark, table(spark, [{"skills": []}] * 3)).count() == 0
    with pytest.raises(ValueError, match="places"):
        bkt.fit(spark, data, starts=0)
