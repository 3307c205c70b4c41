"""Replays of knowledge tracing against a plain fold, and their pages against the whole."""

import pytest
from pyspark.sql import functions as F

from praxilog.models import bkt, trace
from praxilog.operators import units

from .test_core import random_rows, table

GIVEN = {"s1": (0.4, 0.2, 0.1, 0.15, 0.05)}


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame([(s, *p) for s, p in GIVEN.items()], "skill string, " + ", ".join(f"{n} double" for n in bkt.NAMES))


def plain(rows, primary):
    """Chances and updates by event: each domain folded in order, predictions held through a unit."""
    own = sorted(units.units(rows).collect(), key=lambda r: (r.source_namespace, r.learner_id, r.domain, r.pos))
    known, held, out = {}, {}, {}
    for r in own:
        where = (r.learner_id, r.domain)
        if held.get(where, (None,))[0] != r.unit:
            held[where] = (r.unit, {k: v for k, v in known.items() if k[0] == where})
        tags = r.skills[:1] if primary else r.skills
        told, chances = [], []
        for tag in tags:
            p = GIVEN.get(tag, bkt.DEFAULTS)
            prior, before = known.get((where, tag), p[0]), held[where][1].get((where, tag), p[0])
            prediction, posterior, following = bkt.step(prior, r.correct, *p)
            told.append((tag, before, prior, prediction, posterior, following))
            chances.append(before * (1 - p[2]) + (1 - before) * p[3])
            known[where, tag] = following
        out[r.event_id] = (sum(chances) / len(chances) if chances else 0.5, sorted(told))
    return own, out


@pytest.mark.parametrize("primary", [True, False])
def test_trace_is_the_plain_fold(spark, model, primary):
    rows = table(spark, random_rows(5))
    own, want = plain(rows, primary)
    got = trace.trace(rows, model, primary=primary).collect()
    sizes = {}
    for r in own:
        sizes[r.learner_id, r.domain, r.unit] = sizes.get((r.learner_id, r.domain, r.unit), 0) + 1
    assert len(got) == len(own) == len(want)
    for r in got:
        chance, told = want[r.event_id]
        assert r.probability == pytest.approx(chance, abs=1e-12) and r.unit_size == sizes[r.learner_id, r.domain, r.unit]
        assert [u[0] for u in r.updates] == [t[0] for t in told]
        for u, t in zip(r.updates, told, strict=True):
            assert list(u)[1:] == pytest.approx(t[1:], abs=1e-12)
    same = bkt.predict(rows, model, 0.5, primary).join(trace.trace(rows, model, primary=primary).select("event_id", F.col("probability").alias("again")), "event_id")
    assert same.where("abs(probability - again) > 1e-12").count() == 0


@pytest.mark.parametrize("primary", [True, False])
def test_pages_are_slices_of_the_whole(spark, model, tmp_path, primary):
    rows = table(spark, random_rows(6))
    folder = str(tmp_path / "replay")
    trace.save(rows, model, folder, every=3, primary=primary)
    key = lambda r: (r.event_id, r.unit, r.pos, r.unit_size, round(r.probability, 10), [(u.skill, *(round(x, 10) for x in list(u)[1:])) for u in r.updates])
    whole = [key(r) for r in trace.trace(rows.where("learner_id = 'u1'"), model, primary=primary).orderBy("source_namespace", "domain", "pos").collect()]
    for offset, limit in [(0, 1), (0, 500), (7, 5), (len(whole) // 2, 11), (len(whole) - 2, 10), (len(whole), 5)]:
        got = trace.page(spark, folder, "u1", offset, limit, primary=primary).collect()
        assert [key(r) for r in got] == whole[offset : offset + limit]
        assert [r.place for r in got] == list(range(offset, min(offset + limit, len(whole))))
    assert trace.page(spark, folder, "nobody").count() == 0


def test_a_late_page_reads_few_stretches(spark, model, tmp_path):
    rows = table(spark, [{"learner_id": "u1", "skills": ["s1"], "question_id": "q", "correct": i % 3 > 0, "session_id": None, "timestamp": i, "order_scope": "learner"} for i in range(400)])
    folder = str(tmp_path / "replay")
    trace.save(rows, model, folder, every=10)
    assert [r.stretch for r in trace.touched(spark, folder, "u1", 375, 20).orderBy("stretch").collect()] == [37, 38, 39]


def test_bounds_and_no_attempts(spark, model, tmp_path):
    rows = table(spark, random_rows(7)).limit(0)
    assert trace.trace(rows, model).count() == 0
    folder = str(tmp_path / "replay")
    trace.save(rows, model, folder)
    assert trace.page(spark, folder, "u1").count() == 0
    for offset, limit in [(-1, 5), (0, 0), (0, 501)]:
        with pytest.raises(ValueError):
            trace.page(spark, folder, "u1", offset, limit)
    with pytest.raises(ValueError):
        trace.placed(rows, 0)
