"""Features that go on from a snapshot against those of the whole."""

import random

import pytest

from praxilog.operators import snapshots, units

from .test_core import random_rows, table


def parts(rows, cuts):
    """Attempts by unit: those of each domain up to its cut, and the rest."""
    own = units.units(rows).select(*rows.columns, "unit", "domain")
    pick = lambda low, high: own.where(f"unit > {low} and unit <= {high}").select(*rows.columns)
    return [pick(a, b) for a, b in zip([0, *cuts], [*cuts, 10_000])]  # noqa: B905


def key(frame):
    return sorted(map(str, (r.asDict(recursive=True) for r in frame.collect())))


@pytest.mark.parametrize("seed", range(3))
def test_restored_features_are_those_of_the_whole(spark, seed):
    rows = table(spark, random_rows(seed))
    first, then, last = parts(rows, sorted(random.Random(seed).sample(range(1, 30), 2)))
    state = snapshots.snapshot(first)
    both = snapshots.merged(state, snapshots.snapshot(then))
    got = units.features(first).unionByName(snapshots.restored(state, then)).unionByName(snapshots.restored(both, last))
    assert key(got) == key(units.features(rows).select(*got.columns))
    got = units.skill_features(first).unionByName(snapshots.restored_skills(state, then)).unionByName(snapshots.restored_skills(both, last))
    assert key(got) == key(units.skill_features(rows))
    assert not snapshots.misplaced(both, last).count() and not snapshots.misplaced(state, then).count()


def test_merging_is_associative_and_equals_the_whole(spark):
    rows = table(spark, random_rows(8))
    a, b, c = map(snapshots.snapshot, parts(rows, [4, 15]))
    whole = snapshots.snapshot(rows)
    for found in (snapshots.merged(snapshots.merged(a, b), c), snapshots.merged(a, snapshots.merged(b, c))):
        for name in ("learners", "items", "skills", "sessions"):
            assert key(getattr(found, name).select(*getattr(whole, name).columns)) == key(getattr(whole, name))


def test_few_recent_outcomes_are_filled_from_the_snapshot(spark):
    rows = table(spark, [{"correct": k % 3 == 0} for k in range(17)])
    for cut in (1, 4, 12):
        first, then = rows.where(f"source_sequence < {cut}"), rows.where(f"source_sequence >= {cut}")
        got = snapshots.restored(snapshots.snapshot(first), then)
        assert key(got) == key(units.features(rows).join(then.select("event_id"), "event_id").select(*got.columns))


def test_what_cannot_follow_is_told(spark):
    state = snapshots.snapshot(table(spark, [{"timestamp": 5, "session_id": "x"}, {"timestamp": 9}]))
    later = table(spark, [{"timestamp": 4}, {"timestamp": 9}, {"timestamp": 20, "session_id": "x"}, {"timestamp": 30, "session_id": "y"}, {"learner_id": "new", "timestamp": 1, "session_id": "x"}])
    later = later.selectExpr("*", "source_sequence + 10 as s").drop("source_sequence").withColumnRenamed("s", "source_sequence")
    assert {r["event_id"]: r["reason"] for r in snapshots.misplaced(state, later).collect()} == {"e0000": "not after the snapshot", "e0001": "at its last moment", "e0002": "in one of its sessions"}


def test_saved_and_taken_up(spark, tmp_path):
    rows = table(spark, random_rows(5))
    first, then = parts(rows, [3])
    snapshots.save(snapshots.snapshot(first), f"{tmp_path}/one")
    got = snapshots.taken_up(spark, f"{tmp_path}/one", then, f"{tmp_path}/two")
    whole = units.features(rows)
    assert key(got) == key(whole.join(then.select("event_id"), "event_id").select(*got.columns))
    assert key(snapshots.load(spark, f"{tmp_path}/two").learners) == key(snapshots.snapshot(rows).learners)
    with pytest.raises(ValueError, match="recent outcomes"):
        snapshots.load(spark, f"{tmp_path}/one", 5)
    with pytest.raises(ValueError, match="is "):
        snapshots.taken_up(spark, f"{tmp_path}/two", then, f"{tmp_path}/three")


def test_nothing_before_and_nothing_after(spark):
    rows = table(spark, random_rows(2, 40))
    empty = snapshots.snapshot(rows.limit(0))
    assert key(snapshots.restored(empty, rows)) == key(units.features(rows).select(*snapshots.restored(empty, rows).columns))
    assert snapshots.restored(snapshots.snapshot(rows), rows.limit(0)).count() == 0
