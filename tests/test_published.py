"""Published experiments: split digests, comparisons, slices and pages."""

import pytest
from pyspark.sql import functions as F

from praxilog.operators import experiment, metrics, splits
from praxilog.plans import artifacts

from .test_core import random_rows, table

NAMES = ("global", "item_prior")


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, random_rows(11)).cache()


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return str(tmp_path_factory.mktemp("experiments"))


@pytest.fixture(scope="module")
def made(rows, root):
    return experiment.publish(rows, root, "d1", NAMES)


def test_split_hash_tells_splits_apart(spark, rows):
    split = splits.forward_split(rows)
    own = experiment.split_hash(split)
    assert own == experiment.split_hash(split.orderBy(F.rand(3)).repartition(7))
    one = split.where("part = 'test'").first().event_id
    assert experiment.split_hash(split.withColumn("part", F.when(F.col("event_id") == one, "train").otherwise(F.col("part")))) != own
    assert experiment.split_hash(split.where("event_id <> 'e0007'")) != own
    assert experiment.split_hash(split.union(split.limit(1))) != own
    assert experiment.split_hash(split.limit(0)) == experiment.split_hash(split.limit(0))


def test_runs_of_one_split_are_paired(spark, rows, root, made):
    got = experiment.compare_runs(spark, root, made, made, *NAMES)
    kept = artifacts.load(spark, root, made, "predictions")
    assert got["same_dataset"] and got["same_split"] and got["left"].count() == 2
    assert got["paired"].first() == experiment.compare(kept, *NAMES).first()
    about = artifacts.manifest(spark, root, made)["metadata"]
    assert about["split_hash"] == experiment.split_hash(splits.forward_split(rows)) and about["dataset"] == "d1"


def test_runs_of_other_splits_are_only_described(spark, rows, root, made):
    other = experiment.publish(rows, root, "d1", ("global",), splits.forward_split(rows, 0.5, 0.2))
    got = experiment.compare_runs(spark, root, made, other, "item_prior", "global")
    assert got["same_dataset"] and not got["same_split"] and got["paired"] is None and got["right"].count() == 2
    with pytest.raises(ValueError, match="no model"):
        experiment.compare_runs(spark, root, made, other, "item_prior", "item_prior")
    spark.createDataFrame([(1,)], "n int").write.parquet(f"{root}/artifacts/{other}/split/more")
    with pytest.raises(ValueError, match="no sound"):
        experiment.compare_runs(spark, root, made, other, "item_prior", "global")


def test_a_split_without_a_part_is_refused(rows, root):
    with pytest.raises(ValueError, match="validation"):
        experiment.publish(rows, root, "d1", NAMES, splits.forward_split(rows).where("part <> 'validation'"))


def test_slices_and_pages(spark, root, made):
    kept = artifacts.load(spark, root, made, "predictions")
    own = [r for r in kept.collect() if r.model == "item_prior" and r.part == "test"]
    for learner, skill in [(None, None), ("u1", None), (None, "s2"), ("u1", "s2"), ("nobody", None)]:
        part = [r for r in own if (learner is None or r.learner_id == learner) and (skill is None or skill in r.skills)]
        got = experiment.slice_measures(kept, "item_prior", learner, skill, True).first()
        assert got.n == len(part)
        if part:
            assert got.brier == pytest.approx(sum((r.calibrated - r.correct) ** 2 for r in part) / len(part))
    ordered = lambda of: [(r.source_namespace, r.event_id) for r in sorted(own, key=lambda r: (of(r), r.source_namespace, r.event_id))]
    for sort, of in {"identity": lambda r: 0, "error": lambda r: -abs(r.correct - r.probability), "uncertain": lambda r: abs(r.probability - 0.5), "confidence": lambda r: -abs(r.probability - 0.5)}.items():
        page = experiment.inspect(kept, "item_prior", sort, offset=2, limit=6, part="test").collect()
        assert [(r.source_namespace, r.event_id) for r in page] == ordered(of)[2:8]
    assert metrics.scored(kept).count() == kept.count()
    with pytest.raises(KeyError):
        artifacts.load(spark, root, made, "../../other")
