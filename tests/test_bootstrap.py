"""Bootstrap intervals against plain weighted sums, with the same weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from praxilog.operators import metrics

from .test_core import table


@pytest.fixture(scope="module")
def made(spark):
    """Predictions with ties, a probability that a third has, and clusters of very unlike sizes."""
    r = random.Random(4)
    rows = [{"learner_id": f"u{min(r.randrange(60), r.randrange(60))}", "correct": r.random() < 0.6} for _ in range(900)]
    chance = F.element_at(F.array(*map(F.lit, (0.5, 0.5, 0.5, 0.1, 0.3, 0.31, 0.77, 0.9, 1.0))), (F.col("source_sequence") % 9 + 1).cast("int"))
    return table(spark, rows).withColumn("probability", chance).repartition(5).cache()


def weights(rows, repetitions, seed):
    return {r.learner_id: np.array(r.w, float) for r in rows.select("learner_id").distinct().withColumn("w", metrics.drawn("learner_id", repetitions, seed)).collect()}


def test_weights_are_poisson_draws(spark):
    w = np.array([r.w for r in spark.range(4000).select(metrics.drawn("id", 50, 1).alias("w")).collect()])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005


def test_means_are_those_of_plain_weighted_sums(made):
    own = weights(made, 40, 2)
    sums = {r.learner_id: np.array([r.n, r.loss, r.square, r.right], float) for r in metrics.cluster_sums(made).collect()}
    total = sum(own[k][:, None] * sums[k] for k in sums)
    got = metrics.bootstrap(metrics.cluster_sums(made), repetitions=40, seed=2).first()
    for j, name in enumerate(("loss", "square", "right"), 1):
        low, high = np.percentile(total[:, j] / total[:, 0], [2.5, 97.5])
        assert got[f"{name}_lower"] == pytest.approx(low) and got[f"{name}_upper"] == pytest.approx(high)


def plain_areas(made, repetitions, seed):
    own, rows = weights(made, repetitions, seed), made.collect()
    w = np.array([own[r.learner_id] for r in rows])
    y, p = np.array([r.correct for r in rows]), np.array([r.probability for r in rows])
    beats = (p[y][:, None] > p[~y][None]) + 0.5 * (p[y][:, None] == p[~y][None])
    pairs = np.einsum("ir,ij,jr->r", w[y], beats, w[~y])
    whole = w[y].sum(0) * w[~y].sum(0)
    return pairs[whole > 0] / whole[whole > 0]


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_areas_are_exact_wherever_ranges_are_cut(spark, made, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = metrics.auroc_interval(made, repetitions=25, seed=3).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
    areas = plain_areas(made, 25, 3)
    low, high = np.percentile(areas, [2.5, 97.5])
    assert got.eligible_draws == len(areas) and got.auroc_lower == pytest.approx(low, abs=1e-12) and got.auroc_upper == pytest.approx(high, abs=1e-12)


def test_one_class_and_nothing(made):
    got = metrics.auroc_interval(made.where("correct"), repetitions=20).first()
    assert got.eligible_draws == 0 and got.auroc_lower is None
    assert metrics.auroc_interval(made.limit(0), repetitions=20).first().eligible_draws == 0
    assert metrics.bootstrap(metrics.cluster_sums(made.limit(0)), repetitions=20).first().loss_lower is None
    with pytest.raises(ValueError, match="20 to 5000"):
        metrics.bootstrap(metrics.cluster_sums(made), repetitions=3)


def test_one_row_a_partition_is_shuffled(made):
    plan = metrics.bootstrap(metrics.cluster_sums(made), repetitions=20)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.index("Generate") < plan.index("MapInArrow")
