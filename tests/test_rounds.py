"""Rounds of fits don't make plans whose estimates of sizes grow without end."""

from pyspark.sql import functions as F

from praxilog.functions.lineage import SIZED, cut_round
from praxilog.models import irt


def digits(frame):
    return len(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_sizes_of_rounds_are_found_again(spark):
    rows = spark.range(20).withColumn("x", F.lit(1.0))
    for k in range(SIZED):
        rows = cut_round(rows.join(rows.select("id", F.col("x").alias("y")), "id").select("id", (F.col("x") + F.col("y")).alias("x")), k)
    assert digits(rows) < 20
    assert sorted((r.id, r.x) for r in rows.collect()) == [(i, 2.0**SIZED) for i in range(20)]


def test_item_response_rounds_have_bounded_plans(spark):
    rows = spark.createDataFrame([("n", f"u{i}", f"q{j}", 3, (i * j + i) % 4) for i in range(8) for j in range(6)], "source_namespace string, learner_id string, question_id string, n long, s long")
    learners, items = irt.fit(rows, 2, rounds=12, tolerance=0.0)
    assert digits(items) < 30_000 and digits(learners) < 30_000
    assert items.count() == 6 and learners.count() == 8
