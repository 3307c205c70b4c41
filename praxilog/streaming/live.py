"""Streams of attempts: late repeats left out, and accuracy by window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(attempts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each attempt once, as long as its repeats come within ``late``."""
    return attempts.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["source_namespace", "event_id"])


def accuracy_by_window(attempts: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Attempts and right answers of each question in each window of real time; state of closed windows is dropped."""
    real = attempts.where("time_semantics = 'real' and timestamp is not null").withWatermark("timestamp", late)
    rows = real.groupBy(F.window("timestamp", width), "question_id").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("successes"))
    return rows.select(F.col("window.start").alias("start"), "question_id", "n", "successes")
