"""Smoothed rates: of all attempts, of an item, and of recent history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.units import history_features, units
from ..functions.expressions import DOMAIN
from pyspark.sql import Window

KEY = ("source_namespace", "event_id")


def global_rate(train: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """One row: the smoothed rate of all attempts."""
    return train.agg(((F.coalesce(F.sum(F.col("correct").cast("int")), F.lit(0)) + alpha) / (F.count("*") + alpha + beta)).alias("rate"))


def rate_of(train: DataFrame) -> float:
    return float(global_rate(train).first()[0])


def predict_global(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.withColumn("probability", F.lit(rate_of(train)))


def item_rates(train: DataFrame, strength: float = 10.0) -> DataFrame:
    """Each item's rate, drawn towards the global one by ``strength`` attempts."""
    g = rate_of(train)
    sums = train.groupBy("source_namespace", "question_id").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("s"))
    return sums.select("source_namespace", "question_id", "n", ((F.col("s") + strength * g) / (F.col("n") + strength)).alias("probability"))


def predict_item(train: DataFrame, test: DataFrame, strength: float = 10.0) -> DataFrame:
    """Unseen items have the global rate."""
    rates = item_rates(train, strength).drop("n")
    return test.join(rates, ["source_namespace", "question_id"], "left").withColumn("probability", F.coalesce("probability", F.lit(rate_of(train))))


def predict_recent(attempts: DataFrame, rate: float, window: int = 10) -> DataFrame:
    """Rate of the last attempts before a unit, drawn towards ``rate`` by two attempts; state goes on through all attempts given."""
    rows = history_features(attempts, window)
    s = F.col("recent_accuracy") * (F.col("recent_count") + 2) - 1
    return rows.withColumn("probability", (s + F.lit(2 * rate)) / (F.col("recent_count") + 2))


def unit_starts(attempts: DataFrame) -> DataFrame:
    """Units with the number of attempts before them in their domain."""
    rows = units(attempts)
    return rows.withColumn("past", F.min("pos").over(Window.partitionBy(*DOMAIN, "unit")) - 1)
