"""Splits into train, validation and test that keep units and order whole, and their audit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN
from ..functions.ranks import ranked
from .units import units

RANKS = ("train", "validation", "test")


def _counted(attempts: DataFrame) -> DataFrame:
    rows = units(attempts)
    return rows.withColumn("units", F.max("unit").over(Window.partitionBy(*DOMAIN)))


def _part(share: float):
    """Whole units below a share; shares are doubles, as products truncate differently as decimals."""
    return F.floor(F.col("units") * F.lit(float(share))).cast("int")


def forward_split(attempts: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """``source_namespace``, ``event_id``, ``part``: the first units of a domain train, then validate, then test.

    Domains of fewer than five units are excluded.
    """
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("train and validation must leave a share to test")
    rows = _counted(attempts).withColumn("a", F.greatest(F.lit(1), _part(train)))
    rows = rows.withColumn("b", F.least(F.greatest(F.col("a") + 1, _part(train + validation)), F.col("units") - 1))
    part = F.when(F.col("units") < 5, "excluded").when(F.col("unit") <= F.col("a"), "train").when(F.col("unit") <= F.col("b"), "validation").otherwise("test")
    return rows.select(*DOMAIN, "unit", "event_id", part.alias("part"))


def rolling_splits(attempts: DataFrame, folds: int = 3) -> DataFrame:
    """The same for each ``fold``, whose cuts move on; what is after a fold's test is excluded."""
    if not 2 <= folds <= 10:
        raise ValueError("folds must be 2 to 10")
    rows = _counted(attempts).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    at = lambda base: F.floor(F.col("units") * (F.lit(base) + F.lit(0.35) * F.col("fold") / folds)).cast("int")
    rows = rows.withColumn("a", F.greatest(F.lit(1), at(0.35)))
    rows = rows.withColumn("b", F.greatest(F.col("a") + 1, at(0.45)))
    rows = rows.withColumn("c", F.least(F.col("units"), F.greatest(F.col("b") + 1, at(0.55))))
    part = F.when(F.col("units") < folds + 4, "excluded").when(F.col("unit") <= F.col("a"), "train").when(F.col("unit") <= F.col("b"), "validation").when(F.col("unit") <= F.col("c"), "test").otherwise("excluded")
    return rows.select(*DOMAIN, "unit", "event_id", "fold", part.alias("part"))


def learner_split(attempts: DataFrame, train: float = 0.6, validation: float = 0.2, seed: int = 0) -> DataFrame:
    """Whole learners, by the seeded order of a hash of source and learner; exact shares by rank."""
    learners = attempts.select("source_namespace", "learner_id").distinct()
    n = learners.count()
    if n < 5:
        raise ValueError("at least five learners are needed")
    a = max(1, int(n * train))
    b = min(n - 1, max(a + 1, int(n * (train + validation))))
    key = F.xxhash64(F.lit(int(np.random.default_rng(seed).integers(1 << 62))), "source_namespace", "learner_id")
    rank = F.col("rank")
    part = F.when(rank < a, "train").when(rank < b, "validation").otherwise("test")
    parts = ranked(learners.withColumn("key", key), "key").select("source_namespace", "learner_id", part.alias("part"))
    return attempts.join(parts, ["source_namespace", "learner_id"]).select("source_namespace", "learner_id", "event_id", "part")


def audit_split(attempts: DataFrame, split: DataFrame) -> DataFrame:
    """One row of counts that are all 0 for a sound split: attempts without or with several parts, parts without attempt,
    units across parts, and units that come before an earlier part's."""
    key = ["source_namespace", "event_id"]
    rows = units(attempts).select(*DOMAIN, "unit", "event_id")
    parts = split.groupBy(*key).agg(F.count("*").alias("times"), F.min("part").alias("part"))
    both = rows.join(parts, key, "full")
    rank = F.when(F.col("part") == "train", 0).when(F.col("part") == "validation", 1).when(F.col("part") == "test", 2)
    each = both.where("unit is not null").groupBy(*DOMAIN, "unit").agg(F.count_distinct("part").alias("parts"), F.max(rank).alias("rank"))
    before = Window.partitionBy(*DOMAIN).orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("reached", F.max("rank").over(before))
    ordered = each.agg(F.count_if(F.col("parts") > 1).alias("units_across_parts"), F.count_if(F.col("rank") < F.col("reached")).alias("units_before_earlier_parts"))
    cover = both.agg(F.count_if(F.col("part").isNull()).alias("without_part"), F.count_if(F.col("times") > 1).alias("with_several"), F.count_if(F.col("unit").isNull()).alias("without_attempt"))
    return cover.join(ordered)
