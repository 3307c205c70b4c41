"""Indivisible units of history, and features from what came before a unit.

A unit is the closure of overlapping intervals: from any attempt it reaches to the last
attempt of its session and of its moment, and on from those. Attempts of a unit know
nothing of each other. All windows extend the order domain, so one exchange serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN, order_domain, within

#: A longer unit is an error: it would have to be held whole.
UNIT_ROWS = 65_536
RECENT = 10


def placed(attempts: DataFrame) -> DataFrame:
    """Attempts with ``domain`` and ``pos``, their place in it from 1."""
    return attempts.withColumn("domain", order_domain()).withColumn("pos", F.row_number().over(within(*DOMAIN)))


def coupled(attempts: DataFrame) -> bool:
    """Whether any attempt has a session or a time; without, each attempt is a unit."""
    return attempts.where("session_id is not null or timestamp is not null").limit(1).count() > 0


def opened(attempts: DataFrame, coupled: bool = True) -> DataFrame:
    """:func:`units` with ``opens``, 1 for the first attempt of a unit; rows come out in order of their domains."""
    rows = placed(attempts)
    if not coupled:
        return rows.withColumns({"opens": F.lit(1), "unit": F.col("pos").cast("long")})
    # peers in time lie together in the known order, so each reaches to the next; one window serves this and the places
    again = F.lead("timestamp").over(within(*DOMAIN)) == F.col("timestamp")
    rows = rows.withColumn("last_of_moment", F.when(again, F.col("pos") + 1))
    last_of_session = F.when(F.col("session_id").isNotNull(), F.max("pos").over(Window.partitionBy(*DOMAIN, "session_id")))
    rows = rows.withColumn("reach", F.greatest("pos", "last_of_moment", last_of_session))
    before = Window.partitionBy(*DOMAIN).orderBy("pos")
    reached = F.max("reach").over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(reached.isNull() | (F.col("pos") > reached), 1).otherwise(0))
    return rows.withColumn("unit", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0))).drop("reach", "last_of_moment")


def units(attempts: DataFrame, coupled: bool = True) -> DataFrame:
    """Attempts with ``domain``, ``pos`` and ``unit`` (from 1 in each domain).

    Where attempts are known not to be :func:`coupled`, the windows that close units are left out.
    """
    return opened(attempts, coupled).drop("opens")


def unit_sizes(attempts: DataFrame) -> DataFrame:
    return units(attempts).groupBy(*DOMAIN, "unit").agg(F.count("*").alias("size"))


def check_units(attempts: DataFrame, most: int = UNIT_ROWS) -> DataFrame:
    """Units longer than ``most``; none for data that features can be built from."""
    return unit_sizes(attempts).where(F.col("size") > most)


def _carried(first: Column, *keys: str, **values: Column) -> Column:
    """Values as they were at the last attempt that ``first`` marks, within the domain and keys: one window in the order that made them."""
    w = Window.partitionBy(*DOMAIN, *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(first, F.struct(*[c.alias(k) for k, c in values.items()])), ignorenulls=True).over(w)


def _before(*keys: str) -> dict[str, Column]:
    """Attempts and right ones before, within the domain and keys."""
    w = Window.partitionBy(*DOMAIN, *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return {"n": F.count("hit").over(w), "s": F.coalesce(F.sum("hit").over(w), F.lit(0))}


def _first_of_unit(*keys: str) -> Column:
    """Whether no attempt of the keys is before it in the unit."""
    return ~F.lag("unit").over(Window.partitionBy(*DOMAIN, *keys).orderBy("pos")).eqNullSafe(F.col("unit"))


def rate(s: Column, n: Column) -> Column:
    return (s + 1) / (n + 2)


def windowed(attempts: DataFrame, recent: int = RECENT, coupled: bool = True) -> DataFrame:
    """Attempts with ``past`` and ``item``: counts of what came before their unit, overall, lately and of the item, and the last known moment."""
    rows = opened(attempts, coupled).withColumn("hit", F.col("correct").cast("int"))
    lately = Window.partitionBy(*DOMAIN).orderBy("pos").rowsBetween(-recent, -1)
    ever = Window.partitionBy(*DOMAIN).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"own_{k}": c for k, c in _before().items()} | {"late_n": F.count("hit").over(lately), "late_s": F.coalesce(F.sum("hit").over(lately), F.lit(0)), "known": F.last("timestamp", ignorenulls=True).over(ever)})
    rows = rows.withColumn("past", _carried(F.col("opens") == 1, n=F.col("own_n"), s=F.col("own_s"), late_n=F.col("late_n"), late_s=F.col("late_s"), known=F.col("known")))
    rows = rows.withColumns({f"item_{k}": c for k, c in _before("question_id").items()} | {"first_of_item": _first_of_unit("question_id")})
    return rows.withColumn("item", _carried(F.col("first_of_item"), "question_id", n=F.col("item_n"), s=F.col("item_s")))


def named(rows: DataFrame) -> DataFrame:
    """The features that ``past`` and ``item`` of :func:`windowed` make."""
    seconds = F.greatest(F.lit(0.0), (F.unix_micros("timestamp") - F.unix_micros("past.known")) / 1e6)
    known = F.col("timestamp").isNotNull() & F.col("past.known").isNotNull()
    return rows.select(
        "source_namespace", "event_id", "learner_id", "question_id", "correct", "domain", "unit", "attempt_kind", "skills",
        F.col("past.n").alias("past_attempts"), F.col("past.s").alias("past_successes"), rate(F.col("past.s"), F.col("past.n")).alias("past_accuracy"),
        F.col("past.late_n").alias("recent_count"), rate(F.col("past.late_s"), F.col("past.late_n")).alias("recent_accuracy"),
        F.col("item.n").alias("item_past_attempts"), rate(F.col("item.s"), F.col("item.n")).alias("item_past_accuracy"),
        F.when(known, 0.0).otherwise(1.0).alias("gap_unknown"), F.when(known, F.log1p(seconds)).otherwise(0.0).alias("gap_log_seconds"),
    )


def features(attempts: DataFrame, recent: int = RECENT, coupled: bool = True) -> DataFrame:
    """Attempts with :func:`history_features` and :func:`gap_features`, in one pass."""
    return named(windowed(attempts, recent, coupled))


def history_features(attempts: DataFrame, recent: int = RECENT, coupled: bool = True) -> DataFrame:
    """Attempts with counts and smoothed rates of what came before their unit: overall, lately and of the item."""
    return features(attempts, recent, coupled).drop("attempt_kind", "skills", "gap_unknown", "gap_log_seconds")


def gap_features(attempts: DataFrame) -> DataFrame:
    """Attempts with the time since the last known moment before their unit: ``gap_unknown`` and ``gap_log_seconds``."""
    return features(attempts).select("source_namespace", "event_id", "gap_unknown", "gap_log_seconds")


def skills_before(attempts: DataFrame) -> DataFrame:
    """A row for each attempt and skill, with ``past``: counts of the skill before the unit."""
    rows = units(attempts).withColumn("hit", F.col("correct").cast("int")).withColumn("skill", F.explode("skills"))
    rows = rows.withColumns(_before("skill") | {"first": _first_of_unit("skill")})
    return rows.withColumn("past", _carried(F.col("first"), "skill", n=F.col("n"), s=F.col("s")))


def skill_features(attempts: DataFrame) -> DataFrame:
    """A row for each attempt and skill: attempts and smoothed rate of the skill before the unit, in the order domain."""
    return skills_before(attempts).select("source_namespace", "event_id", "skill", F.col("past.n").alias("prior_attempts"), rate(F.col("past.s"), F.col("past.n")).alias("prior_rate"))


def feature_map(attempts: DataFrame) -> DataFrame:
    """``features``, a map of all numeric features of an attempt by name, with ``kind=...`` and one entry a skill."""
    key = ["source_namespace", "event_id"]
    one = F.lit(1.0)
    entry = lambda name, value: F.struct(F.concat(F.lit(name), "skill").alias("k"), F.coalesce(value, F.lit(0.0)).alias("v"))
    skills = skill_features(attempts).groupBy(*key).agg(
        F.map_from_entries(F.flatten(F.collect_list(F.array(
            entry("skill:", one), entry("prior_rate:", F.col("prior_rate")), entry("prior_count:", F.log1p("prior_attempts")),
        )))).alias("of_skills")
    )
    rows = features(attempts).withColumn("n_skills", F.size("skills")).join(skills, key, "left")
    names = {
        "learner_log_attempts": F.log1p("past_attempts"), "learner_rate": F.col("past_accuracy"), "item_log_attempts": F.log1p("item_past_attempts"), "item_rate": F.col("item_past_accuracy"),
        "recent_rate": F.col("recent_accuracy"), "recent_count": F.col("recent_count").cast("double"), "cold_learner": (F.col("past_attempts") == 0).cast("double"), "cold_item": (F.col("item_past_attempts") == 0).cast("double"),
        "unknown_skill": (F.col("n_skills") == 0).cast("double"), "gap_unknown": F.col("gap_unknown"), "gap_log_seconds": F.col("gap_log_seconds"),
    }
    own = F.create_map(*[x for k, c in names.items() for x in (F.lit(k), c)], F.concat(F.lit("kind="), "attempt_kind"), one)
    return rows.select(*key, F.when(F.col("of_skills").isNull(), own).otherwise(F.map_concat(own, "of_skills")).alias("features"))
