"""As-of features that go on from a snapshot, without the attempts before it.

A snapshot is what features know at the end of closed units: tables of what each order
domain, each of its items and each of its skills has behind it, and the sessions that it
has seen. Features of later attempts start their counts from it, and a snapshot of those
alone, merged in, gives the next. Merging is associative, so parts may be made apart.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN, place_in_order
from .units import RECENT, named, placed, rate, skills_before, units, windowed

VERSION = "asof-state/1"


@dataclass(frozen=True)
class State:
    """Tables of a snapshot.

    ``learners``: a row for each order domain, with ``n`` and ``s`` (attempts and right ones), ``recent`` (the last outcomes,
    oldest first), ``known`` (the last moment), ``units`` and ``last`` (the place in the order of its last attempt).
    ``items`` and ``skills``: ``n`` and ``s`` of a ``question_id`` or ``skill`` in the domain. ``sessions``: ``session_id`` of the domain.
    """

    learners: DataFrame
    items: DataFrame
    skills: DataFrame
    sessions: DataFrame


def snapshot(attempts: DataFrame, recent: int = RECENT) -> State:
    """What is known after all of ``attempts``, whose units are taken as closed; one exchange by domain, and sums of items and skills."""
    rows = units(attempts).withColumn("hit", F.col("correct").cast("int"))
    counts = lambda rows, *keys: rows.groupBy(*DOMAIN, *keys).agg(F.count("*").alias("n"), F.sum("hit").alias("s"))
    each = rows.withColumn("size", F.count("*").over(Window.partitionBy(*DOMAIN)))
    late = F.when(F.col("pos") > F.col("size") - recent, F.struct("pos", "hit"))
    learners = each.groupBy(*DOMAIN).agg(
        F.count("*").alias("n"), F.sum("hit").alias("s"), F.transform(F.array_sort(F.collect_list(late)), lambda x: x["hit"]).alias("recent"),
        F.max("timestamp").alias("known"), F.max("unit").cast("long").alias("units"), F.max(place_in_order()).alias("last"),
    )
    plain = placed(attempts).withColumn("hit", F.col("correct").cast("int"))
    sessions = plain.where("session_id is not null").select(*DOMAIN, "session_id").distinct()
    return State(learners, counts(plain, "question_id"), counts(plain.withColumn("skill", F.explode("skills")), "skill"), sessions)


def merged(first: State, then: State, recent: int = RECENT) -> State:
    """The snapshot of what both stand for, ``then`` after ``first`` in each domain."""
    both = lambda name: getattr(first, name).withColumn("part", F.lit(0)).unionByName(getattr(then, name).withColumn("part", F.lit(1)))
    sums = lambda name, key: both(name).groupBy(*DOMAIN, key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    outcomes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "recent"))), lambda x: x["recent"]))
    learners = both("learners").groupBy(*DOMAIN).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), outcomes.alias("recent"), F.max("known").alias("known"), F.sum("units").alias("units"), F.max("last").alias("last"))
    learners = learners.withColumn("recent", F.slice("recent", F.greatest(F.size("recent") - recent, F.lit(0)) + 1, recent))
    return State(learners, sums("items", "question_id"), sums("skills", "skill"), both("sessions").drop("part").distinct())


def misplaced(state: State, attempts: DataFrame) -> DataFrame:
    """Attempts that can't follow the snapshot, with ``reason``: they come before its last one, at its moment, or in a session that it has seen.

    None, for attempts that :func:`restored` gives the whole's features of.
    """
    rows = placed(attempts)
    own = rows.join(state.learners.select(*DOMAIN, "last"), list(DOMAIN), "left")
    seen = state.sessions.withColumn("again", F.lit(True))
    own = own.join(seen, [*DOMAIN, "session_id"], "left")
    reason = F.when(place_in_order() <= F.col("last"), "not after the snapshot").when(F.col("timestamp") == F.col("last.timestamp"), "at its last moment").when(F.col("again"), "in one of its sessions")
    return own.select("source_namespace", "event_id", reason.alias("reason")).where("reason is not null")


def restored(state: State, attempts: DataFrame, recent: int = RECENT) -> DataFrame:
    """Features (as of :func:`units.features`) of attempts that follow a snapshot; units go on counting from it.

    Windows over the attempts alone are made first, by one exchange of their domains; what is
    behind them comes by joins with the snapshot. No attempts: no rows; a domain that the
    snapshot lacks starts from nothing.
    """
    rows = windowed(attempts, recent)
    rows = rows.join(state.learners.select(*DOMAIN, F.struct("n", "s", "recent", "known", "units").alias("base")), list(DOMAIN), "left")
    rows = rows.join(state.items.select(*DOMAIN, "question_id", F.struct("n", "s").alias("base_item")), [*DOMAIN, "question_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kept = F.coalesce("base.recent", F.array().cast("array<int>"))
    more = F.least(F.greatest(F.lit(recent) - F.col("past.late_n").cast("int"), F.lit(0)), F.size(kept))
    late = F.aggregate(F.slice(kept, F.size(kept) - more + 1, more), F.lit(0), lambda n, x: n + x)
    past = F.struct((F.col("past.n") + zero("base.n")).alias("n"), (F.col("past.s") + zero("base.s")).alias("s"), (F.col("past.late_n") + more).alias("late_n"), (F.col("past.late_s") + late).alias("late_s"), F.coalesce("past.known", "base.known").alias("known"))
    item = F.struct((F.col("item.n") + zero("base_item.n")).alias("n"), (F.col("item.s") + zero("base_item.s")).alias("s"))
    return named(rows.withColumns({"past": past, "item": item, "unit": F.col("unit") + zero("base.units")}))


def restored_skills(state: State, attempts: DataFrame) -> DataFrame:
    """Skill features (as of :func:`units.skill_features`) of attempts that follow a snapshot."""
    rows = skills_before(attempts)
    rows = rows.join(state.skills.select(*DOMAIN, "skill", F.struct("n", "s").alias("base")), [*DOMAIN, "skill"], "left")
    n, s = (F.col(f"past.{k}") + F.coalesce(F.col(f"base.{k}"), F.lit(0)) for k in "ns")
    return rows.select("source_namespace", "event_id", "skill", n.alias("prior_attempts"), rate(s, n).alias("prior_rate"))


def save(state: State, folder: str, recent: int = RECENT) -> None:
    """Writes a snapshot to a new folder that all executors share; its mark comes last, so that a folder without it is no snapshot."""
    for f in fields(State):
        getattr(state, f.name).write.parquet(f"{folder}/{f.name}")
    spark = state.learners.sparkSession
    spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(recent).alias("recent")).write.parquet(f"{folder}/about")


def load(spark: SparkSession, folder: str, recent: int = RECENT) -> State:
    """A snapshot that :func:`save` wrote for as many recent outcomes."""
    about = spark.read.parquet(f"{folder}/about").first()
    if (about["version"], about["recent"]) != (VERSION, recent):
        raise ValueError(f"{folder} holds {about['version']} of {about['recent']} recent outcomes")
    return State(*[spark.read.parquet(f"{folder}/{f.name}") for f in fields(State)])


def taken_up(spark: SparkSession, before: str, attempts: DataFrame, after: str, recent: int = RECENT) -> DataFrame:
    """Features of attempts that follow the snapshot in folder ``before``; their snapshot goes to folder ``after``. Attempts that can't follow it raise."""
    state = load(spark, before, recent)
    if (bad := misplaced(state, attempts).limit(1).collect()):
        raise ValueError(f"event {bad[0]['event_id']} is {bad[0]['reason']}")
    save(merged(state, snapshot(attempts, recent), recent), after, recent)
    return restored(state, attempts, recent)
