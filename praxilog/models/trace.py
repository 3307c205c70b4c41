"""Replays of knowledge tracing: what is believed of each skill before, at and after each attempt, page by page.

A replay is kept as three tables: attempts with their places, what is believed at the end of
each stretch of units, and how many attempts a stretch has. A page reads the stretches that it
touches and folds these alone, from what was believed before them, however late it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN
from ..operators.units import units
from .bkt import DEFAULTS, NAMES

#: Units of a stretch.
EVERY = 64
#: Attempts that a page has at most. Each stretch has one or more, so a page touches no more stretches than this.
LONGEST_PAGE = 500
PLACED = ("stretch", "unit", "pos", "event_id", "question_id", "skills", "correct", "timestamp", "source_sequence")
UPDATE = ("skill", "before_unit", "prior", "prediction", "posterior", "following")


def placed(attempts: DataFrame, every: int = EVERY) -> DataFrame:
    """Attempts with ``domain``, ``pos``, ``unit`` and ``stretch`` (from 0, of ``every`` units each)."""
    if every < 1:
        raise ValueError("a stretch has one unit or more")
    stretch = F.floor((F.col("unit") - 1) / every).cast("long")
    return units(attempts).withColumn("stretch", stretch).select(*DOMAIN, *PLACED)


def _folded(start: Column, steps: Column) -> Column:
    """Each step of ``steps`` (``pos``, ``unit``, ``hit``, ``event_id``) with what is believed about it; ``start`` is believed before all."""
    initial, learning, slip, guess, forgetting = map(F.col, NAMES)
    empty = F.array().cast("array<struct<event_id:string,pos:int,before_unit:double,prior:double,prediction:double,posterior:double,following:double>>")

    def one(a: Column, x: Column) -> Column:
        known, held = a["known"], F.when(x["unit"] == a["unit"], a["held"]).otherwise(a["known"])
        right = known * (1 - slip) + (1 - known) * guess
        posterior = F.when(x["hit"], known * (1 - slip) / right).otherwise(known * slip / (1 - right))
        following = posterior * (1 - forgetting) + (1 - posterior) * learning
        told = F.struct(x["event_id"].alias("event_id"), x["pos"].alias("pos"), held.alias("before_unit"), known.alias("prior"), right.alias("prediction"), posterior.alias("posterior"), following.alias("following"))
        return F.struct(following.alias("known"), held.alias("held"), x["unit"].alias("unit"), F.concat(a["out"], F.array(told)).alias("out"))

    zero = F.struct(start.alias("known"), start.alias("held"), F.lit(-1).cast("long").alias("unit"), empty.alias("out"))
    return F.aggregate(steps, zero, one, lambda a: a["out"])


def updates(rows: DataFrame, parameters: DataFrame, before: DataFrame | None = None, primary: bool = True) -> DataFrame:
    """A row for each placed attempt and skill that it counts for: UPDATE, and the attempt's domain, ``stretch``, ``pos`` and ``event_id``.

    ``before`` has what was believed before ``rows`` (``known`` by domain and skill); a skill
    without it, or without parameters, starts from its initial value or the defaults.
    """
    counted = F.slice("skills", 1, 1) if primary else F.array_distinct("skills")
    each = rows.select(*DOMAIN, "pos", "unit", "stretch", "correct", "event_id", F.explode(counted).alias("skill"))
    steps = F.array_sort(F.collect_list(F.struct("pos", "unit", F.col("correct").alias("hit"), "event_id", "stretch")))
    seqs = each.groupBy(*DOMAIN, "skill").agg(steps.alias("steps")).join(parameters, "skill", "left")
    seqs = seqs.withColumns({n: F.coalesce(F.col(n), F.lit(float(d))) for n, d in zip(NAMES, DEFAULTS, strict=True)})
    start = F.col("initial")
    if before is not None:
        seqs = seqs.join(before.select(*DOMAIN, "skill", "known"), [*DOMAIN, "skill"], "left")
        start = F.coalesce("known", "initial")
    # steps and what is believed about them come in the same order
    both = F.arrays_zip(F.col("steps.stretch").alias("stretch"), _folded(start, F.col("steps")).alias("told"))
    out = seqs.select(*DOMAIN, "skill", F.explode(both).alias("x"))
    return out.select(*DOMAIN, "x.stretch", "x.told.pos", "x.told.event_id", "skill", *[f"x.told.{n}" for n in UPDATE[1:]])


def ends(told: DataFrame) -> DataFrame:
    """What is believed of each domain and skill at the end of the stretches that it occurs in."""
    return told.groupBy(*DOMAIN, "skill", "stretch").agg(F.max_by("following", "pos").alias("known"))


def traced(rows: DataFrame, told: DataFrame, parameters: DataFrame, rate: float) -> DataFrame:
    """Placed attempts with ``unit_size``, ``probability`` (the mean over counted skills before the unit; ``rate`` without any) and ``updates``."""
    own = [F.coalesce(F.col(n), F.lit(float(d))).alias(n) for n, d in zip(NAMES, DEFAULTS, strict=True) if n in ("slip", "guess")]
    each = told.join(parameters.select("skill", "slip", "guess"), "skill", "left").select(*told.columns, *own)
    chance = F.col("before_unit") * (1 - F.col("slip")) + (1 - F.col("before_unit")) * F.col("guess")
    each = each.groupBy(*DOMAIN, "pos").agg(F.avg(chance).alias("p"), F.sort_array(F.collect_list(F.struct(*UPDATE))).alias("updates"))
    sized = rows.withColumn("unit_size", F.count("*").over(Window.partitionBy(*DOMAIN, "unit")))
    out = sized.join(each, [*DOMAIN, "pos"], "left")
    none = F.array().cast(each.schema["updates"].dataType)
    return out.select(*sized.columns, F.coalesce("p", F.lit(float(rate))).alias("probability"), F.coalesce("updates", none).alias("updates"))


def trace(attempts: DataFrame, parameters: DataFrame, rate: float = 0.5, primary: bool = True) -> DataFrame:
    """:func:`traced` of all attempts, folded from the start."""
    rows = placed(attempts)
    return traced(rows, updates(rows, parameters, None, primary), parameters, rate)


def save(attempts: DataFrame, parameters: DataFrame, folder: str, every: int = EVERY, primary: bool = True) -> None:
    """Keeps the replay of all learners in ``folder``: tables ``attempts``, ``ends``, ``sizes`` and ``parameters``."""
    spark = attempts.sparkSession
    by_learner = [*DOMAIN, "stretch"]
    placed(attempts, every).repartition(*DOMAIN[:2]).sortWithinPartitions(*by_learner, "pos").write.parquet(f"{folder}/attempts")
    rows = spark.read.parquet(f"{folder}/attempts")
    parameters.write.parquet(f"{folder}/parameters")
    ends(updates(rows, spark.read.parquet(f"{folder}/parameters"), None, primary)).repartition(*DOMAIN[:2]).sortWithinPartitions(*by_learner).write.parquet(f"{folder}/ends")
    rows.groupBy(*by_learner).agg(F.count("*").alias("n")).repartition(*DOMAIN[:2]).sortWithinPartitions(*by_learner).write.parquet(f"{folder}/sizes")


def touched(spark: SparkSession, folder: str, learner: str, offset: int, limit: int) -> DataFrame:
    """The stretches of a learner's replay that a page touches, with ``before``, how many attempts come before each."""
    sizes = spark.read.parquet(f"{folder}/sizes").where(F.col("learner_id") == learner)
    up_to = Window.partitionBy("learner_id").orderBy(*DOMAIN, "stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("after", F.sum("n").over(up_to)).withColumn("before", F.col("after") - F.col("n"))
    return sizes.where((F.col("after") > offset) & (F.col("before") < offset + limit)).select(*DOMAIN, "stretch", "before")


def page(spark: SparkSession, folder: str, learner: str, offset: int = 0, limit: int = 100, rate: float = 0.5, primary: bool = True) -> DataFrame:
    """Rows ``offset`` on of a learner's kept replay, by ``place`` (from 0, by domains and their order): those of :func:`trace`.

    ``primary`` must be that of the replay. An offset beyond the end, or an unknown learner, has no rows.
    """
    if offset < 0 or not 1 <= limit <= LONGEST_PAGE:
        raise ValueError(f"offset must not be negative and limit be 1 to {LONGEST_PAGE}")
    mine = lambda name: spark.read.parquet(f"{folder}/{name}").where(F.col("learner_id") == learner)
    parameters = spark.read.parquet(f"{folder}/parameters")
    chosen = touched(spark, folder, learner, offset, limit)  # no more rows than the page has, so it is broadcast
    rows = mine("attempts").join(F.broadcast(chosen), [*DOMAIN, "stretch"])
    begun = chosen.groupBy(*DOMAIN).agg(F.min("stretch").alias("from"))
    before = mine("ends").join(F.broadcast(begun), list(DOMAIN)).where(F.col("stretch") < F.col("from"))
    before = before.groupBy(*DOMAIN, "skill").agg(F.max_by("known", "stretch").alias("known"))
    out = traced(rows.drop("before"), updates(rows, parameters, before, primary), parameters, rate)
    ahead = Window.partitionBy(*DOMAIN, "stretch").orderBy("pos")
    out = out.join(F.broadcast(chosen), [*DOMAIN, "stretch"]).withColumn("place", F.col("before") + F.row_number().over(ahead) - 1).drop("before")
    return out.where((F.col("place") >= offset) & (F.col("place") < offset + limit)).orderBy("place")
