"""Study plans: scored questions of each learner, and a greedy choice within a time budget."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN, order_domain, place_in_order
from ..functions.numeric import beta_bounds
from ..models import bkt
from .overview import item_durations


@dataclass(frozen=True)
class PlanConfig:
    budget_seconds: float = 900.0
    deficit_weight: float = 0.4
    uncertainty_weight: float = 0.4
    priority_weight: float = 0.2
    recent_window: int = 10
    recent_penalty: float = 0.25
    minimum_durations: int = 3
    maximum_actions: int = 12
    prerequisite_bound: float = 0.6
    model_weight: float = 0.2
    priorities: dict[str, float] = field(default_factory=dict)
    prerequisites: dict[str, list[str]] = field(default_factory=dict)
    #: Questions to choose from; all that the learner tried where it is empty.
    available: tuple[str, ...] = ()

    def check(self) -> None:
        """Weights must be finite and not all zero, limits within theirs, and prerequisites without cycles."""
        weights = [self.deficit_weight, self.uncertainty_weight, self.priority_weight, self.model_weight]
        if any(not math.isfinite(x) or x < 0 for x in [self.budget_seconds, *weights, *self.priorities.values()]) or self.budget_seconds <= 0 or not sum(weights[:3]):
            raise ValueError("weights must be finite, not negative and not all zero, the budget positive")
        if not (1 <= self.maximum_actions <= 100 and 0 <= self.recent_window <= 1000 and 0 < self.prerequisite_bound < 1 and 1 <= self.minimum_durations <= 1000):
            raise ValueError("a limit is out of its bounds")
        left = {k: set(v) for k, v in self.prerequisites.items()}
        while left:
            free = [k for k, v in left.items() if not v & left.keys()]
            if not free:
                raise ValueError("prerequisites form a cycle")
            for k in free:
                del left[k]


def expected(attempts: DataFrame, items: DataFrame, model: DataFrame, primary: bool = True) -> DataFrame:
    """``items`` (``learner_id``, ``question_id``, ``tags``) with ``foreseen``, the chance of a right answer that knowledge tracing gives a learner who has done all attempts; null without tags.

    ``model`` has a row of parameters for each skill (:func:`bkt.fit`), and skills without one
    have the defaults. The answer is thought of as the learner's next in the source and scope of
    its last attempt, and counts for the question's first tag, or as the mean over all of them
    unless ``primary``.
    """
    last = attempts.groupBy("learner_id").agg(F.max_by(F.struct("source_namespace", "order_scope"), place_in_order()).alias("last"))
    asked = items.join(last, "learner_id").select("learner_id", "question_id", "last.source_namespace", order_domain(scope="last.order_scope").alias("domain"), F.explode(F.slice("tags", 1, 1) if primary else F.col("tags")).alias("skill"))
    given = {n: F.coalesce(F.col(n), F.lit(float(d))) for n, d in zip(bkt.NAMES, bkt.DEFAULTS, strict=True)}
    rows = asked.join(bkt.states(attempts, model, primary), [*DOMAIN, "skill"], "left").join(model.select("skill", *bkt.NAMES), "skill", "left")
    known = F.coalesce("known", given["initial"])
    chance = known * (1 - given["slip"]) + (1 - known) * given["guess"]
    return items.join(rows.groupBy("learner_id", "question_id").agg(F.avg(chance).alias("foreseen")), ["learner_id", "question_id"], "left")


def candidates(attempts: DataFrame, config: PlanConfig = PlanConfig(), model: DataFrame | None = None, primary: bool = True) -> DataFrame:
    """A row for each learner and question tried (or available), with its score, its median time and how many prerequisites block it.

    With a ``model`` (see :func:`expected`) the score rises with what it expects the learner to get wrong.
    """
    config.check()
    spark = attempts.sparkSession
    hit = F.col("correct").cast("int")
    items = attempts.groupBy("learner_id", "question_id").agg(F.count("*").alias("n"), F.sum(hit).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("skills")))).alias("tags"))
    if config.available:
        asked = F.explode(F.array(*map(F.lit, dict.fromkeys(config.available))))
        items = attempts.select("learner_id").distinct().select("learner_id", asked.alias("question_id")).join(items, ["learner_id", "question_id"], "left")
        items = items.select("learner_id", "question_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "s")], F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    items = items.withColumn("bounds", beta_bounds("s", "n"))
    ordered = attempts.withColumn("back", F.row_number().over(Window.partitionBy("learner_id").orderBy(*[F.desc_nulls_first(c) for c in ("timestamp",)], F.desc("source_sequence"), F.desc("event_id"))))
    one = attempts.groupBy("learner_id").agg((F.bool_and(F.col("order_scope") == "learner") & (F.count_distinct("source_namespace") <= 1)).alias("ordered"))
    recent = ordered.where(F.col("back") <= config.recent_window).join(one.where("ordered"), "learner_id", "left_semi").select("learner_id", "question_id", F.lit(True).alias("recent")).distinct()
    top = max([1.0, *config.priorities.values()])
    weight = F.create_map(*[x for k, v in config.priorities.items() for x in (F.lit(k), F.lit(float(v)))]) if config.priorities else None
    own = F.array_max(F.transform("tags", lambda t: F.coalesce(F.element_at(weight, t), F.lit(1.0)))) if weight is not None else F.lit(1.0)
    rows = items.join(recent, ["learner_id", "question_id"], "left").join(item_durations(attempts).select("learner_id", "question_id", F.col("n").alias("durations"), "median_seconds"), ["learner_id", "question_id"], "left")
    score = config.deficit_weight * (1 - (F.col("s") + 1) / (F.col("n") + 2)) + config.uncertainty_weight * (F.col("bounds.upper") - F.col("bounds.lower")) + config.priority_weight * F.coalesce(own, F.lit(1.0)) / top
    if model is not None:
        rows = expected(attempts, rows, model, primary)
        score = score + config.model_weight * F.coalesce(1 - F.col("foreseen"), F.lit(0.0))
    rows = rows.withColumn("score", score - F.when(F.col("recent"), config.recent_penalty).otherwise(0.0))
    pairs = [(k, p) for k, v in sorted(config.prerequisites.items()) for p in v]
    if pairs:
        needs = spark.createDataFrame(pairs, "tag string, needed string")
        skills = attempts.select("learner_id", F.explode("skills").alias("needed"), "correct").groupBy("learner_id", "needed").agg(F.count("*").alias("sn"), F.sum(hit).alias("ss")).withColumn("low", beta_bounds("ss", "sn")["lower"])
        asked = rows.select("learner_id", "question_id", F.explode("tags").alias("tag")).join(needs, "tag").join(skills, ["learner_id", "needed"], "left")
        blocks = asked.groupBy("learner_id", "question_id").agg(F.count_if(F.col("low").isNull() | (F.col("low") < config.prerequisite_bound)).alias("blocks"))
        rows = rows.join(blocks, ["learner_id", "question_id"], "left")
    else:
        rows = rows.withColumn("blocks", F.lit(0))
    timed = F.coalesce(F.col("durations") >= config.minimum_durations, F.lit(False))
    return rows.select("learner_id", "question_id", "tags", "n", "s", F.col("bounds.lower").alias("lower"), F.col("bounds.upper").alias("upper"), F.coalesce("recent", F.lit(False)).alias("recent"), "score", "median_seconds", timed.alias("timed"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def plan(attempts: DataFrame, config: PlanConfig = PlanConfig(), model: DataFrame | None = None, primary: bool = True) -> DataFrame:
    """The questions chosen for each learner in order: best score first, leaving out those that no longer fit the budget."""
    rows = candidates(attempts, config, model, primary).where("timed and blocks = 0").select("learner_id", "question_id", "score", "median_seconds")
    budget, most = config.budget_seconds, config.maximum_actions

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, []
        for r in group.sort_values(["score", "question_id"], ascending=[False, True]).itertuples():
            if r.median_seconds <= left and len(kept) < most:
                left -= r.median_seconds
                kept.append((r.learner_id, len(kept) + 1, r.question_id, r.score, r.median_seconds, left))
        return pd.DataFrame(kept, columns=["learner_id", "place", "question_id", "score", "planned_seconds", "remaining_seconds"])

    return rows.groupBy("learner_id").applyInPandas(choose, "learner_id string, place int, question_id string, score double, planned_seconds double, remaining_seconds double")




def left_out(attempts: DataFrame, config: PlanConfig = PlanConfig(), most: int = 100) -> DataFrame:
    """What no plan may hold, the best ``most`` of each learner by ``reason``: ``blocked`` by prerequisites, else of ``unknown_time``."""
    rows = candidates(attempts, config).withColumn("reason", F.when(F.col("blocks") > 0, "blocked").when(~F.col("timed"), "unknown_time")).where("reason is not null")
    place = F.row_number().over(Window.partitionBy("learner_id", "reason").orderBy(F.desc("score"), "question_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("learner_id", "reason", "place", "question_id", "score", "blocks")
