"""Item-response models of one and two parameters, fitted by rounds of Newton steps as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN
from ..functions.lineage import cut, cut_round
from ..operators.units import units

LEARNER, ITEM = ("source_namespace", "learner_id"), ("source_namespace", "question_id")


def responses(train: DataFrame) -> DataFrame:
    """The counts of each learner at each item: all that a fit needs."""
    return train.groupBy("source_namespace", "learner_id", "question_id").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("s"))


def components(rows: DataFrame, passes: int = 100) -> DataFrame:
    """Learners with ``component``, the least learner that shared items reach from them.

    Labels go over items, and then each is replaced by its own label, so that long chains
    take few passes.
    """
    links = rows.select("source_namespace", "learner_id", "question_id").distinct()
    labels = links.select(*LEARNER).distinct().withColumn("component", F.struct(*LEARNER))
    for k in range(passes):
        items = links.join(labels, list(LEARNER)).groupBy(*ITEM).agg(F.min("component").alias("component"))
        near = links.join(items, list(ITEM)).groupBy(*LEARNER).agg(F.min("component").alias("component"))
        its = near.select(F.struct(*LEARNER).alias("component"), F.col("component").alias("its"))
        after = cut_round(near.join(its, "component").select(*LEARNER, F.col("its").alias("component")), k)
        moved = after.join(labels.withColumnRenamed("component", "before"), list(LEARNER)).where("component <> before").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise ValueError("the components weren't found within the passes")


def largest_component(rows: DataFrame) -> DataFrame:
    """The responses of the component with most attempts (of equal ones that of the least learner): other components' scales can't be compared."""
    labels = components(rows)
    sizes = rows.join(labels, list(LEARNER)).groupBy("component").agg(F.sum("n").alias("total"))
    chosen = sizes.orderBy(F.desc("total"), "component").limit(1)
    return rows.join(labels.join(F.broadcast(chosen), "component", "left_semi").select(*LEARNER), list(LEARNER), "left_semi")


def eligible(rows: DataFrame, minimum_learner: int = 10, minimum_item: int = 20, passes: int = 100) -> DataFrame:
    """Responses of learners and items that have enough attempts among each other: the core, pruned until it stays, and of it the largest component."""
    count = rows.count()
    for _ in range(passes):
        for keys, least in ((LEARNER, minimum_learner), (ITEM, minimum_item)):
            enough = rows.groupBy(*keys).agg(F.sum("n").alias("total")).where(F.col("total") >= least).select(*keys)
            rows = rows.join(enough, list(keys), "left_semi")
        rows = cut(rows)
        before, count = count, rows.count()
        if before == count:
            return cut(largest_component(rows))
    raise ValueError("the core didn't settle within the passes")


def _chance() -> Column:
    return 1 / (1 + F.exp(-F.col("discrimination") * (F.col("ability") - F.col("difficulty"))))


def _log_likelihood() -> Column:
    """Of a row's answers, without overflow for whatever chance."""
    gap = F.col("discrimination") * (F.col("ability") - F.col("difficulty"))
    return F.col("s") * gap - F.col("n") * (F.greatest(gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap))))


def objective(rows: DataFrame, learners: DataFrame, items: DataFrame, penalty: float = 0.1) -> DataFrame:
    """One row: ``value``, the log-likelihood of responses less the penalties of abilities, difficulties and discriminations (about 1): what a fit makes largest."""
    fits = rows.join(learners, list(LEARNER)).join(items, list(ITEM)).agg(F.sum(_log_likelihood()).alias("a"))
    own = learners.agg(F.sum(F.col("ability") ** 2).alias("b"))
    its = items.agg(F.sum(F.col("difficulty") ** 2 + (F.col("discrimination") - 1) ** 2).alias("c"))
    return fits.join(own).join(its).select((F.col("a") - penalty / 2 * (F.col("b") + F.col("c"))).alias("value"))


def fit(rows: DataFrame, parameters: int = 1, rounds: int = 60, penalty: float = 0.1, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Learners with ``ability``, centred, and items with ``difficulty`` and ``discrimination``: where :func:`objective` is largest.

    Every round takes a Newton step of all abilities, shifts abilities and difficulties together
    to where their penalties are least, and takes a Newton step of all items. Rounds end when the
    objective changes by less than ``tolerance`` of itself, after ``rounds`` at most; one that lowers it halves how far steps
    may go. Difficulties stay within 6 (before they are centred), discriminations within 0.25 and 3.
    """
    learners = rows.select(*LEARNER).distinct().withColumn("ability", F.lit(0.0))
    items = rows.select(*ITEM).distinct().withColumn("difficulty", F.lit(0.0)).withColumn("discrimination", F.lit(1.0))
    bound = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    a, gap = F.col("discrimination"), F.col("ability") - F.col("difficulty")
    left, weight = F.col("s") - F.col("n") * F.col("p"), F.col("n") * F.col("p") * (1 - F.col("p"))
    last, reach, centre = None, 1.0, 0.0
    for k in range(rounds):
        both = rows.join(learners, list(LEARNER)).join(items, list(ITEM)).withColumn("p", _chance())
        step = both.groupBy(*LEARNER, "ability").agg(F.sum(a * left).alias("g"), F.sum(a * a * weight).alias("h"), F.sum(_log_likelihood()).alias("fits"))
        ability = bound(F.col("ability") + bound((F.col("g") - penalty * F.col("ability")) / (F.col("h") + penalty), -2.0 * reach, 2.0 * reach), -6.0, 6.0)
        moved = cut_round(step.select(*LEARNER, ability.alias("ability"), (F.col("fits") - penalty / 2 * F.col("ability") ** 2).alias("fits")), k)
        own = moved.agg(F.sum("fits"), F.sum("ability"), F.count("*")).first()
        its = items.agg(F.sum(F.col("difficulty") ** 2 + (a - 1) ** 2), F.sum("difficulty"), F.count("*")).first()
        if not own[2]:
            break
        value, shift = own[0] - penalty / 2 * its[0], -(own[1] + its[1]) / (own[2] + its[2])
        centre = own[1] / own[2] + shift
        learners = moved.select(*LEARNER, (F.col("ability") + shift).alias("ability"))
        if last is not None and abs(value - last) <= tolerance * (1 + abs(value)):
            items = items.withColumn("difficulty", F.col("difficulty") + shift)
            break
        reach, last = reach / 2 if last is not None and value < last else reach, value
        both = rows.join(learners, list(LEARNER)).join(items.withColumn("difficulty", F.col("difficulty") + shift), list(ITEM)).withColumn("p", _chance())
        step = both.groupBy(*ITEM, "difficulty", "discrimination").agg(F.sum(-a * left).alias("g"), F.sum(a * a * weight).alias("h"), F.sum(gap * left).alias("ga"), F.sum(gap * gap * weight).alias("ha"))
        difficulty = bound(F.col("difficulty") + bound((F.col("g") - penalty * F.col("difficulty")) / (F.col("h") + penalty), -2.0 * reach, 2.0 * reach), -6.0, 6.0)
        discrimination = bound(a + bound((F.col("ga") - penalty * (a - 1)) / (F.col("ha") + penalty), -0.5 * reach, 0.5 * reach), 0.25, 3.0) if parameters == 2 else F.lit(1.0)
        items = cut_round(step.select(*ITEM, difficulty.alias("difficulty"), discrimination.alias("discrimination")), k)
    return learners.withColumn("ability", F.col("ability") - centre), items.withColumn("difficulty", F.col("difficulty") - centre)


def predict(learners: DataFrame, items: DataFrame, test: DataFrame) -> DataFrame:
    """Unknown learners have ability 0; unknown items a probability of one half."""
    rows = test.join(learners, list(LEARNER), "left").join(items, list(ITEM), "left")
    p = 1 / (1 + F.exp(-F.col("discrimination") * (F.coalesce("ability", F.lit(0.0)) - F.col("difficulty"))))
    return rows.withColumn("probability", F.coalesce(p, F.lit(0.5)))


def support(rows: DataFrame, learners: DataFrame, items: DataFrame, penalty: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Learners with ``precision``, and items with ``n``, ``information``, ``standard_error`` (by curvature, all else given) and ``unstable``."""
    p = 1 / (1 + F.exp(-F.col("discrimination") * (F.col("ability") - F.col("difficulty"))))
    both = rows.join(learners, list(LEARNER)).join(items, list(ITEM)).withColumn("known", F.col("n") * F.col("discrimination") ** 2 * p * (1 - p))
    precise = both.groupBy(*LEARNER, "ability").agg((F.sum("known") + penalty).alias("precision"))
    each = both.groupBy(*ITEM, "difficulty", "discrimination").agg(F.sum("n").alias("n"), F.sum("known").alias("information"))
    unstable = (F.col("information") < 5) | (F.abs("difficulty") > 5.9)
    return precise, each.withColumn("standard_error", 1 / F.sqrt(F.col("information") + penalty)).withColumn("unstable", unstable)


def moved(ability: float, precision: float, right: bool, difficulty: float, discrimination: float) -> tuple[float, float]:
    """Ability and precision after an answer: a step of the residual over the curvature so far."""
    p = 1 / (1 + exp(-discrimination * (ability - difficulty)))
    precision += discrimination**2 * p * (1 - p)
    return min(6.0, max(-6.0, ability + discrimination * (int(right) - p) / precision)), precision


def predict_online(learners: DataFrame, items: DataFrame, attempts: DataFrame, penalty: float = 0.1) -> DataFrame:
    """Attempts with ``probability`` by abilities that go on from the fit's: a unit is predicted before its answers move them.

    ``learners`` has ``precision`` (:func:`support`); unknown ones begin at 0 with the penalty's.
    Answers to unknown items move nothing. Abilities go on within an order domain, as none
    orders two. A domain's rows stream through one task in order; only its state is held.
    """
    rows = units(attempts).select(*DOMAIN, "pos", "unit", "event_id", "question_id", "correct")
    rows = rows.join(learners.select(*LEARNER, "ability", "precision"), list(LEARNER), "left").join(items.select(*ITEM, "difficulty", "discrimination"), list(ITEM), "left")
    rows = rows.select(*DOMAIN, "pos", "unit", "event_id", "correct", F.coalesce("ability", F.lit(0.0)).alias("ability"), F.coalesce("precision", F.lit(float(penalty))).alias("precision"), "difficulty", "discrimination")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain = unit = None
        now = held = (0.0, penalty)
        for b in batches:
            out = []
            for r in b.to_pylist():
                own = tuple(r[c] for c in DOMAIN)
                if own != domain:
                    domain, unit, now = own, None, (r["ability"], r["precision"])
                if r["unit"] != unit:
                    unit, held = r["unit"], now
                known = r["difficulty"] is not None
                out.append(1 / (1 + exp(-r["discrimination"] * (held[0] - r["difficulty"]))) if known else 0.5)
                if known:
                    now = moved(*now, r["correct"], r["difficulty"], r["discrimination"])
            yield pa.RecordBatch.from_arrays([b.column("source_namespace"), b.column("event_id"), pa.array(out, pa.float64())], names=["source_namespace", "event_id", "probability"])

    made = rows.repartition(*DOMAIN).sortWithinPartitions(*DOMAIN, "pos").mapInArrow(run, "source_namespace string, event_id string, probability double")
    return attempts.join(made, ["source_namespace", "event_id"])
