"""Measures of predicted probabilities. Predictions have ``correct``, ``probability`` and what groups them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clipped, log_loss, order_domain, wilson

#: Buckets that ranks are summed in, so that no task orders all predictions.
RANK_BUCKETS = 4096


def scored(predictions: DataFrame) -> DataFrame:
    p = clipped(F.col("probability"))
    hit = F.col("correct").cast("int")
    return predictions.withColumn("p", p).withColumn("y", hit).withColumn("loss", log_loss(F.col("correct"), F.col("probability"))).withColumn("square", (p - hit) ** 2).withColumn("right", ((p >= 0.5) == F.col("correct")).cast("int"))


def calibration_bins(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """A row for each of ``bins`` equal bins, empty ones too (their means and bounds are null)."""
    if not 2 <= bins <= 100:
        raise ValueError("bins must be 2 to 100")
    rows = scored(predictions).withColumn("bin", F.least(F.floor(F.col("p") * F.lit(float(bins))).cast("int"), F.lit(bins - 1)))
    found = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("successes"), F.avg("p").alias("prediction"))
    every = predictions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("successes", F.lit(0)).alias("successes"), "prediction")
    return out.select("*", *[c.alias(k) for k, c in wilson(F.col("successes"), F.col("n")).items()])


def calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """One row: ``ece``, the mean gap between predicted and observed rates of the bins, by their sizes."""
    rows = calibration_bins(predictions, bins).where("n > 0")
    return rows.agg((F.sum(F.col("n") * F.abs(F.col("prediction") - F.col("estimate"))) / F.sum("n")).alias("ece"))


def auroc(predictions: DataFrame, *keys: str) -> DataFrame:
    """The area under the ROC curve, ties counting half, of each group; null where a class is missing."""
    return _area(scored(predictions).groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), *keys)


def _area(values: DataFrame, *keys: str) -> DataFrame:
    """:func:`auroc` of the positives and negatives (``pos``, ``neg``) at each probability ``p``."""
    values = values.withColumn("bucket", F.floor(F.col("p") * RANK_BUCKETS))
    whole = values.groupBy(*keys, "bucket").agg(F.sum("neg").alias("neg"))
    whole = whole.withColumn("below", F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys, "bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("inside", inside).join(whole.drop("neg"), [*keys, "bucket"])
    pairs = F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.lit(0.5) * F.col("neg")))
    out = values.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), pairs.alias("pairs"))
    return out.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("pairs") / (F.col("pos") * F.col("neg"))).alias("auroc"))


def metric_summary(predictions: DataFrame, *keys: str) -> DataFrame:
    """Number, positives, log loss, Brier score, AUROC and accuracy with bounds, of each group."""
    rows = scored(predictions)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.avg("y").alias("class_balance"), F.avg("loss").alias("log_loss"), F.avg("square").alias("brier"), F.sum("right").alias("right"))
    out = out.select("*", *[c.alias("accuracy" if k == "estimate" else f"accuracy_{k}") for k, c in wilson(F.col("right"), F.col("n")).items()]).drop("right")
    area = auroc(predictions, *keys)
    return out.join(area, list(keys), "left") if keys else out.withColumn("one", F.lit(1)).join(area.withColumn("one", F.lit(1)), "one", "left").drop("one")


def slices(predictions: DataFrame, train: DataFrame) -> DataFrame:
    """:func:`metric_summary` of parts of the predictions, by ``slice`` and ``value``.

    ``learner`` and ``item`` are cold or warm, as train lacks or has the order domain or the
    question; ``untagged`` has attempts without skills; ``skill`` and ``each_learner`` have a
    row for each. A part without predictions has no row.
    """
    domain, item = ["source_namespace", "learner_id", "domain"], ["source_namespace", "question_id"]
    known = train.select("source_namespace", "learner_id", order_domain().alias("domain")).distinct().withColumn("__domain", F.lit("warm"))
    asked = train.select(*item).distinct().withColumn("__item", F.lit("warm"))
    rows = predictions.withColumn("domain", order_domain()).join(known, domain, "left").join(asked, item, "left")
    part = lambda name, value: F.struct(F.lit(name).alias("slice"), value.alias("value"))
    warm = lambda c: F.coalesce(F.col(c), F.lit("cold"))
    tags = F.when(F.size("skills") > 0, F.transform(F.array_distinct("skills"), lambda s: part("skill", s))).otherwise(F.array(part("untagged", F.lit(""))))
    own = F.array(part("learner", warm("__domain")), part("item", warm("__item")), part("each_learner", F.col("learner_id")))
    rows = rows.select("correct", "probability", F.explode(F.concat(own, tags)).alias("of"))
    return metric_summary(rows.select("correct", "probability", "of.slice", "of.value"), "slice", "value")


def cluster_sums(predictions: DataFrame, cluster: str = "learner_id") -> DataFrame:
    """Sums of each cluster, all that the bootstrap needs."""
    return scored(predictions).groupBy(cluster).agg(F.count("*").alias("n"), F.sum("loss").alias("loss"), F.sum("square").alias("square"), F.sum("right").alias("right"), F.sum(F.col("y") - F.col("p")).alias("residual"))


def bootstrap(sums: DataFrame, columns: tuple[str, ...] = ("loss", "square", "right"), repetitions: int = 200, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals of means over clusters drawn with replacement.

    Every draw gives each cluster a Poisson(1) weight by a keyed hash of the draw and the
    cluster. A task adds up the weighted sums of all draws as it reads its clusters, and gives
    one row; no cluster comes to the driver, and none is repeated for a draw.
    """
    _asked(repetitions, confidence)
    names = ["n", *columns]
    rows = sums.select(*[F.col(c).cast("double").alias(c) for c in names], drawn(sums.columns[0], repetitions, seed).alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((repetitions, len(names)))
        for b in batches:
            weights = _matrix(b.column("weights"), repetitions)
            total += weights.T @ np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([list(range(repetitions))], pa.list_(pa.int32())), *[pa.array([total[:, k]], pa.list_(pa.float64())) for k in range(len(names))]], names=["draw", *names])

    added = rows.mapInArrow(run, "draw array<int>, " + ", ".join(f"{c} array<double>" for c in names))
    each = added.select(F.inline(F.arrays_zip("draw", *names))).groupBy("draw").agg(*[F.sum(c).alias(c) for c in names])
    means = each.select(*[F.try_divide(c, "n").alias(c) for c in columns])
    tail = (1 - confidence) / 2
    return means.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{side}") for c in columns for side, q in (("lower", tail), ("upper", 1 - tail))])


def _asked(repetitions: int, confidence: float) -> None:
    if not 20 <= repetitions <= 5000 or not 0 < confidence < 1:
        raise ValueError("repetitions must be 20 to 5000 and confidence within 0 and 1")


def drawn(key: str, repetitions: int, seed: int) -> Column:
    """A cluster's Poisson(1) weights in all draws, as bytes: the values below which a hash leaves each weight."""
    total, term, marks = 0.0, float(np.exp(-1.0)), []
    for k in range(12):
        total += term
        marks.append(total)
        term /= k + 1

    def weight(draw: Column) -> Column:
        uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), draw, F.col(key)), 11).cast("double") / F.lit(float(1 << 53))
        return sum((F.when(uniform >= F.lit(mark), 1).otherwise(0) for mark in marks), F.lit(0)).cast("tinyint")

    return F.transform(F.sequence(F.lit(0), F.lit(repetitions - 1)), weight)


def _matrix(weights: pa.ListArray, repetitions: int) -> np.ndarray:
    return weights.flatten().to_numpy(zero_copy_only=False).reshape(-1, repetitions).astype(float)


def auroc_interval(predictions: DataFrame, cluster: str = "learner_id", repetitions: int = 200, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """One row: percentile bounds of the area over clusters drawn as :func:`bootstrap` draws them, and how many draws had both classes.

    Predictions are added up by cluster and probability and dealt out by range of probability,
    so that a task's rows lie between those of its neighbours. It adds up all draws at once,
    and gives its first and its last probability apart, which neighbours may share, and what
    lies between as one: three rows a task, which are put together in order.
    """
    _asked(repetitions, confidence)
    sums = scored(predictions).groupBy(cluster, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    rows = sums.repartitionByRange("p", cluster).sortWithinPartitions("p", cluster).select("p", "pos", "neg", drawn(cluster, repetitions, seed).alias("weights"))
    kind = "low double, high double, pos array<double>, neg array<double>, area array<double>"

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of equal probability; those but the first and last in one."""
        runs = _equal_runs(batches, repetitions)
        first = next(runs, None)
        if first is None:
            return
        yield _range_row(*first)
        between, last = None, None
        for run in runs:
            if last is not None:
                between = _joined(between, last)
            last = run
        for row in (between, last):
            if row is not None:
                yield _range_row(*row)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tie = None
        for b in batches:
            for r in b.to_pylist():
                row = (r["low"], r["high"], *(np.array(r[k]) for k in ("pos", "neg", "area")))
                if tie is not None and tie[0] == tie[1] == row[0] == row[1]:
                    pos, neg = tie[2] + row[2], tie[3] + row[3]
                    tie = (*row[:2], pos, neg, pos * neg / 2)
                    continue
                whole = tie if whole is None else _joined(whole, tie)
                tie = row
        if tie is not None:
            whole = tie if whole is None else _joined(whole, tie)
            pairs = whole[2] * whole[3]
            areas = [a / n if n > 0 else None for a, n in zip(whole[4].tolist(), pairs.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(areas, pa.float64())], names=["auroc"])

    parts = rows.mapInArrow(added, kind).repartition(1).sortWithinPartitions("low", "high")
    values, tail = parts.mapInArrow(put_together, "auroc double"), (1 - confidence) / 2
    return values.agg(F.percentile("auroc", F.lit(tail)).alias("auroc_lower"), F.percentile("auroc", F.lit(1 - tail)).alias("auroc_upper"), F.count("auroc").alias("eligible_draws"))


def _joined(a: tuple | None, b: tuple) -> tuple:
    """Two neighbouring ranges of probability as one: positives of the upper beat negatives of the lower."""
    return b if a is None else (a[0], b[1], a[2] + b[2], a[3] + b[3], a[4] + b[4] + b[2] * a[3])


def _range_row(low: float, high: float, pos: np.ndarray, neg: np.ndarray, area: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([low]), pa.array([high]), *[pa.array([x], pa.list_(pa.float64())) for x in (pos, neg, area)]], names=["low", "high", "pos", "neg", "area"])


def _equal_runs(batches: Iterator[pa.RecordBatch], repetitions: int) -> Iterator[tuple]:
    """Of rows in order of probability each run of equal ones, over the batches' bounds: positives and negatives of all draws."""
    open_: tuple | None = None
    for b in batches:
        p = b.column("p").to_numpy(zero_copy_only=False)
        if not len(p):
            continue
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        weights = _matrix(b.column("weights"), repetitions)
        pos, neg = (np.add.reduceat(weights * b.column(k).to_numpy(zero_copy_only=False)[:, None], starts, axis=0) for k in ("pos", "neg"))
        for k, at in enumerate(starts.tolist()):
            run = (float(p[at]), float(p[at]), pos[k], neg[k], pos[k] * neg[k] / 2)
            if open_ is not None and open_[0] == run[0]:
                run = (*run[:2], open_[2] + run[2], open_[3] + run[3], (open_[2] + run[2]) * (open_[3] + run[3]) / 2)
            elif open_ is not None:
                yield open_
            open_ = run
    if open_ is not None:
        yield open_


def residual_interval(predictions: DataFrame, cluster: str = "learner_id", repetitions: int = 200, seed: int = 0) -> DataFrame:
    """One row: bounds of the mean of outcome less prediction over clusters drawn with replacement, and ``clusters``; null for fewer than two."""
    sums = cluster_sums(predictions, cluster)
    bounds = bootstrap(sums, ("residual",), repetitions, seed)
    clusters = sums.count()
    return bounds.select(F.lit(clusters).alias("clusters"), *[F.when(F.lit(clusters > 1), F.col(c)).alias(c) for c in bounds.columns])


def paired_sums(a: DataFrame, b: DataFrame, cluster: str = "learner_id") -> DataFrame:
    """Per cluster the sum of differences in log loss of two models on the same attempts; fails if attempts differ."""
    key = ["source_namespace", "event_id"]
    left = scored(a).select(*key, cluster, "correct", F.col("loss").alias("a"))
    right = scored(b).select(*key, F.col("correct").alias("other"), F.col("loss").alias("b"))
    both = left.join(right, key, "full")
    unlike = both.where("a is null or b is null or correct <> other").limit(1).count()
    if unlike:
        raise ValueError("the predictions are of different attempts")
    return both.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(F.col("a") - F.col("b")).alias("difference"))


def residuals(predictions: DataFrame) -> DataFrame:
    p = F.col("p")
    return scored(predictions).agg(
        F.count("*").alias("n"),
        F.avg(F.col("y") - p).alias("mean_residual"),
        F.avg(F.abs(F.col("y") - p)).alias("mean_absolute_residual"),
        F.count_if(p < 0.01).alias("below_01"),
        F.count_if(p > 0.99).alias("above_99"),
        F.count_if(((p > 0.99) & (F.col("y") == 0)) | ((p < 0.01) & (F.col("y") == 1))).alias("high_confidence_errors"),
    )


def sequence_errors(predictions: DataFrame, order: list, bins: int = 10) -> DataFrame:
    """Mean outcome, prediction and Brier score by relative place in a learner's predictions."""
    w = Window.partitionBy("source_namespace", "learner_id")
    rows = scored(predictions).withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.count("*").over(w))
    rows = rows.withColumn("bin", F.least(F.floor(F.col("pos").cast("double") / F.col("size") * bins).cast("int"), F.lit(bins - 1)))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("observed"), F.avg("p").alias("predicted"), F.avg("square").alias("brier"))


def distribution_shift(train: DataFrame, test: DataFrame, dimension: str) -> DataFrame:
    """One row: Jensen-Shannon distance (base 2) of a category's shares, and rows of categories that train lacks."""
    a, b = train.groupBy(dimension).agg(F.count("*").alias("a")), test.groupBy(dimension).agg(F.count("*").alias("b"))
    both = a.join(b, dimension, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    sums = both.agg(F.sum("a"), F.sum("b")).first()
    n, m = (float(sums[0] or 0), float(sums[1] or 0))
    if not n or not m:
        raise ValueError("both sides must have rows")
    p, q = F.col("a") / n, F.col("b") / m
    mid = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    return both.agg(
        F.sqrt(F.greatest(F.lit(0.0), F.sum(part(p) + part(q)) / 2)).alias("distance"),
        F.count_if(F.col("a") > 0).alias("train_categories"),
        F.count_if(F.col("b") > 0).alias("test_categories"),
        F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)).alias("unseen_rows"),
        (F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)) / m).alias("unseen_share"),
    )


def learning_curve(predictions: DataFrame, prior: str = "past_attempts", width: int = 25) -> DataFrame:
    """Number, mean log loss and accuracy by how much history came before."""
    rows = scored(predictions).withColumn("bucket", (F.floor(F.col(prior) / width) * width).cast("long"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("loss").alias("log_loss"), F.avg("right").alias("accuracy"))
