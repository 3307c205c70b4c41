"""Integrity of a dataset: counts, ties, inversions, ambiguous order; and adjacent windows for drift."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import order_domain, wilson
from .metrics import calibration_bins


def integrity_counts(attempts: DataFrame) -> DataFrame:
    return attempts.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("source_namespace", "event_id").alias("unique_identities"),
        F.count("timestamp").alias("known_timestamps"),
        F.count_if(F.col("timestamp").isNull()).alias("unknown_timestamps"),
        F.count_if(F.col("time_semantics") == "shifted").alias("shifted_timestamps"),
        F.count_if((F.col("duration_scope") == "bundle") & (F.col("session_id").isNull() | F.col("bundle_id").isNull())).alias("bundle_duration_without_identity"),
    )


def _surplus(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def timestamp_ties(attempts: DataFrame) -> DataFrame:
    """Attempts beyond the first of each learner's moment."""
    return _surplus(attempts.where("timestamp is not null"), "source_namespace", "learner_id", "timestamp").withColumnRenamed("surplus", "timestamp_ties")


def ambiguous_sequences(attempts: DataFrame) -> DataFrame:
    """Attempts beyond the first of each place in a source's order."""
    rows = attempts.withColumn("domain", order_domain())
    return _surplus(rows, "source_namespace", "learner_id", "domain", "source_sequence").withColumnRenamed("surplus", "ambiguous_source_sequences")


def multi_bundle_sessions(attempts: DataFrame) -> DataFrame:
    each = attempts.where("session_id is not null").groupBy("source_namespace", "learner_id", "session_id").agg(F.count_distinct("bundle_id").alias("bundles"))
    return each.agg(F.count_if(F.col("bundles") > 1).alias("sessions_with_multiple_bundles"))


def time_inversions(attempts: DataFrame) -> DataFrame:
    """Attempts whose time is before that of the attempt before them in source order."""
    w = Window.partitionBy("source_namespace", "learner_id", "domain").orderBy(F.col("source_sequence").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    rows = attempts.withColumn("domain", order_domain()).withColumn("previous", F.lag("timestamp").over(w))
    return rows.agg(F.count_if(F.col("timestamp") < F.col("previous")).alias("source_order_timestamp_inversions"))


def drift_windows(attempts: DataFrame, learner: str, window: int = 100) -> DataFrame:
    """A learner's last two windows of attempts, ``part`` reference or current. Unknown times count as the oldest."""
    rows = attempts.where(F.col("learner_id") == learner)
    last = Window.partitionBy("learner_id").orderBy(F.col("timestamp").desc_nulls_last(), F.desc("source_sequence"), F.desc("event_id"))
    rows = rows.withColumn("back", F.row_number().over(last)).where(F.col("back") <= 2 * window)
    return rows.withColumn("part", F.when(F.col("back") <= window, "current").otherwise("reference"))


def drift_counts(windows: DataFrame) -> DataFrame:
    """A row for each window: attempts, right ones, what is missing, and items; ``unseen`` in the current one."""
    seen = F.max(F.when(F.col("part") == "reference", 1)).over(Window.partitionBy("question_id"))
    rows = windows.withColumn("seen", F.coalesce(seen, F.lit(0)))
    return rows.groupBy("part").agg(
        F.count("*").alias("n"),
        F.sum(F.col("correct").cast("int")).alias("successes"),
        F.count_if(F.col("timestamp").isNull()).alias("no_timestamp"),
        F.count_if(F.col("duration_ms").isNull()).alias("no_duration"),
        F.count_if(F.col("session_id").isNull()).alias("no_session"),
        F.count_distinct("question_id").alias("items"),
        F.count_if(F.col("seen") == 0).alias("unseen"),
    )


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2 x 2 table: tables of the same margins that are at most as likely."""
    n, row, col = a + b + c + d, a + b, a + c
    log = math.lgamma
    choose = lambda x, k: log(x + 1) - log(k + 1) - log(x - k + 1)
    total = choose(n, col)
    weight = [math.exp(choose(row, k) + choose(n - row, col - k) - total) for k in range(max(0, col - (n - row)), min(row, col) + 1)]
    own = weight[a - max(0, col - (n - row))]
    return min(1.0, sum(w for w in weight if w <= own * (1 + 1e-7)))


def bounded_counts(windows: DataFrame) -> DataFrame:
    """:func:`drift_counts` with the share and bounds of each count as a struct ``<count>_share``."""
    rows = drift_counts(windows)
    share = lambda k: F.struct(*[c.alias(name) for name, c in wilson(F.col(k), F.col("n")).items()]).alias(f"{k}_share")
    return rows.select("*", *[share(k) for k in ("successes", "no_timestamp", "no_duration", "no_session", "unseen")])


def predicted_windows(windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """The windows' attempts with ``probability``, null where ``predictions`` have none."""
    key = ["source_namespace", "event_id"]
    return windows.drop("probability").join(predictions.select(*key, "probability"), key, "left")


def window_calibration(windows: DataFrame, predictions: DataFrame) -> DataFrame | None:
    """Calibration bins of each ``part``; None unless every attempt of both windows is predicted."""
    rows = predicted_windows(windows, predictions)
    if rows.where("probability is null").limit(1).count():
        return None
    of = lambda part: calibration_bins(rows.where(F.col("part") == part)).withColumn("part", F.lit(part))
    return of("reference").unionByName(of("current"))


def drift_report(attempts: DataFrame, learner: str, window: int = 100, minimum: int = 50, effect: float = 0.1, missing: float = 0.1, coverage: float = 0.25, seed: int = 2026, draws: int = 10_000, predictions: DataFrame | None = None) -> dict:
    """Whether accuracy, missing values or items differ between a learner's last two windows, with alerts.

    Needs one order domain and enough attempts in both windows, else it is unavailable.
    ``predictions`` of all attempts of both windows add each window's calibration.
    """
    if not 30 <= minimum <= window <= 10_000 or not all(0 < x < 1 for x in (effect, missing, coverage)):
        raise ValueError("windows must hold at least 30 attempts and effects be within 0 and 1")
    own = attempts.where(F.col("learner_id") == learner)
    if own.select("source_namespace", order_domain()).distinct().limit(2).count() != 1:
        return {"available": False, "reason": "one order domain is needed"}
    windows = drift_windows(attempts, learner, window)
    counts = {r["part"]: r.asDict(recursive=True) for r in bounded_counts(windows).collect()}
    a, b = counts.get("reference", {"n": 0}), counts.get("current", {"n": 0})
    if min(a["n"], b["n"]) < minimum:
        return {"available": False, "reason": "too few attempts", "reference_n": a["n"], "current_n": b["n"]}
    rng = np.random.default_rng(seed)
    gap = rng.beta(b["successes"] + 1, b["n"] - b["successes"] + 1, draws) - rng.beta(a["successes"] + 1, a["n"] - a["successes"] + 1, draws)
    low, high = np.quantile(gap, [0.025, 0.975]).tolist()
    difference = b["successes"] / b["n"] - a["successes"] / a["n"]
    lost = {k: b[k] / b["n"] - a[k] / a["n"] for k in ("no_timestamp", "no_duration", "no_session")}
    bins = window_calibration(windows, predictions) if predictions is not None else None
    calibration = None if bins is None else {p: [r.asDict() for r in bins.where(F.col("part") == p).orderBy("bin").collect()] for p in ("reference", "current")}
    return {
        "available": True,
        "difference": difference,
        "interval": [low, high],
        "p_value": fisher_two_sided(a["successes"], a["n"] - a["successes"], b["successes"], b["n"] - b["successes"]),
        "response_alert": abs(difference) >= effect and (low > 0 or high < 0),
        "reference": a["successes_share"],
        "current": b["successes_share"],
        "missingness": {k: {"reference": a[f"{k}_share"], "current": b[f"{k}_share"], "difference": v, "alert": abs(v) >= missing} for k, v in lost.items()},
        "unseen_share": b["unseen"] / b["n"],
        "unseen": b["unseen_share"],
        "calibration": calibration,
        "coverage_alert": b["unseen"] / b["n"] >= coverage,
    }


def drift_table(attempts: DataFrame, learner: str, window: int = 100) -> DataFrame:
    """:func:`drift_counts` with accuracy and its bounds."""
    rows = drift_counts(drift_windows(attempts, learner, window))
    return rows.select("*", *[c.alias(k) for k, c in wilson(F.col("successes"), F.col("n")).items()])
