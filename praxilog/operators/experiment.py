"""Experiments: fit on train, calibrate on validation, measure on test, for several models of the same split.

A published experiment keeps its predictions, measures and split as one artifact, with the
dataset and a digest of the split, by which comparisons tell what may be paired.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..models import baselines, bkt, hierarchical, irt, logistic
from ..plans import artifacts
from . import metrics, splits, units

KEY = ["source_namespace", "event_id"]
#: Strengths of the logistic model that validation chooses from.
STRENGTHS = (0.1, 1.0, 10.0)
MODELS = ("global", "item_prior", "recent", "hierarchical", "logistic", "bkt", "irt1", "irt2")
#: What models lose without a part of them.
ABLATIONS = ("logistic_without_skills", "logistic_without_time", "hierarchical_without_shrinkage", "bkt_forgetting", "bkt_mean_skills")
KEPT = [*KEY, "learner_id", "question_id", "skills", "part", "correct", "probability"]


def _online(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Predictions that state from all earlier attempts gives, for validation and test."""
    return rows.where("part in ('validation', 'test')").join(made.select(*KEY, "probability"), KEY)


def families(attempts: DataFrame) -> dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]]:
    """Models by name: functions of train, of what to predict, and of all parts."""
    spark = attempts.sparkSession

    def history(train: DataFrame, ask: DataFrame, rows: DataFrame, strengths: tuple[float, ...] = STRENGTHS, without: tuple[str, ...] = ()) -> DataFrame:
        features = units.feature_map(rows)
        if without:
            kept = F.map_filter("features", lambda k, _: ~F.exists(F.array(*map(F.lit, without)), lambda p: F.startswith(k, p)))
            features = features.withColumn("features", kept)
        known = cut(train.join(features, KEY))
        asked = cut(ask.join(features, KEY))
        models = [logistic.LogisticHistory(c).fit(known) for c in strengths]
        if len(models) > 1:
            losses = [metrics.scored(m.predict(asked.where("part = 'validation'"))).agg(F.avg("loss")).first()[0] for m in models]
            models = [m for _, m in sorted(zip([x if x is not None else 0.0 for x in losses], models, strict=True), key=lambda x: x[0])]
        return models[0].predict(asked)

    def items(train: DataFrame, ask: DataFrame, rows: DataFrame, parameters: int = 1) -> DataFrame:
        own = irt.eligible(irt.responses(train))
        learners, known = irt.fit(own, parameters)
        return _online(rows, irt.predict_online(irt.support(own, learners, known)[0], known, rows.where("part <> 'train'")))

    def tracing(train: DataFrame, ask: DataFrame, rows: DataFrame, forgetting: bool = False, primary: bool = True) -> DataFrame:
        return _online(rows, bkt.predict(rows, bkt.fit(spark, train, forgetting, primary=primary), baselines.rate_of(train), primary))

    return {
        "global": lambda train, ask, rows: baselines.predict_global(train, ask),
        "item_prior": lambda train, ask, rows: baselines.predict_item(train, ask),
        "recent": lambda train, ask, rows: _online(rows, baselines.predict_recent(rows, baselines.rate_of(train))),
        "hierarchical": lambda train, ask, rows: hierarchical.predict(train, ask, "source_namespace", "question_id"),
        "logistic": history,
        "bkt": tracing,
        "irt1": items,
        "irt2": lambda train, ask, rows: items(train, ask, rows, 2),
        "logistic_without_skills": lambda train, ask, rows: history(train, ask, rows, (1.0,), ("skill:", "prior_rate:", "prior_count:", "unknown_skill")),
        "logistic_without_time": lambda train, ask, rows: history(train, ask, rows, (1.0,), ("gap_",)),
        "hierarchical_without_shrinkage": lambda train, ask, rows: hierarchical.predict(train, ask, "source_namespace", "question_id", shrinkage=False),
        "bkt_forgetting": lambda train, ask, rows: tracing(train, ask, rows, True),
        "bkt_mean_skills": lambda train, ask, rows: tracing(train, ask, rows, primary=False),
    }


def run(attempts: DataFrame, models: tuple[str, ...] = MODELS, split: DataFrame | None = None) -> DataFrame:
    """Predictions of validation and test attempts: ``model``, ``part``, ``probability``, ``calibrated`` (by validation).

    ``models`` are of MODELS and ABLATIONS. The logistic model's strength is the one of
    STRENGTHS with the least loss on validation.
    """
    split = splits.forward_split(attempts) if split is None else split
    rows = cut(attempts.join(split.select(*KEY, "part"), KEY).where("part <> 'excluded'"))
    known, out = families(attempts), None
    for name in models:
        made = known[name](rows.where("part = 'train'"), rows.where("part in ('validation', 'test')"), rows).select(*KEPT)
        made = logistic.calibrated(made, *logistic.platt(made.where("part = 'validation'"))).withColumn("model", F.lit(name))
        out = made if out is None else out.unionByName(made)
    return out


def report(predictions: DataFrame) -> DataFrame:
    """Measures of each model on test, raw and calibrated."""
    test = predictions.where("part = 'test'")
    # both kinds of a row at once, so that predictions are not made again for each
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("probability")) for kind, c in (("raw", "probability"), ("calibrated", "calibrated"))])
    return metrics.metric_summary(test.select("model", "correct", F.inline(kinds)), "model", "kind")


def compare(predictions: DataFrame, a: str, b: str, repetitions: int = 200, seed: int = 0) -> DataFrame:
    """Bounds of the difference in log loss of two models on the same test attempts."""
    of = lambda name: predictions.where(f"part = 'test' and model = '{name}'")
    return metrics.bootstrap(metrics.paired_sums(of(a), of(b)), ("difference",), repetitions, seed)


def recomputed(predictions: DataFrame, saved: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Models whose saved measures differ from those of their predictions, or that one side lacks; none for a sound run."""
    now = report(predictions).select("model", "kind", F.col("log_loss").alias("now"))
    return now.join(saved.select("model", "kind", "log_loss"), ["model", "kind"], "full").where("now is null or log_loss is null or abs(now - log_loss) > " + repr(tolerance))


def split_hash(split: DataFrame) -> str:
    """A digest of which attempt is in which part, whatever the order of rows.

    Rows' SHA-256 digests are added up in four 64-bit words, so that a task gives one row.
    """
    row = F.sha2(F.to_json(F.array(*KEY, "part")), 256)
    words = [F.conv(F.substring(row, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = split.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"w{k}") for k, w in enumerate(words)]).first()
    return artifacts.digest([sums["n"], *(int(sums[f"w{k}"]) % (1 << 64) for k in range(4))])


def publish(attempts: DataFrame, root: str, dataset: str, models: tuple[str, ...] = MODELS, split: DataFrame | None = None, configuration: dict[str, Any] | None = None) -> str:
    """Runs an experiment over the attempts of ``dataset`` and keeps it; returns the artifact's id. A split that lacks a part is refused."""
    split = cut((splits.forward_split(attempts) if split is None else split).select(*KEY, "part"))
    parts = {r["part"] for r in split.select("part").distinct().collect()}
    if lacking := {"train", "validation", "test"} - parts:
        raise ValueError(f"the split has no attempts to {sorted(lacking)}")
    predictions = cut(run(attempts, models, split))
    metadata = {"dataset": dataset, "split_hash": split_hash(split), "models": list(models), "configuration": configuration or {}}
    return artifacts.publish(attempts.sparkSession, root, "experiment", {"predictions": predictions, "report": report(predictions), "split": split}, metadata)


def compare_runs(spark: SparkSession, root: str, left: str, right: str, left_model: str, right_model: str, repetitions: int = 200, seed: int = 0) -> dict[str, Any]:
    """Two published experiments' models side by side: ``same_dataset``, ``same_split``, the measures of each, and ``paired``.

    Only runs over the same dataset and split are paired (bounds of the difference in log
    loss); else ``paired`` is None and the measures describe different populations. Artifacts
    that have changed, that are no experiments or that lack the model are refused.
    """
    sides = []
    for own, model in ((left, left_model), (right, right_model)):
        about = artifacts.manifest(spark, root, own)
        if about["kind"] != "experiment" or artifacts.verify(spark, root, own):
            raise ValueError(f"{own} is no sound experiment")
        if model not in about["metadata"]["models"]:
            raise ValueError(f"{own} has no model {model}")
        table = lambda name, own=own: artifacts.load(spark, root, own, name)
        if split_hash(table("split")) != about["metadata"]["split_hash"]:
            raise ValueError(f"the split of {own} is not the one of its digest")
        sides.append((about["metadata"], table("report").where(F.col("model") == model), table("predictions").where((F.col("part") == "test") & (F.col("model") == model))))
    (a, left_report, left_rows), (b, right_report, right_rows) = sides
    same = {"same_dataset": a["dataset"] == b["dataset"], "same_split": a["split_hash"] == b["split_hash"]}
    paired = metrics.bootstrap(metrics.paired_sums(left_rows, right_rows), ("difference",), repetitions, seed) if all(same.values()) else None
    return same | {"left": left_report, "right": right_report, "paired": paired}


def inspect(predictions: DataFrame, model: str, sort: str = "identity", learner: str | None = None, question: str | None = None, offset: int = 0, limit: int = 50, part: str | None = None) -> DataFrame:
    """A page of one model's predictions, of one part or all: by identity, largest error, least certainty or most confidence."""
    rows = predictions.where(F.col("model") == model)
    rows = rows.where(F.col("learner_id") == learner) if learner else rows
    rows = rows.where(F.col("question_id") == question) if question else rows
    rows = rows.where(F.col("part") == part) if part else rows
    error, doubt = F.abs(F.col("correct").cast("int") - F.col("probability")), F.abs(F.col("probability") - 0.5)
    order = {"identity": [], "error": [error.desc()], "uncertain": [doubt], "confidence": [doubt.desc()]}[sort]
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset must not be negative and limit be 1 to 500")
    return rows.withColumn("absolute_error", error).orderBy(*order, *KEY).offset(offset).limit(limit)


def slice_measures(predictions: DataFrame, model: str, learner: str | None = None, skill: str | None = None, calibrated: bool = False) -> DataFrame:
    """Measures of one model's test predictions of a learner, a skill, both or neither; a slice without rows has n 0."""
    rows = predictions.where((F.col("model") == model) & (F.col("part") == "test"))
    rows = rows.where(F.col("learner_id") == learner) if learner else rows
    rows = rows.where(F.array_contains("skills", skill)) if skill else rows
    return metrics.metric_summary(rows.withColumn("probability", F.col("calibrated")) if calibrated else rows)


def replay(attempts: DataFrame, parameters: DataFrame, learner: str) -> DataFrame:
    """One learner's predictions by knowledge tracing in order."""
    own = attempts.where(F.col("learner_id") == learner)
    return units.units(bkt.predict(own, parameters, 0.5)).select("event_id", "question_id", "correct", "domain", "unit", "pos", "probability").orderBy("domain", "pos")
