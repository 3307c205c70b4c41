"""Guards against leakage: which features are allowed, what they may depend on, and which rows a fit may see."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN
from .units import feature_map, units

KEY = ["source_namespace", "event_id"]

# Names and prefixes of allowed features, and the part that each fitted component may see.
FEATURES = ("learner_log_attempts", "learner_rate", "item_log_attempts", "item_rate", "recent_rate", "recent_count", "cold_learner", "cold_item", "unknown_skill", "gap_unknown", "gap_log_seconds")
PREFIXES = ("kind=", "skill:", "prior_rate:", "prior_count:")
SCOPES = {
    "model_parameters": "train",
    "item_priors": "train",
    "hierarchical_prior": "train",
    "feature_vocabulary": "train",
    "feature_scaler": "train",
    "hyperparameter_selection": "validation",
    "probability_calibration": "validation",
}


def unknown_features(rows: DataFrame) -> DataFrame:
    """Names in the maps ``features`` that aren't allowed, with how many rows have them; none for sound ones."""
    name = F.explode(F.map_keys("features")).alias("name")
    allowed = F.col("name").isin(*FEATURES)
    for prefix in PREFIXES:
        allowed = allowed | F.startswith("name", F.lit(prefix))
    return rows.select(name).where(~allowed).groupBy("name").agg(F.count("*").alias("n"))


def late_dependencies(attempts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Of ``dependencies`` (``source_namespace``, ``event_id``, ``depends_on``) those that no feature may have.

    A feature may depend on attempts of earlier units of its own order domain; ``reason`` says
    what else it is: ``no target``, ``unknown``, ``other domain``, ``same unit`` or ``later unit``.
    """
    placed = units(attempts).select(*DOMAIN, "unit", "event_id")
    mine = placed.select(*KEY, F.struct("learner_id", "domain").alias("own"), F.col("unit").alias("own_unit"))
    its = placed.select("source_namespace", F.col("event_id").alias("depends_on"), F.struct("learner_id", "domain").alias("its"), F.col("unit").alias("its_unit"))
    rows = dependencies.join(mine, KEY, "left").join(its, ["source_namespace", "depends_on"], "left")
    reason = (
        F.when(F.col("own").isNull(), "no target").when(F.col("its").isNull(), "unknown").when(F.col("own") != F.col("its"), "other domain")
        .when(F.col("own_unit") == F.col("its_unit"), "same unit").when(F.col("its_unit") > F.col("own_unit"), "later unit")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(*KEY, "depends_on", "reason")


def changed_prefixes(attempts: DataFrame, unit: int, maps: Callable[[DataFrame], DataFrame] = feature_map) -> DataFrame:
    """Attempts of the unit of each domain whose features (``maps`` of attempts) change when all outcomes from that unit on are turned round; none for sound features."""
    placed = units(attempts).select(*KEY, "unit")
    turned = attempts.join(placed, KEY).withColumn("correct", F.when(F.col("unit") >= unit, ~F.col("correct")).otherwise(F.col("correct"))).drop("unit")
    entries = lambda rows, name: maps(rows).select(*KEY, F.array_sort(F.map_entries("features")).alias(name))
    both = entries(attempts, "a").join(entries(turned, "b"), KEY).join(placed.where(F.col("unit") == unit), KEY)
    return both.where(F.col("a") != F.col("b")).select(*KEY)


def fit_scopes(split: DataFrame) -> DataFrame:
    """``component``, ``part`` and each attempt that the component is fitted to."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(p).alias("part")) for c, p in SCOPES.items()]))
    return split.select(*KEY, F.col("part").alias("own"), named.alias("s")).where("own = s.part").select("s.component", "s.part", *KEY)


def scope_digests(scopes: DataFrame) -> DataFrame:
    """A row for each component: its part, ``n``, and ``digest``, which doesn't depend on the order of its attempts."""
    h = lambda seed: F.xxhash64(F.lit(seed), *KEY)
    sums = scopes.groupBy("component", "part").agg(F.count("*").alias("n"), F.sum(h(1).cast("decimal(38,0)")).alias("a"), F.bit_xor(h(2)).alias("b"))
    return sums.select("component", "part", "n", F.sha2(F.to_json(F.struct("part", "n", "a", "b")), 256).alias("digest"))


def scope_faults(scopes: DataFrame, split: DataFrame) -> DataFrame:
    """A row of counts for each component that is required or given, all 0 for sound scopes.

    ``repeated`` attempts, those ``outside`` the component's part, ``missing`` ones of it, and
    ``unasked``, 1 for a component that isn't one of SCOPES.
    """
    given = scopes.groupBy("component", *KEY).agg(F.count("*").alias("times"), F.min("part").alias("low"), F.max("part").alias("high"))
    asked = fit_scopes(split).select("component", *KEY, F.col("part").alias("right"))
    both = given.join(asked, ["component", *KEY], "full")
    wrong = F.col("right").isNull() | (F.col("low") != F.col("right")) | (F.col("high") != F.col("right"))
    counts = both.groupBy("component").agg(
        F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("repeated"),
        F.count_if(F.col("times").isNotNull() & wrong).alias("outside"),
        F.count_if(F.col("times").isNull()).alias("missing"),
    )
    return counts.withColumn("unasked", (~F.col("component").isin(*SCOPES)).cast("int"))
