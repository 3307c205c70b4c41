"""Attempts projected from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import identity_hash
from ..schema import CONTENT, VERSION


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``identity`` (of source and event) and ``content_hash`` (of all but where it came from)."""
    content = F.sha2(F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"}), 256)
    return rows.withColumn("identity", identity_hash(F.col("source_namespace"), F.col("event_id"))).withColumn("content_hash", content)


def attempts_from_events(events: DataFrame, shifted: bool = False) -> DataFrame:
    """Practice attempts from the ``events`` stream table.

    ``shifted`` moves times back by up to 30 hours, so that they contradict the source order.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select("*", k.alias("k"))
    moved = F.expr("CASE k % 3 WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 30 HOUR END")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    failed = F.col("event_type") == "error"
    s, t = F.concat(F.lit("s"), F.col("k") % 5), F.concat(F.lit("t"), F.col("k") % 3)
    return e.select(
        F.lit(VERSION).alias("schema_version"),
        F.lit("testdata").alias("source_namespace"),
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("learner_id"),
        F.concat(F.lit("q"), F.col("k")).alias("question_id"),
        F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).when(F.col("k") % 4 == 1, F.array(s)).otherwise(F.array(s, t)).alias("skills"),
        F.col("event_type").isin("click", "purchase", "view").alias("correct"),
        F.when(F.col("k") % 3 == 0, "practice").when(F.col("k") % 3 == 1, "review").otherwise("unknown").alias("attempt_kind"),
        F.col("event_id").cast("long").alias("source_sequence"),
        F.when(F.col("k") % 10 != 7, hour - moved if shifted else hour).alias("timestamp"),
        F.when(~failed, F.col("value") * 1000).alias("duration_ms"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("d"), F.dayofmonth("ts"))).alias("session_id"),
        F.concat(F.lit("b"), F.col("k") % 6).alias("bundle_id"),
        F.when(F.col("user_id") % 7 == 0, "question").otherwise("learner").alias("order_scope"),
        F.when(F.col("k") % 10 == 7, "unknown").when(F.col("user_id") % 5 == 0, "shifted").otherwise("real").alias("time_semantics"),
        F.when(failed, "unknown").when(F.col("k") % 2 == 0, "bundle").otherwise("event").alias("duration_scope"),
        F.lit(None).cast("string").alias("provenance"),
    )
