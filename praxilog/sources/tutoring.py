"""Tutoring logs: one CSV file a learner, and a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..schema import VERSION

QUESTIONS = "question_id string, bundle_id string, explanation_id string, correct_answer string, part string, tags string, deployed_at string"
LOG = "timestamp long, solving_id string, question_id string, user_answer string, elapsed_time double"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``question_id``, ``bundle_id``, ``answer`` (a to d) and sorted ``skills``; a question listed twice or without answer raises."""
    rows = spark.read.csv(path, header=True)
    tags = F.filter(F.transform(F.split("tags", ";"), lambda t: F.trim(t)), lambda t: (t != "-1") & (t != ""))
    rows = rows.select("question_id", "bundle_id", F.lower(F.trim("correct_answer")).alias("answer"), F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.concat(F.lit("ednet:"), t)))).alias("skills"))
    bad = rows.groupBy("question_id").agg(F.count("*").alias("n"), F.max(F.col("answer").isin("a", "b", "c", "d")).alias("good")).where("n > 1 or not good or good is null or question_id is null")
    if bad.limit(1).count():
        raise ValueError("questions must be unique and have an answer from a to d")
    return rows


def logs(spark: SparkSession, path: str) -> DataFrame:
    """All learners' rows: a file ``u<number>.csv`` each, ``row`` being the order within it by time."""
    rows = spark.read.schema(LOG).csv(path, header=True).withColumn("learner_id", F.regexp_extract(F.input_file_name(), r"(u\d+)\.csv", 1)).where("learner_id <> ''")
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("learner_id").orderBy("timestamp", "solving_id", "question_id")) - 1)


def attempts_from_logs(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Attempts of known questions with an answer from a to d; times are shifted ones, durations are of bundles."""
    both = rows.join(table, "question_id").where(F.lower("user_answer").isin("a", "b", "c", "d"))
    return both.select(
        F.lit(VERSION).alias("schema_version"), F.lit("tutoring").alias("source_namespace"), F.concat_ws(":", "learner_id", "row").alias("event_id"), "learner_id", "question_id", "skills",
        (F.lower("user_answer") == F.col("answer")).alias("correct"), F.lit("practice").alias("attempt_kind"), F.col("row").cast("long").alias("source_sequence"), F.timestamp_millis("timestamp").alias("timestamp"),
        F.col("elapsed_time").alias("duration_ms"), F.col("solving_id").alias("session_id"), "bundle_id", F.lit("learner").alias("order_scope"), F.lit("shifted").alias("time_semantics"),
        F.when(F.col("elapsed_time").isNull(), "unknown").otherwise("bundle").alias("duration_scope"),
    )


def whole_learners(attempts: DataFrame, interactions: int, learners: int, sessions: int = 5, seed: int = 0) -> DataFrame:
    """Whole learners with enough sessions, in a seeded order, until both numbers are reached."""
    each = attempts.groupBy("learner_id").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions")).where(F.col("sessions") >= sessions)
    each = ranked(each.withColumn("key", F.xxhash64(F.lit(seed), "learner_id")), "key", "n")
    chosen = each.where((F.col("before") < interactions) | (F.col("rank") < learners)).select("learner_id")
    return attempts.join(chosen, "learner_id", "left_semi")
