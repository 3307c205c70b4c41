"""The attempt table: its columns, and the words that its coded columns may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = "attempt/1"
#: Fixed values of the coded columns.
ATTEMPT_KINDS = ("practice", "assessment", "review", "unknown")
ORDER_SCOPES = ("learner", "question")
TIME_SEMANTICS = ("real", "shifted", "unknown")
DURATION_SCOPES = ("event", "bundle", "unknown")
IDENTIFIER_LENGTH = 512

ATTEMPTS = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("source_namespace", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("learner_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("correct", T.BooleanType()),
        T.StructField("attempt_kind", T.StringType()),
        T.StructField("source_sequence", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("bundle_id", T.StringType()),
        T.StructField("order_scope", T.StringType()),
        T.StructField("time_semantics", T.StringType()),
        T.StructField("duration_scope", T.StringType()),
        T.StructField("provenance", T.StringType()),
        T.StructField("identity", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)
#: What a content hash is made of: all but provenance and the digests.
CONTENT = [f.name for f in ATTEMPTS if f.name not in ("provenance", "identity", "content_hash")]


def no_attempts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ATTEMPTS)


def read_attempts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A dataset's partitions with the fixed schema, so that filters and columns reach the scan; none is an empty table."""
    return spark.read.schema(ATTEMPTS).parquet(*paths) if paths else no_attempts(spark)
