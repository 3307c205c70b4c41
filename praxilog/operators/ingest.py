"""From records to attempts: strict validation, then duplicates and conflicts by identity."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ATTEMPT_KINDS, ATTEMPTS, CONTENT, DURATION_SCOPES, IDENTIFIER_LENGTH, ORDER_SCOPES, TIME_SEMANTICS, VERSION
from ..sources.projection import hashed
from ..sources.readers import POSITION_ONLY, QUALITY

SAMPLES = 50
ARROW = {"array<string>": pa.list_(pa.string()), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "timestamp": pa.timestamp("us", "UTC")}


WORDS = {"attempt_kind": (ATTEMPT_KINDS, "unknown"), "order_scope": (ORDER_SCOPES, "learner"), "time_semantics": (TIME_SEMANTICS, "unknown"), "duration_scope": (DURATION_SCOPES, "unknown")}
FIELDS = {f.name for f in ATTEMPTS} - {"identity", "content_hash"}
#: What a time looks like; its numbers are checked by reading it.
MOMENT = re.compile(r"\d{4}-\d\d-\d\d[Tt _].*(?:[Zz]|[+-]\d\d(?::?\d\d)?)").fullmatch


def identifier(value: object) -> str:
    """Text without white space at its ends, in composed form."""
    if not isinstance(value, str):
        raise ValueError("is no text")
    value = unicodedata.normalize("NFC", value.strip())
    if not 1 <= len(value) <= IDENTIFIER_LENGTH or any(c < " " for c in value) or any("\ud800" <= c <= "\udfff" for c in value):
        raise ValueError("is empty, too long or has control characters")
    return value


def moment(value: object) -> datetime:
    if not isinstance(value, str) or not MOMENT(value):
        raise ValueError("has no zone or isn't a time")
    return datetime.fromisoformat(value.upper().replace("_", " ")).astimezone(UTC)


def number(value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= float(value) < math.inf:
        raise ValueError("is no number from 0")
    return float(value)


def attempt(text: str, namespace: str, learner: str) -> dict[str, object]:
    """The content of one record; a ValueError names the first rule that it breaks."""
    try:
        raw = json.loads(text)
    except (ValueError, RecursionError):
        raise ValueError("not valid JSON") from None
    if not isinstance(raw, dict):
        raise ValueError("not a JSON object")
    quality = raw.pop(QUALITY, "stable")
    if quality not in ("stable", POSITION_ONLY) or not raw.keys() <= FIELDS:
        raise ValueError("unknown field")
    if raw.get("schema_version", VERSION) != VERSION:
        raise ValueError("schema_version is unknown")
    out: dict[str, object] = {"schema_version": VERSION, "quality": quality}
    field = ""
    try:
        for field in ("source_namespace", "event_id", "learner_id", "question_id"):
            out[field] = identifier(raw.get(field, {"source_namespace": namespace, "learner_id": learner}.get(field)))
        for field in ("session_id", "bundle_id"):
            out[field] = None if raw.get(field) is None else identifier(raw[field])
        field = "skills"
        tags = raw.get("skills")
        if not isinstance(tags, list | None):
            raise ValueError("are no list")
        out["skills"] = sorted({identifier(t) for t in tags or ()})
        field = "correct"
        if type(raw.get("correct")) is not bool:
            raise ValueError("is no boolean")
        out["correct"] = raw["correct"]
        field = "source_sequence"
        if type(raw.get("source_sequence")) is not int or not 0 <= raw["source_sequence"] < 1 << 63:
            raise ValueError("is no whole number from 0")
        out["source_sequence"] = raw["source_sequence"]
        field = "timestamp"
        out["timestamp"] = None if raw.get("timestamp") is None else moment(raw["timestamp"])
        field = "duration_ms"
        out["duration_ms"] = None if raw.get("duration_ms") is None else number(raw["duration_ms"])
        for field, (words, default) in WORDS.items():
            out[field] = raw.get(field, default)
            if not isinstance(out[field], str) or out[field] not in words:
                raise ValueError("is none of its words")
    except (ValueError, OverflowError) as e:
        raise ValueError(f"{field} {e}") from None
    for known, words in (("timestamp", "time_semantics"), ("duration_ms", "duration_scope")):
        if out[known] is None and out[words] != "unknown":
            raise ValueError(f"{words} without {known}")
    if out["source_namespace"] != namespace:
        raise ValueError("source_namespace differs from the import's")
    return out


def validated(records: DataFrame, namespace: str = "local", learner: str = "local-learner") -> DataFrame:
    """Records as attempts with digests, ``row``, and ``reason``, the first rule that a record breaks (null for good ones).

    Types are exact: a number is no boolean and text is no number. Times need a zone.
    Identifiers and skills lose white space at their ends and are composed; unknown fields
    are refused; of a field that a record repeats the last counts. Absent namespaces,
    learners and codes have their defaults. ``quality`` tells whether the event's name is
    ``stable`` or only its place (``position_only``). Each record is parsed once, in batches.
    """
    kinds = {f.name: f for f in ATTEMPTS}
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("quality", T.StringType()), *[kinds[c] for c in CONTENT]])
    arrow = pa.schema([("row", pa.int64()), ("reason", pa.string()), ("quality", pa.string()), *[(c, ARROW.get(kinds[c].dataType.simpleString(), pa.string())) for c in CONTENT]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: dict[str, list] = {c: [] for c in arrow.names}
            for row, value, error in zip(b.column("row").to_pylist(), b.column("value").to_pylist(), b.column("error").to_pylist(), strict=True):
                found: dict[str, object] = {"row": row, "reason": error}
                if error is None:
                    try:
                        found |= attempt(value or "", namespace, learner)
                    except ValueError as e:
                        found["reason"] = str(e)
                for c, kept in columns.items():
                    kept.append(found.get(c))
            yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    return hashed(records.select("row", "value", "error").mapInArrow(run, schema))


def classified(attempts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Validated attempts with ``outcome``: accepted, duplicate, conflict or rejected.

    An attempt is compared with the stored one of its identity (``known``: ``identity``,
    ``content_hash``), else with the first good one of the file. Rejected ones take no part.
    """
    good = attempts.where("reason is null")
    rows = good.join(known.select("identity", F.col("content_hash").alias("stored")), "identity", "left") if known is not None else good.withColumn("stored", F.lit(None).cast("string"))
    w = Window.partitionBy("identity").orderBy("row")
    rows = rows.withColumn("first", F.first_value("content_hash").over(w)).withColumn("nth", F.row_number().over(w))
    outcome = F.when(F.col("stored").isNotNull(), F.when(F.col("stored") == F.col("content_hash"), "duplicate").otherwise("conflict")).when(F.col("nth") == 1, "accepted").when(F.col("first") == F.col("content_hash"), "duplicate").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("stored", "first", "nth").unionByName(attempts.where("reason is not null").withColumn("outcome", F.lit("rejected")))


def import_counts(rows: DataFrame) -> DataFrame:
    """One row: what an import received and how it was judged, with what good attempts leave unknown."""
    is_ = lambda k: F.count_if(F.col("outcome") == k)
    good = F.col("outcome") == "accepted"
    return rows.agg(
        F.count("*").alias("received"), is_("accepted").alias("accepted"), is_("duplicate").alias("duplicates"), is_("conflict").alias("conflicts"), is_("rejected").alias("rejected"),
        F.count_if(good & F.col("timestamp").isNull()).alias("no_timestamp"), F.count_if(good & F.col("duration_ms").isNull()).alias("no_duration"), F.count_if(good & F.col("session_id").isNull()).alias("no_session"),
        F.count_if(good & (F.size("skills") == 0)).alias("no_skills"), F.count_if(good & (F.col("time_semantics") == "shifted")).alias("shifted"),
        F.count_if(good & (F.col("order_scope") == "question")).alias("question_only"), F.count_if(good & (F.col("duration_scope") == "bundle")).alias("bundle_duration"),
        F.count_if(good & (F.col("quality") == POSITION_ONLY)).alias("position_only"),
    )


def quarantine(rows: DataFrame) -> DataFrame:
    """Rejected and conflicting records with their reasons."""
    return rows.where(F.col("outcome").isin("rejected", "conflict")).select(F.col("outcome").alias("category"), "row", F.coalesce(F.left("reason", F.lit(2000)), F.lit("differs from the first attempt of its identity")).alias("reason"), F.when(F.col("outcome") == "conflict", F.col("identity")).alias("identity"))
