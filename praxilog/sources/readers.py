"""Readers of attempt files. Each gives records: ``row`` (from 1), ``value`` (JSON text) or ``error``.

A record that can't be read is an error of its own; what breaks a whole file raises.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import csv_unguarded
from ..functions.lineage import cut
from . import framing

#: Bytes of the longest line or event.
MOST_BYTES = 4 << 20
RECORD = "row long, value string, error string"
CSV_ENCODING = "spreadsheet-literal-v1"
#: The field of a record that tells how good its event's name is, where it is only a place.
QUALITY, POSITION_ONLY = "_identity_quality", "position_only"


def numbered(rows: DataFrame, *parts: str, at: str) -> DataFrame:
    """``rows`` with ``row``, their number from 1 in order of ``parts`` and ``at``, which counts on within a part.

    Only a count of each part comes together; rows stay where they are.
    """
    sizes = sorted(tuple(r) for r in rows.groupBy(*parts).agg(F.min(at).alias("first"), F.count("*").alias("n")).collect())
    starts, total = [], 0
    for *part, first, n in sizes:
        starts.append((*part, total - first))
        total += n
    kinds = dict(rows.dtypes)
    offsets = rows.sparkSession.createDataFrame(starts, ", ".join(f"{p} {kinds[p]}" for p in parts) + ", start long")
    return rows.join(F.broadcast(offsets), list(parts)).withColumn("row", F.col("start") + F.col(at) + 1).drop("start")


def strict_json(value: Column) -> Column:
    """A JSON text as a variant; null also where anything follows it, which shows within brackets and braces."""
    alone = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), value, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(value))


def _judged(rows: DataFrame, value: Column, wrong: Column | None = None) -> DataFrame:
    """Records of JSON texts: what is too long or no UTF-8 is an error; whether they are JSON shows when they are read."""
    error = F.coalesce(wrong if wrong is not None else F.lit(None).cast("string"), F.when(F.octet_length(value) > MOST_BYTES, "longer than the byte bound").when(~F.is_valid_utf8(value), "not valid UTF-8"))
    return rows.select("row", F.when(error.isNull(), value).alias("value"), error.alias("error"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """A record for each line with more than white space; the others count in ``row``. Line feeds alone end lines, which keep their bytes, so bad UTF-8 shows."""
    rows = numbered(framing.pieces(spark, path, "\n"), *framing.BLOCK, at="place").where(F.col("value").rlike(r"[^ \t\n\x0B\f\r]"))
    return _judged(rows, F.col("value"))


#: White space of JSON, as a pattern.
_BLANK = r"[ \t\r\n]*"


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A record for each item of a JSON array that is a whole file; anything else raises.

    Tasks take blocks of the files. An item is one task's, and held up to MOST_BYTES; together
    with a longer one, items that are no objects and come right before it are one error.
    """
    chunks = cut(framing.json_chunks(spark, path, MOST_BYTES))
    first, text, last = F.col("chunk") == 0, F.col("text"), ~F.col("ended")
    begins = F.when(first, text.rlike(rf"^{_BLANK}\[")).otherwise(text.rlike(rf"^{_BLANK},"))
    rest = F.when(first, F.regexp_replace(text, rf"^{_BLANK}\[", "")).otherwise(F.regexp_replace(text, rf"^{_BLANK},", ""))
    body = F.when(last, F.regexp_replace(rest, rf"\]{_BLANK}$", "")).otherwise(rest)
    over = last & ~first & text.rlike(rf"^{_BLANK}\]{_BLANK}$")
    right = over | (begins & (~last | text.rlike(rf"\]{_BLANK}$")) & (first | ~body.rlike(rf"^{_BLANK}$")))
    chunks = chunks.select("file", "chunk", "ended", text.isNull().alias("long"), F.when(right, F.when(over, "").otherwise(body)).alias("body"))
    chunks = chunks.withColumn("v", strict_json(F.concat(F.lit("["), F.col("body"), F.lit("]"))))
    wrong = chunks.where("not long and v is null").select("file").union(chunks.groupBy("file").agg(F.min("ended").alias("open")).where("open").select("file"))
    # a file without a byte has no chunk
    if wrong.limit(1).count() or chunks.where("chunk = 0").count() < len(spark.read.text(path).inputFiles()):
        raise ValueError("the file isn't one JSON array")
    empty = F.array(F.lit(None).cast("variant"))
    items = chunks.select("file", "chunk", "long", "body", F.posexplode(F.when(F.col("long"), empty).otherwise(F.variant_get("v", "$", "array<variant>"))).alias("at", "item"), F.size(F.variant_get("v", "$", "array<variant>")).alias("n"))
    items = framing.numbered_chunks(items).withColumn("kind", F.schema_of_variant("item"))
    # an object alone keeps its bytes
    own = F.when(F.col("n") == 1, F.regexp_replace("body", rf"^{_BLANK}|{_BLANK}$", "")).otherwise(F.to_json("item"))
    wrong = F.when(F.col("long"), "longer than the byte bound").when(~F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False)), "not a JSON object")
    return _judged(items, own, wrong)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A record for each row that isn't empty, by the strict rules of CSV; what breaks them raises when rows are read. Tasks take blocks of the files.

    The header must be there, without repeats, and the same in all files. Cells are decoded to
    JSON by :func:`csv_record`; a short row lacks its last cells, a long one is an error.
    """
    rows = framing.csv_rows(framing.csv_chunks(spark, path, MOST_BYTES), MOST_BYTES)
    heads = rows.where("chunk = 0 and at = 0").select("cells").distinct().limit(2).collect()
    if not heads or not heads[0][0]:
        raise ValueError("the header is missing")
    header = heads[0][0]
    if len(heads) > 1:
        raise ValueError("the files' headers differ")
    if len(set(header)) != len(header):
        raise ValueError("the header repeats a column")
    rows = framing.numbered_chunks(rows.where("chunk > 0 or at > 0"))
    cells = [F.get("cells", F.lit(k)).alias(h) for k, h in enumerate(header)]
    return csv_record(rows.select("row", *cells, F.when(F.size("cells") > len(header), "longer").alias("_broken")), header)


#: Cells that mean nothing when they are empty; others stay empty texts.
EMPTY = ("timestamp", "session_id", "bundle_id", "schema_version", "attempt_kind", "order_scope", "time_semantics", "duration_scope")


def csv_record(rows: DataFrame, header: list[str]) -> DataFrame:
    """Cells as typed JSON: exact booleans, whole numbers, skills as a JSON array, empty cells as null or their default."""
    cell = {h: F.col("`" + h.replace("`", "``") + "`") for h in header}
    bad = F.when(F.col("_broken").isNotNull(), "more fields than the header")
    if "csv_encoding" in cell:
        mark = cell.pop("csv_encoding")
        bad = F.coalesce(bad, F.when(mark.isNotNull() & (mark != CSV_ENCODING), "unknown literal encoding"))
        cell = {h: F.when(mark == CSV_ENCODING, csv_unguarded(c)).otherwise(c) for h, c in cell.items()}
    out: dict[str, Column] = {}
    for h, c in cell.items():
        filled = F.when(c != "", c)
        if h == "correct":
            out[h] = F.when(c == "true", True).when(c == "false", False)
            bad = F.coalesce(bad, F.when(out[h].isNull(), "correct is neither true nor false"))
        elif h == "source_sequence":
            out[h] = F.expr(f"try_cast(`{h}` as bigint)")
            bad = F.coalesce(bad, F.when(out[h].isNull(), "source_sequence isn't a whole number"))
        elif h == "skills":
            out[h] = F.from_json(F.coalesce(filled, F.lit("[]")), "array<string>")
            bad = F.coalesce(bad, F.when(out[h].isNull(), "skills aren't a JSON array"))
        elif h == "duration_ms":
            out[h] = F.expr(f"try_cast(`{h}` as double)")
            bad = F.coalesce(bad, F.when(filled.isNotNull() & out[h].isNull(), "duration_ms isn't a number"))
        elif h != "provenance":
            out[h] = filled if h in EMPTY else c
    text = F.to_json(F.struct(*[c.alias(h) for h, c in out.items()]))
    return rows.select("row", F.when(bad.isNull(), text).alias("value"), bad.alias("error"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A record for each row; digests and provenance are left out and made anew."""
    rows = spark.read.parquet(path)
    names = rows.columns
    rows = numbered(rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")), "__file", at="__at")
    kept = [c for c in names if c not in ("identity", "content_hash", "provenance")]
    stamp = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) if dict(rows.dtypes)[c].startswith("timestamp") else F.col(c) for c in kept]
    return rows.select("row", F.to_json(F.struct(*stamp)).alias("value"), F.lit(None).cast("string").alias("error"))


def read_legacy(spark: SparkSession, path: str, learner: str = "local-learner") -> DataFrame:
    """Attempts by question, ``{question: {attempts: [{id, correct}]}}``, at the root or under ``LocalSubmissions``.

    Order is known only within a question. Attempts without an id of their own are named by place, and say so.
    """
    kind = "map<string, struct<attempts: array<struct<id: variant, correct: variant>>>>"
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    inner = F.coalesce(F.get_json_object("value", "$.LocalSubmissions"), F.col("value"))
    if whole.where(strict_json(F.col("value")).isNull()).limit(1).count():
        raise ValueError("the file isn't JSON")
    rows = whole.select(F.posexplode(F.map_entries(F.from_json(inner, kind))).alias("q", "e"), "file").select("file", "q", F.col("e.key").alias("question"), F.posexplode("e.value.attempts").alias("pos", "a"))
    own = F.when(F.schema_of_variant("a.id") == "STRING", F.trim(F.variant_get("a.id", "$", "string")))
    stable = F.coalesce(own != "", F.lit(False))
    name = F.when(stable, own).otherwise(F.concat(F.lit("position:"), "pos"))
    event = F.sha2(F.to_json(F.array(F.lit(learner), F.col("question"), name)), 256)
    value = F.to_json(F.struct(event.alias("event_id"), F.lit(learner).alias("learner_id"), F.col("question").alias("question_id"), F.array().cast("array<string>").alias("skills"), F.col("a.correct").alias("correct"), F.col("pos").cast("long").alias("source_sequence"), F.lit("question").alias("order_scope"), F.when(~stable, POSITION_ONLY).alias(QUALITY)))
    at = (F.row_number().over(Window.partitionBy("file").orderBy("q", "pos")) - 1).cast("long")
    rows = numbered(rows.select("file", at.alias("at"), value.alias("value")), "file", at="at")
    return rows.select("row", "value", F.lit(None).cast("string").alias("error"))


READERS = {"ndjson": read_ndjson, "json": read_json_array, "csv": read_csv, "parquet": read_parquet, "legacy": read_legacy}


def read_records(spark: SparkSession, path: str, format: str) -> DataFrame:
    if format not in READERS:
        raise ValueError(f"unknown format {format}")
    try:
        return READERS[format](spark, path)
    except AnalysisException as e:
        raise ValueError(f"{path} can't be read as {format}") from e
