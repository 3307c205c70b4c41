"""Records of files whose record ends depend on what is before them, read by all tasks at once.

Files are cut at a byte, by Spark's own text source, so that blocks of one file go to many
tasks. Whether a place lies within quotes, and how deep, depends on all that comes before
it; so each block first tells what it would make of either beginning, those few numbers are
chained over the blocks of a file, and then each block knows how it begins.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ("file", "block")
_START = "file string, block long"


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """What lies between separators: ``file``, ``block`` (where the block that holds it begins), ``place`` (in order within the block) and ``value``, to the byte."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def _before(*keys: str):
    return Window.partitionBy(*BLOCK, *keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(value: Column) -> Column:
    return F.coalesce(F.sum(value).over(_before()), F.lit(0))


def _chained(blocks: DataFrame, names: str, step) -> DataFrame:
    """A row for each block of ``blocks`` with what ``step(state, row)`` had made of the blocks of its file before; a few numbers a block come together."""
    out, states, file = [], {}, None
    for r in sorted(blocks.collect(), key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, states = r["file"], step(None, None)
        out.append((r["file"], r["block"], *states))
        states = step(states, r)
    return F.broadcast(blocks.sparkSession.createDataFrame(out, f"{_START}, {names}"))


def json_chunks(spark: SparkSession, path: str, most: int) -> DataFrame:
    """The items of files that are each one JSON array, in chunks that end with an object: ``file``, ``chunk`` (from 0), ``text`` (null if longer than ``most`` bytes) and ``ended``, which only a file's last chunk isn't.

    Files are cut at closing braces, wherever these are. What has no closing brace for long is one task's.
    """
    rows = pieces(spark, path, "}")
    bare = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')  # without escapes; every other part is in quotes
    outside = lambda odd: F.array_join(F.filter(bare, lambda x, i: i % 2 == odd), "")
    count = lambda text, marks: F.length(text) - F.length(F.translate(text, marks, ""))
    # a brace follows each piece; if quotes are open at its end, it closes nothing
    turns = (F.size(bare) - 1) % 2
    depth = lambda odd: count(outside(odd), "[{") - count(outside(odd), "]}") - F.when((turns + odd) % 2 == 0, 1).otherwise(0)
    rows = rows.withColumns({"turns": turns, "if_out": depth(0), "if_in": depth(1), "bytes": F.octet_length("value").cast("long") + 1})
    rows = rows.withColumn("turned", _sum_before(F.col("turns")) % 2)
    sums = rows.groupBy(*BLOCK).agg(
        (F.sum("turns") % 2).alias("turns"), F.sum(F.when(F.col("turned") == 0, F.col("if_out")).otherwise(F.col("if_in"))).alias("d0"), F.sum(F.when(F.col("turned") == 0, F.col("if_in")).otherwise(F.col("if_out"))).alias("d1")
    )
    starts = _chained(sums, "quoted int, deep long", lambda s, r: (0, 0) if r is None else ((s[0] + r["turns"]) % 2, s[1] + (r["d1"] if s[0] else r["d0"])))
    rows = rows.join(starts, list(BLOCK)).withColumn("within", (F.col("turned") + F.col("quoted")) % 2)
    rows = rows.withColumn("change", F.when(F.col("within") == 0, F.col("if_out")).otherwise(F.col("if_in")))
    rows = rows.withColumn("depth", F.col("deep") + _sum_before(F.col("change")) + F.col("change"))
    rows = rows.withColumn("ends", ((F.col("depth") == 1) & ((F.col("within") + F.col("turns")) % 2 == 0)).cast("int"))
    starts = _chained(rows.groupBy(*BLOCK).agg(F.sum("ends").alias("ends")), "chunks long", lambda s, r: (0,) if r is None else (s[0] + r["ends"],))
    rows = rows.join(starts, list(BLOCK)).withColumn("ended_before", _sum_before(F.col("ends")))
    rows = rows.withColumn("chunk", F.col("chunks") + F.col("ended_before"))
    rows = rows.withColumn("size", F.coalesce(F.sum("bytes").over(_before("chunk")), F.lit(0)) + F.col("bytes"))
    part = F.struct("block", "place", F.when(F.col("size") <= most, F.col("value")).alias("value"))
    each = rows.groupBy(*BLOCK, "chunk").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("bytes").alias("bytes"), F.max("ends").alias("ended"), F.min("ended_before").alias("ended_before"))
    # most chunks lie in one block; only those that don't go to another task
    whole = (F.col("ended") == 1) & (F.col("ended_before") > 0)
    split = each.where(~whole).groupBy("file", "chunk").agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"), F.sum("bytes").alias("bytes"), F.max("ended").alias("ended"))
    both = each.where(whole).select("file", "chunk", "parts", "bytes", "ended").union(split)
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "}")
    return both.select("file", "chunk", F.when(F.col("bytes") <= most, F.when(F.col("ended") == 1, F.concat(text, F.lit("}"))).otherwise(text)).alias("text"), (F.col("ended") == 1).alias("ended"))


def leaves_open(line: str, quoted: bool) -> bool:
    """Whether quotes are open at the end of a line of CSV that begins within a quoted field or a new row; only a quote at the beginning of a field opens."""
    at, n = 0, len(line)
    while True:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            at, quoted = at + 1, False
        elif at < n and line[at] == '"':
            at, quoted = at + 1, True
            continue
        comma, row = line.find(",", at), line.find("\r", at)
        ends = [x for x in (comma, row) if x >= 0]
        if not ends:
            return False
        at = min(ends) + 1


def csv_chunks(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Lines of CSV files, together where a quoted field goes over their ends: ``file``, ``chunk`` (from 0) and ``text``; whole rows, mostly one. Chunks of over ``most`` bytes have null."""
    lines = pieces(spark, path, "\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            opens = {k: pa.array([leaves_open(v, q) if '"' in v else q for v in values], pa.bool_()) for k, q in (("if_out", False), ("if_in", True))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *opens.values()], names=[*batch.schema.names, *opens])

    rows = lines.mapInArrow(run, f"{_START}, place long, value string, if_out boolean, if_in boolean")
    # what is before a line decides by the last line that leaves one and the same whatever it begins with, and by how many turn it since
    fixed, turns = F.when(F.col("if_out") == F.col("if_in"), F.col("if_out").cast("int")), (F.col("if_out") & ~F.col("if_in")).cast("int")
    rows = rows.withColumns({"fixed": fixed, "turns": turns, "bytes": F.octet_length("value").cast("long") + 1})
    rows = rows.withColumn("turned", _sum_before(F.col("turns")))
    rows = rows.withColumn("known", F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turned")), ignorenulls=True).over(_before()))
    after = F.max_by(F.struct("fixed", "turned"), F.when(F.col("fixed").isNotNull(), F.col("place")))
    sums = rows.groupBy(*BLOCK).agg(after.alias("known"), F.sum("turns").alias("turns"))
    follows = lambda s, r: ((r["known"]["fixed"] + r["turns"] - r["known"]["turned"]) % 2,) if r["known"] else ((s[0] + r["turns"]) % 2,)
    starts = _chained(sums, "quoted int", lambda s, r: (0,) if r is None else follows(s, r))
    rows = rows.join(starts, list(BLOCK))
    within = F.when(F.col("known").isNull(), F.col("quoted") + F.col("turned")).otherwise(F.col("known.fixed") + F.col("turned") - F.col("known.turned")) % 2
    rows = rows.withColumn("ends", F.when(F.when(within == 1, F.col("if_in")).otherwise(F.col("if_out")), 0).otherwise(1))
    starts = _chained(rows.groupBy(*BLOCK).agg(F.sum("ends").alias("ends")), "chunks long", lambda s, r: (0,) if r is None else (s[0] + r["ends"],))
    rows = rows.join(starts, list(BLOCK)).withColumn("ended_before", _sum_before(F.col("ends")))
    rows = rows.withColumn("chunk", F.col("chunks") + F.col("ended_before"))
    rows = rows.withColumn("size", F.coalesce(F.sum("bytes").over(_before("chunk")), F.lit(0)) + F.col("bytes"))
    part = F.struct("block", "place", F.when(F.col("size") <= most, F.col("value")).alias("value"))
    each = rows.groupBy(*BLOCK, "chunk").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("bytes").alias("bytes"), F.max("ends").alias("ended"), F.min("ended_before").alias("ended_before"))
    whole = (F.col("ended") == 1) & (F.col("ended_before") > 0)
    split = each.where(~whole).groupBy("file", "chunk").agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"), F.sum("bytes").alias("bytes"))
    both = each.where(whole).select("file", "chunk", "parts", "bytes").union(split)
    return both.select("file", "chunk", F.when(F.col("bytes") <= most, F.array_join(F.transform("parts", lambda x: x["value"]), "\n")).alias("text"))


def csv_rows(chunks: DataFrame, most: int) -> DataFrame:
    """The rows of chunks by the strict rules of CSV, without empty ones but a file's first: ``file``, ``chunk``, ``at`` (in the chunk), ``cells``. What breaks the rules, or is longer than ``most``, fails the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(most)
        for batch in batches:
            out: list[tuple] = []
            for file, chunk, text in zip(*(batch.column(c).to_pylist() for c in ("file", "chunk", "text")), strict=True):
                if text is None:
                    raise ValueError(f"a row of {file} is longer than {most} bytes")
                own = csv.reader(io.StringIO(text if chunk else text.removeprefix("\ufeff"), newline=""), strict=True)
                out += [(file, chunk, k, c) for k, c in enumerate(own) if c or not chunk and not k]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "chunk", "at", "cells"), r, strict=True)) for r in out], schema=pa.schema([("file", pa.string()), ("chunk", pa.int64()), ("at", pa.int32()), ("cells", pa.list_(pa.string()))]))

    return chunks.mapInArrow(run, "file string, chunk long, at int, cells array<string>")


def numbered_chunks(rows: DataFrame, at: str = "at", per: int = 100_000) -> DataFrame:
    """``rows`` with ``row``, their number from 1 in order of files, chunks and ``at``; the counts of runs of ``per`` chunks come together."""
    rows = rows.withColumn("run", F.floor(F.col("chunk") / per))
    counts = sorted((r["file"], r["run"], r["count"]) for r in rows.groupBy("file", "run").count().collect())
    starts, total = [], 0
    for file, run, n in counts:
        starts.append((file, run, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "file string, run long, start long")
    rows = rows.join(F.broadcast(offsets), ["file", "run"])
    return rows.withColumn("row", F.col("start") + F.row_number().over(Window.partitionBy("file", "run").orderBy("chunk", at)))
