"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII white space, as a class for Java and Python patterns.
SPACE = r"[ \t-\r]"
#: Text that one step of a Python loop holds at most, in bytes (one longer document alone exceeds it).
STEP_BYTES = 4 << 20


#: A key with over one in so many of all rows is hot; there are fewer hot keys than this.
HOT = 1000
#: Tasks that rows of a hot key are dealt to where many rows meet many.
WAYS = 16
#: Paths that the open :func:`scratch_space` removes at its end.
_spaces: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a new one of this machine, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a :func:`scratch_space` removes it, else it stays with the folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _spaces:
        _spaces[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of whatever file system it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def freed(spark: SparkSession) -> None:
    """Collects the driver's garbage, upon which Spark deletes the shuffle files of plans that are done with; else they stay until its memory is full."""
    spark._jvm.System.gc()


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that operators kept within it; what they return must be written by then."""
    _spaces.append([])
    try:
        yield
    finally:
        for path in _spaces.pop():
            remove(spark, path)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that lost executors don't cost the lineage again."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def joined_evenly(rows: DataFrame, sums: DataFrame, keys: list[str], hot: Column, spread: list[str], hint: str | None = None) -> DataFrame:
    """``rows`` with the other columns of ``sums``, which has a row for each of ``keys`` at most; null where it has none.

    ``hot`` tells which rows of ``sums`` stand for over one in HOT of all ``rows``, so there are
    fewer than HOT. Those are broadcast, and what they match goes to tasks by the columns
    ``spread`` instead of by a key that many rows share. ``hint`` is how the others are joined.
    """
    own = [c for c in sums.columns if c not in keys]
    few = sums.where(hot).select(*keys, F.struct(*own).alias("__few"))
    left = rows.join(F.broadcast(few), keys, "left")
    left = left.withColumn("__way", F.when(F.col("__few").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(0))
    # 0 in a form that the optimizer doesn't fold, so that the way stays a key of the join
    rest = sums.where(~hot).select(*keys, F.pmod(F.xxhash64(*keys), F.lit(1)).alias("__way"), F.struct(*own).alias("__rest"))
    rest = rest.hint(hint) if hint else rest
    out = left.join(rest, [*keys, "__way"], "left").withColumn("__both", F.coalesce("__few", "__rest"))
    return out.select(*[F.col(c) for c in rows.columns], *[F.col(f"__both.{c}").alias(c) for c in own])


def met_evenly(rows: DataFrame, others: DataFrame, key: str, hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows.join(others, key, how)`` (inner or left), in which rows of the ``hot`` keys, of which there are fewer than HOT, are dealt to WAYS tasks each."""
    mark = F.broadcast(hot.select(key, F.lit(True).alias("__hot")))
    left = rows.join(mark, key, "left").withColumn("__way", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(WAYS)).cast("int")).otherwise(0)).drop("__hot")
    right = others.join(mark, key, "left").withColumn("__way", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return left.join(right, [key, "__way"], how).drop("__way")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null ids are in fold 0 like the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def added(batch: pa.RecordBatch, drop: str | None, **columns: pa.Array) -> pa.RecordBatch:
    """A batch without the column ``drop`` and with more columns after the others."""
    names = [n for n in batch.schema.names if n != drop]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(arrays + list(columns.values()), names=names + list(columns))
