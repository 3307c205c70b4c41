"""Token counts by a cache of digests.

A count is kept under the digests of the normalised text and of the tokenizer. A run joins
its texts with the cache, encodes each distinct text that misses once, and appends those.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, SPACE, joined_evenly, steps, texts, written

SCHEMA = "digest string, version string, n_tokens long"
#: Words whose counts a task keeps at most; it starts anew beyond.
CACHED_WORDS = 300_000
LIMIT = 2048


def plain(text: Column) -> Column:
    """White space runs as one space, none at the ends: the same tokens for tokenizers that drop white space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def version_of(model: bytes) -> str:
    return hashlib.sha256(model).hexdigest()


class WordCounter:
    """Counts tokens of texts by a ``tokenizers`` model that drops white space, so that words count on their own."""

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def counts(self, documents: list[str]) -> list[int]:
        words = [t.split(" ") for t in documents]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in {w for own in words for w in own}.difference(known)]
        for start in range(0, len(new), 10_000):
            part = new[start : start + 10_000]
            known.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, own)) for own in words]


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Digests and counts of one tokenizer version; none if there is no cache yet."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, cache: str, text: str = "text", keep: dict[str, Column] | None = None, limit: int = LIMIT) -> DataFrame:
    """The columns ``keep`` with ``n_bytes``, ``n_tokens``, ``over_limit``, a row for each row of ``docs``.

    ``model`` is the JSON of a tokenizer that drops white space; ``cache`` a Parquet path in
    a shared folder, which need not exist. Null texts count as empty, which have 0 tokens.
    Running it again, or over rows that repeat, adds nothing to the cache.
    """
    spark, version = docs.sparkSession, version_of(model.encode())
    sent = spark.sparkContext.broadcast(model)
    keep = keep or {"doc_id": F.col("doc_id")}
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), plain(F.col(text)).alias("__text"))
    rows = rows.withColumn("__digest", F.sha2("__text", 256))
    places = written(rows.drop("__text"), "text-digests")
    distinct = rows.groupBy(F.col("__digest").alias("digest")).agg(F.first("__text").alias("text"))
    missing = distinct.join(read_cache(spark, cache, version), "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordCounter(sent.value)
        for b in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * b.num_rows, pa.string()), pa.array(own.counts(texts(b, "text")), pa.int64())], names=["digest", "version", "n_tokens"])

    missing.mapInArrow(run, SCHEMA).write.mode("append").parquet(cache)
    times = places.groupBy("__digest").agg(F.count("*").alias("__times"))
    counts = times.join(read_cache(spark, cache, version).withColumnRenamed("digest", "__digest"), "__digest")
    found = joined_evenly(places, counts, ["__digest"], F.col("__times") * HOT > places.count(), list(keep)).drop("__digest", "__times")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
