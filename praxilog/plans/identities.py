"""The index of stored identities: an import reads what it may hold again, not all that is stored.

Each version keeps its own identities in folders by their first digits, and for each folder a
Bloom filter, in bitmaps of which a lookup reads those that its identities fall into. Where
the filters rule a folder out, it isn't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of an identity that name its folder; with two there are 256.
DIGITS = 2
#: Bits of a filter for each identity, and how many of them one sets: about one in a hundred others passes.
BITS, HASHES = 10, 7
#: Bits of one bitmap, as Spark's bitmap functions have them.
BITMAP = 32_768
#: Lookups of more identities than this read every folder that they fall into, since filters would rule none out.
FEW = 200_000


def bucket(identity: Column) -> Column:
    """The folder of an identity; the letter keeps digits from being read as numbers."""
    return F.concat(F.lit("b"), F.substring(identity, 1, DIGITS))


def _places(identity: Column, bits: Column) -> Column:
    """The filter's bits of an identity: ``word`` (which bitmap) and ``bit`` in it."""
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), identity), bits)
    return F.array(*[F.struct(F.floor(at(k) / BITMAP).alias("word"), (at(k) % BITMAP).alias("bit")) for k in range(HASHES)])


def write(attempts: DataFrame, folder: str) -> None:
    """Writes the index of a version's own attempts (``identity``, ``content_hash``) to a new folder."""
    rows = attempts.select("identity", "content_hash", bucket(F.col("identity")).alias("bucket"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "identity").write.partitionBy("bucket").parquet(f"{folder}/identities")
    rows = attempts.sparkSession.read.parquet(f"{folder}/identities")
    sizes = rows.groupBy("bucket").agg((F.ceil(F.count("*") * BITS / F.lit(BITMAP)) * BITMAP).cast("long").alias("bits"))
    each = rows.join(F.broadcast(sizes), "bucket").select("bucket", "bits", F.explode(_places(F.col("identity"), F.col("bits"))).alias("at"))
    each.groupBy("bucket", "bits", F.col("at.word").alias("word")).agg(F.bitmap_construct_agg(F.col("at.bit")).alias("bitmap")).repartition(1, "bucket").write.parquet(f"{folder}/filters")


def may_hold(spark: SparkSession, folders: list[str], wanted: DataFrame) -> DataFrame:
    """Of ``wanted`` (``identity``) those that some version's filter doesn't rule out: all that are stored, and few others."""
    filters = spark.read.parquet(*[f"{f}/filters" for f in folders]).withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/filters/[^/]*$", 1))
    heads = filters.select("version", "bucket", "bits").distinct()
    own = wanted.select("identity", bucket(F.col("identity")).alias("bucket")).distinct().join(F.broadcast(heads), "bucket")
    own = own.select("identity", "version", "bucket", F.explode(_places(F.col("identity"), F.col("bits"))).alias("at")).select("identity", "version", "bucket", "at.*")
    met = own.join(filters.select("version", "bucket", "word", "bitmap"), ["version", "bucket", "word"], "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")), F.lit(0))
    return met.groupBy("identity", "version").agg(F.min(is_set).alias("all")).where(F.col("all") == 1).select("identity").distinct()


def stored(spark: SparkSession, folders: list[str], buckets: list[str]) -> DataFrame:
    """``identity`` and ``content_hash`` of what some folders hold; only those are read."""
    each = [spark.read.parquet(f"{f}/identities").where(F.col("bucket").isin(buckets)).select("identity", "content_hash") for f in folders]
    return reduce(DataFrame.union, each)


def lookup(spark: SparkSession, folders: list[str], wanted: DataFrame) -> DataFrame:
    """``identity`` and ``content_hash`` of those of ``wanted`` (``identity``) that versions' indexes hold, each once; an identity is never stored twice. No versions: none."""
    if not folders:
        return spark.createDataFrame([], "identity string, content_hash string")
    rows = wanted.select("identity").where("identity is not null")
    if rows.limit(FEW + 1).count() <= FEW:
        rows = may_hold(spark, folders, rows)
    touched = [r[0] for r in rows.select(bucket(F.col("identity")).alias("b")).distinct().collect()]
    return stored(spark, folders, touched).join(rows, "identity", "left_semi")
