"""WARC records in a content-addressed archive.

An archive is two Parquet tables. ``payloads`` has the bytes of each different payload once,
under their SHA-256. ``records`` has each record's header block and the HTTP header of its
content, to the byte, and the digest of its payload. A join of the two gives back the
records; every payload is then checked against the digest that it is kept under and against
the one that the record's header names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, joined_evenly, met_evenly, written

#: Payloads of fewer bytes never become revisits.
LEAST_BYTES = 1000
#: A record's id is this and the page's id, percent-encoded.
NAMES = "urn:page:"
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"
# fixed values of WARC 1.1
VERSION = "WARC/1.1"
HTTP_TYPE = "application/http;msgtype=response"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value, and no line ends within one."""
    one = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), one, F.lit(EOL)), F.lit(""))


def field(head: Column, name: str) -> Column:
    """A field of a header block; null if it has none."""
    found = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _name(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{NAMES}"), F.url_encode(F.coalesce(page_id.cast("string"), F.lit(""))), F.lit(">"))


def _page(name: Column, id_type: str) -> Column:
    found = F.url_decode(F.regexp_extract(name, f"^<{NAMES}(.*)>$", 1))
    return F.when(found != "", found).cast(id_type)


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, least: int = LEAST_BYTES) -> None:
    """Writes ``pages`` as an archive to ``path``, a new folder that all executors share: a record for each row.

    Of the records of one payload of at least ``least`` bytes, those of the largest page id
    are responses and the others revisit it; all others are responses. Null html is an empty
    payload; a record of a null url names no target; a null page id is below all others, and
    where a payload has no other its records are responses. Rows that repeat become records
    that repeat. Columns besides the three are left out. Equal digests of payloads that
    differ in length or SHA-1 fail the run.
    """
    own = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).withColumn("mark", F.struct(F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1")))
    stored = own.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("mark").alias("mark"), F.max("mark").alias("other"), F.max("page").alias("newest"), F.count("*").alias("times"))
    same = F.when(F.col("mark") == F.col("other"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("two payloads of digest "), F.col("digest"))))
    stored.select(same.alias("digest"), "payload", "newest", "times").write.parquet(f"{path}/payloads")
    newest = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "newest", "times")
    places = written(own.select("page", "url", "digest", "mark"), "warc-places")
    rows = joined_evenly(places, newest, ["digest"], F.col("times") * HOT > places.count(), ["page", "url"])
    size, again = F.col("mark.size"), (F.col("mark.size") >= least) & ~F.col("page").eqNullSafe(F.col("newest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), size.cast("string"), F.lit(EOL + EOL))
    rows = rows.withColumn("again", again).withColumn("http", http)
    length = F.octet_length("http") + F.when(F.col("again"), 0).otherwise(size)
    head = F.concat(
        F.lit(VERSION + EOL),
        _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("page"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("mark.sha1"))),
        _line("WARC-Refers-To", F.when(F.col("again"), _name(F.col("newest")))),
        _line("WARC-Profile", F.when(F.col("again"), F.lit(SAME_PAYLOAD))),
        _line("Content-Type", F.lit(HTTP_TYPE)),
        _line("Content-Length", length.cast("string")),
        F.lit(EOL),
    )
    rows.select(head.alias("head"), "http", "digest").write.parquet(f"{path}/records")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive with their payloads: ``head``, ``http``, ``payload``, ``kind``, ``sha1`` (as the header has it).

    A record whose payload is missing, or is not what its digests say, fails the run. Records
    of a payload that over one in HOT of all have are dealt to several tasks.
    """
    records = spark.read.schema("head string, http string, digest string").parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    total = records.count()
    hot = records.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total)
    both = met_evenly(records, payloads, "digest", hot, ["head"], "left")
    told = F.regexp_extract(field(F.col("head"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    right = (F.sha2("payload", 256) == F.col("digest")) & (F.sha1("payload") == told)
    checked = F.when(F.coalesce(right, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no such payload: "), F.col("digest"))).cast("binary"))
    return both.select("head", "http", checked.alias("payload"), field(F.col("head"), "WARC-Type").alias("kind"), told.alias("sha1"))


def record(rows: DataFrame) -> DataFrame:
    """Each record of :func:`rebuilt` to the byte, but for the two line ends that follow it: ``record``, as a string of these bytes."""
    body = F.when(F.col("kind") == "response", F.col("payload").cast("string")).otherwise("")
    return rows.select(F.concat("head", "http", body).alias("record"))


def write_files(spark: SparkSession, path: str, folder: str, compression: str = "gzip") -> None:
    """Writes an archive's records as WARC files, one a partition, in which each record ends with two line ends."""
    record(rebuilt(spark, path)).write.option("lineSep", EOL + EOL).option("compression", compression).text(folder)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """What an archive's records say: ``page_id``, ``payload_bytes``, ``payload_digest`` (SHA-1), ``record_type``, ``refers_to``, ``url``.

    Size and digest are of the full payload, of revisits too. No records: no rows.
    """
    rows, head = rebuilt(spark, path), F.col("head")
    return rows.select(
        _page(field(head, "WARC-Record-ID"), id_type).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        _page(field(head, "WARC-Refers-To"), id_type).alias("refers_to"),
        field(head, "WARC-Target-URI").alias("url"),
    )
