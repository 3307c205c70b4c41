"""WARC archives: what is stored once, what comes back to the byte, and the registered query."""

import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from praxilog.llm import queries, warc
from praxilog.llm.common import scratch

BIG, OTHER = "<p>größe " + "x" * 1200, "y" * 1000
ROWS = [
    (1, "http://a.com/1", BIG), (9, "http://a.com/9", BIG), (4, None, BIG), (None, "http://n", BIG), (4, None, BIG),
    (2, "u", OTHER), (2, "u", OTHER), (5, "short\r\nWARC-Type: fake", "hi"), (6, "", "hi"), (7, "v", None), (8, "w", ""),
    (None, "x", "z" * 1001), (None, "y", "z" * 1001), (10, "t", "a\r\n\r\nWARC/1.1\r\n" * 80), (11, "t", "k" * 999), (12, "t", "k" * 999), (13, "big", "long " * 400_000),
]


def plain(rows):
    newest = {}
    for i, _, html in rows:
        newest[html or ""] = max((-1 if i is None else i), newest.get(html or "", -1))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and newest[html] not in (-1, i)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", newest[html] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    data = [(*r, "head", "digest", 1) for r in ROWS]
    return spark.createDataFrame(data, "page_id long, url string, html string, head string, digest string, payload int").repartition(3)


@pytest.fixture(scope="module")
def path(spark, pages):
    place = scratch(spark, "warc-test")
    warc.archive(pages, place)
    return place


def told(frame):
    return sorted((tuple(r)[:5] for r in frame.collect()), key=repr)


def test_archive_tells_what_the_pages_hold(spark, path):
    assert told(warc.read(spark, path)) == plain(ROWS)
    urls = {r["page_id"]: r["url"] for r in warc.read(spark, path).collect()}
    assert urls[9] == "http://a.com/9" and urls[4] is None and urls[5] == "short%0D%0AWARC-Type: fake"


def test_payloads_are_stored_once(spark, path):
    stored = spark.read.parquet(f"{path}/payloads")
    assert sorted(r["digest"] for r in stored.collect()) == sorted({hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in ROWS})
    assert spark.read.parquet(f"{path}/records").columns == ["head", "http", "digest"]


def records_in(data):
    """A strict reader: version line, fields, a content of the told length, two line ends."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4 :]


def test_files_read_by_their_lengths(spark, path, tmp_path):
    warc.write_files(spark, path, str(tmp_path / "files"))
    found = [x for f in sorted((tmp_path / "files").glob("part-*")) for x in records_in(gzip.decompress(f.read_bytes()))]
    assert len(found) == len(ROWS)
    payloads = {}
    for fields, content in found:
        http, _, payload = content.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and fields["Content-Type"] == "application/http;msgtype=response"
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
            payloads[fields["WARC-Record-ID"]] = fields["WARC-Payload-Digest"]
    for fields, content in found:
        if fields["WARC-Type"] == "revisit":
            assert payloads[fields["WARC-Refers-To"]] == fields["WARC-Payload-Digest"] and content.endswith(b"\r\n\r\n")


def test_a_damaged_or_lost_payload_fails(spark, pages):
    for damage in (lambda x: x.withColumn("payload", F.encode(F.lit("other"), "utf-8")), lambda x: x.where(F.length("payload") != 1000)):
        place = scratch(spark, "warc-test")
        warc.archive(pages, place)
        whole = spark.read.parquet(f"{place}/payloads")
        damage(whole).write.parquet(f"{place}-2")
        spark.read.parquet(f"{place}-2").write.mode("overwrite").parquet(f"{place}/payloads")
        with pytest.raises(PySparkException, match="no such payload"):
            warc.read(spark, place).collect()


def test_text_ids_and_no_rows(spark):
    place = scratch(spark, "warc-test")
    warc.archive(spark.createDataFrame([("a b>", "u", BIG), ("ä", "u", BIG)], "page_id string, url string, html string"), place)
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(spark, place, "string").orderBy("page_id").collect()] == [("a b>", "revisit", "ä"), ("ä", "response", None)]
    place = scratch(spark, "warc-test")
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), place)
    assert warc.read(spark, place).count() == 0


def test_a_payload_of_most_records(spark):
    place = scratch(spark, "warc-test")
    rows = [(i, f"u{i}", BIG if i % 3 else OTHER + str(i)) for i in range(3000)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), place)
    assert told(warc.read(spark, place)) == plain(rows)


def test_query_and_its_types(spark, tmp_path):
    spark.createDataFrame([r for r in ROWS], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op11_warc(spark, str(tmp_path))
    assert found.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert told(found) == plain(ROWS)
