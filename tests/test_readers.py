"""Readers against one-pass readers, for blocks from one byte up."""

import csv
import io
import json
import random

import pytest

from praxilog.operators import ingest
from praxilog.sources import framing, readers

BLOCKS = ("1b", "17b", "128m")


@pytest.fixture
def blocks(spark):
    """Sets how many bytes a task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def put(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1b")

    yield put
    for n in names:
        spark.conf.unset(n)


def read(spark, tmp_path, data, how, name="file"):
    place = tmp_path / name
    place.write_bytes(data if isinstance(data, bytes) else data.encode())
    return sorted(tuple(r) for r in how(spark, str(place)).collect())


ITEMS = [{"a": 1, "t": 'quoted "x" }]{[ \\ end\\'}, {"b": {"c": [1, {"d": "}"}]}}, 3, "text } \" [", [1, {"x": []}], {}, {"ä": "日本  "}, None, {"z": 1.50}, -2]


@pytest.mark.parametrize("size", BLOCKS)
def test_array_items_are_those_of_a_one_pass_reader(spark, tmp_path, blocks, size):
    blocks(size)
    for indent in (None, 1):
        data = " \n" + json.dumps(ITEMS, indent=indent, ensure_ascii=False) + "\n"
        got = read(spark, tmp_path, data, readers.read_json_array)
        assert [r[0] for r in got] == list(range(1, len(ITEMS) + 1))
        assert [json.loads(v) if v else None for _, v, _ in got] == [x if isinstance(x, dict) else None for x in ITEMS]
        assert [e for _, _, e in got] == [None if isinstance(x, dict) else "not a JSON object" for x in ITEMS]
        if size == "1b":
            break


def test_an_object_alone_keeps_its_bytes(spark, tmp_path):
    got = read(spark, tmp_path, '[ {"a": 1.0,  "b":"\\u00e4"} ,\n{"c":1e3}\t]', readers.read_json_array)
    assert got == [(1, '{"a": 1.0,  "b":"\\u00e4"}', None), (2, '{"c":1e3}', None)]


@pytest.mark.parametrize("data", ["[]", " [ \n] ", "[1,2]"])
def test_arrays_without_objects(spark, tmp_path, data):
    assert [e for _, _, e in read(spark, tmp_path, data, readers.read_json_array)] == ["not a JSON object"] * len(json.loads(data))


@pytest.mark.parametrize("data", ["", '{"a":1}', '[{"a":1}', '[{"a":1},]', '[,{"a":1}]', '[{"a":1}{"b":2}]', '[{"a":1}] x', '[{"a":1}]]', '[{"a":1}}, {"b":2}]', '[{"a":"x}]', '[{"a":[1}]', '[{"a":1}] [{"b":1}]', "  ", '[{"a":1},,{"b":2}]'])
def test_what_is_not_one_array_raises(spark, tmp_path, data):
    with pytest.raises(ValueError, match="one JSON array"):
        read(spark, tmp_path, data, readers.read_json_array)


def test_a_long_item_is_an_error_of_its_own(spark, tmp_path, blocks, monkeypatch):
    monkeypatch.setattr(readers, "MOST_BYTES", 60)
    blocks("16b")
    data = json.dumps([{"a": 1}, {"long": "}" * 300}, {"b": [{}] * 40}, {"c": 2}])
    assert read(spark, tmp_path, data, readers.read_json_array) == [(1, '{"a": 1}', None), (2, None, "longer than the byte bound"), (3, None, "longer than the byte bound"), (4, '{"c": 2}', None)]


def test_arrays_of_several_files_count_on(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        (tmp_path / "d" / f"{k}.json").write_text(json.dumps([{"k": k, "i": i} for i in range(k + 1)]))
    got = sorted((r["row"], r["value"]) for r in readers.read_json_array(spark, str(tmp_path / "d")).collect())
    assert [json.loads(v) for _, v in got] == [{"k": k, "i": i} for k in range(3) for i in range(k + 1)] and [r for r, _ in got] == [1, 2, 3, 4, 5, 6]


def plain_csv(data):
    rows = list(csv.reader(io.StringIO(data.removeprefix("﻿"), newline=""), strict=True))
    return [r for r in rows if r]


HEADER = 'event_id,"question_id",correct,source_sequence,"odd, ""name""\nhere"'
CSV = "﻿" + HEADER + '\r\ne1,q,true,1,plain\ne2,"a,b",false,2,"two\nlines, ""quoted"" and\r\nmore"\r\n\ne3,mid"quote,true,3,\ne4,"""",true,4,"x"\re5,q,true,5\ne6,q,true,6,7,8\ne7,"",true,7,"end"'


@pytest.mark.parametrize("size", ("17b", "128m"))
def test_csv_rows_are_those_of_pythons_strict_reader(spark, tmp_path, blocks, size):
    blocks(size)
    place = tmp_path / "file.csv"
    place.write_bytes(CSV.encode())
    rows = framing.csv_rows(framing.csv_chunks(spark, str(place), 1 << 20), 1 << 20).orderBy("chunk", "at").collect()
    assert [r["cells"] for r in rows if r["cells"]] == plain_csv(CSV)
    got = read(spark, tmp_path, CSV, readers.read_csv)
    assert [r[0] for r in got] == list(range(1, 8))
    assert [r[2] for r in got] == [None] * 5 + ["more fields than the header", None]
    values = [json.loads(v) for _, v, _ in got if v]
    assert [v["question_id"] for v in values] == ["q", "a,b", 'mid"quote', '"', "q", ""] and [v["correct"] for v in values] == [True, False, True, True, True, True]
    assert values[1]['odd, "name"\nhere'] == 'two\nlines, "quoted" and\r\nmore' and 'odd, "name"\nhere' not in values[4]


@pytest.mark.parametrize("seed", range(3))
def test_random_csv_in_small_blocks(spark, tmp_path, blocks, seed):
    r = random.Random(seed)
    rows = [[r.choice(["", "a", 'x"y', '"', "l\nm", "\r\n", ",", "ä日", '""', "z" * 9]) for _ in range(3)] for _ in range(12)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows([["h1", "h2", "h3"], *rows])
    blocks(f"{(1, 2, 30)[seed]}b")
    place = tmp_path / "file.csv"
    place.write_bytes(out.getvalue().encode())
    found = framing.csv_rows(framing.csv_chunks(spark, str(place), 1 << 20), 1 << 20).orderBy("chunk", "at").collect()
    assert [x["cells"] for x in found] == [["h1", "h2", "h3"], *rows]


def test_csv_headers_and_broken_rows(spark, tmp_path):
    for data, what in (("", "missing"), ("\n", "missing"), ("a,b,a\n1,2,3", "repeats")):
        with pytest.raises(ValueError, match=what):
            read(spark, tmp_path, data, readers.read_csv)
    for data in ('a,b\n"x"y,1\n', 'a,b\n"open,1\n'):
        with pytest.raises(Exception, match="expected after|unexpected end"):
            read(spark, tmp_path, data, readers.read_csv)
    (tmp_path / "two").mkdir()
    for k in range(2):
        (tmp_path / "two" / f"{k}.csv").write_text(f"a,b{k}\n1,2\n")
    with pytest.raises(ValueError, match="differ"):
        readers.read_csv(spark, str(tmp_path / "two"))


def test_cells_as_the_rules_have_them(spark, tmp_path):
    head = "correct,source_sequence,skills,timestamp,duration_ms,learner_id"
    marked = f"{head},csv_encoding\n" + "true,1,\"[\"\"s\"\"]\",,1.5,'=x,spreadsheet-literal-v1\ntrue,6,,,,u,other\ntrue,6,,,,u,\n"
    got = read(spark, tmp_path, marked, readers.read_csv, "marked")
    assert json.loads(got[0][1]) == {"correct": True, "source_sequence": 1, "skills": ["s"], "duration_ms": 1.5, "learner_id": "=x"}
    assert [e for _, _, e in got[1:]] == ["unknown literal encoding"] * 2
    got = read(spark, tmp_path, f"{head}\nfalse,2,,,,\n" + "\n".join(["True,3,,,,u", "true,x,,,,u", "true,4,{,,,u", "true,5,,,y,u", "true"]), readers.read_csv, "plain")
    assert json.loads(got[0][1]) == {"correct": False, "source_sequence": 2, "skills": [], "learner_id": ""}
    assert [bool(e) for _, _, e in got] == [False, True, True, True, True, True]


@pytest.mark.parametrize("size", BLOCKS)
def test_lines_end_at_line_feeds_alone(spark, tmp_path, blocks, size):
    blocks(size)
    data = '{"a":1,\r"b":2}\n\n  \n{"c":3}\r\nno json\n{"d":4}'
    got = read(spark, tmp_path, data, readers.read_ndjson)
    assert [(r, v) for r, v, _ in got] == [(1, '{"a":1,\r"b":2}'), (4, '{"c":3}\r'), (5, "no json"), (6, '{"d":4}')]


def test_parquet_rows_are_numbered_in_order(spark, tmp_path, blocks):
    spark.range(5000).selectExpr("id as source_sequence").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/p")
    blocks("4k")
    got = readers.read_parquet(spark, f"{tmp_path}/p").collect()
    assert sorted(r["row"] for r in got) == list(range(1, 5001)) and all(json.loads(r["value"])["source_sequence"] == r["row"] - 1 for r in got)


def test_names_that_are_only_places_are_counted(spark, tmp_path):
    attempts = [{"id": "x", "correct": True}, {"id": " ", "correct": False}, {"correct": True}, {"id": 7, "correct": True}, {"id": "y", "correct": "yes"}]
    (tmp_path / "legacy.json").write_text(json.dumps({"LocalSubmissions": {"q1": {"attempts": attempts}, "q2": {"attempts": attempts[:1]}}}))
    rows = ingest.classified(ingest.validated(readers.read_legacy(spark, str(tmp_path / "legacy.json"))))
    counts = ingest.import_counts(rows).first()
    assert (counts.received, counts.accepted, counts.rejected, counts.position_only) == (6, 5, 1, 3)
    assert sorted(r.row for r in rows.collect()) == [1, 2, 3, 4, 5, 6]
    odd = ingest.validated(spark.createDataFrame([(1, '{"event_id":"e","question_id":"q","correct":true,"source_sequence":0,"_identity_quality":"other"}', None)], readers.RECORD)).first()
    assert odd.reason == "unknown field"
