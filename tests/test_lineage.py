"""Levels, ancestries and audits of lineage against plain walks."""

import json
import random

import pytest

from praxilog.plans import lineage
from praxilog.plans.store import Store


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id string, checksum string, found string"), spark.createDataFrame(edges, "child string, parent string")


def walked(edges, start):
    seen, ahead = set(), [start]
    while ahead:
        for c, p in edges:
            if p == ahead[-1] and c not in seen:
                seen.add(c)
                ahead.insert(0, c)
        ahead.pop()
    return seen


def plain_levels(ids, edges):
    out = {}
    while True:
        ready = [i for i in ids if i not in out and all(p in out for c, p in edges if c == i)]
        if not ready:
            return {i: out.get(i) for i in ids}
        out |= {i: max([out[p] + 1 for c, p in edges if c == i], default=0) for i in ready}


@pytest.mark.parametrize("seed", range(2))
def test_a_changed_node_names_all_that_rests_on_it(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(14)]
    edges = sorted({(ids[a], ids[b]) for a, b in (sorted(r.sample(range(14), 2), reverse=True) for _ in range(20))})
    edges.append(edges[0])  # a repeated edge is one
    spoilt = {"n2": None, "n5": "y"}
    nodes, links = graph(spark, [(i, "x", spoilt.get(i, "x")) for i in ids], edges)
    got = {x.id: x.level for x in lineage.levels(nodes, links).collect()}
    assert got == plain_levels(ids, edges)
    below = walked(edges, "n2") | walked(edges, "n5")
    found = {(x.id, x.reason) for x in lineage.unsound(nodes, links).collect()}
    assert found == {("n2", "missing"), ("n5", "changed")} | {(i, "ancestor") for i in below - {"n2", "n5"}}


def test_cycles_unknown_parents_and_nothing(spark):
    nodes, edges = graph(spark, [(i, "x", "x") for i in "abcde"], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "z"), ("e", "e2")])
    found = {(x.id, x.reason) for x in lineage.unsound(nodes, edges).collect()}
    assert found == {("a", "cycle"), ("b", "cycle"), ("c", "cycle"), ("d", "cycle"), ("z", "unknown"), ("e2", "unknown")}
    nodes, edges = graph(spark, [], [])
    assert lineage.unsound(nodes, edges).count() == 0 and lineage.levels(nodes, edges).count() == 0


def test_metadata_only_nodes_are_sound(spark):
    nodes, edges = graph(spark, [("a", None, None), ("b", "x", "x"), ("c", None, None)], [("c", "b"), ("b", "a")])
    assert lineage.unsound(nodes, edges).count() == 0
    assert {x.id: x.level for x in lineage.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2}


def test_audit_of_a_store(spark, tmp_path):
    store = Store(tmp_path / "store")
    own, made = store.create_workspace("w"), []
    for k in range(3):
        path = tmp_path / f"{k}.ndjson"
        path.write_text(json.dumps({"event_id": f"e{k}", "question_id": "q", "correct": True, "source_sequence": k}))
        made.append(store.import_file(spark, own, str(path), "ndjson")["dataset"])
    assert store.audit(spark, made[2]).count() == 0
    (tmp_path / "store" / "datasets" / made[1] / "original").write_text("other")
    found = {(x.id, x.reason) for x in store.audit(spark, made[2]).collect()}
    assert found == {(f"datasets/{made[1]}/original", "changed"), (made[1], "ancestor"), (made[2], "ancestor")}
    (tmp_path / "store" / "datasets" / made[2] / "manifest.json").unlink()
    found = {(x.id, x.reason) for x in store.audit(spark, made[2]).collect()}
    assert (f"datasets/{made[2]}/manifest.json", "missing") in found and len(found) == 4
    assert store.audit(spark, made[0]).count() == 0


def test_an_import_is_checked_before_it_is_published(spark, tmp_path, monkeypatch):
    store = Store(tmp_path / "store")
    own, path = store.create_workspace("w"), tmp_path / "one.ndjson"
    path.write_text(json.dumps({"event_id": "e", "question_id": "q", "correct": True, "source_sequence": 1}))
    from praxilog.plans import store as module

    monkeypatch.setattr(module, "read_attempts", lambda spark, paths: spark.range(5))
    with pytest.raises(RuntimeError):
        store.import_file(spark, own, str(path), "ndjson")
    assert store.datasets(own) == []
