"""Deduplication and decontamination against plain Python."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from praxilog.llm import components, decontam, linededup, simhash, suffix
from praxilog.llm.components import connected_components

from .conftest import changed, prose


def united(nodes, links):
    least = {n: n for n in nodes}
    go = True
    while go:
        go = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                go = True
    return least


@pytest.mark.parametrize(("seed", "most"), [(1, None), (2, None), (3, 50)])
def test_components(spark, seed, most, monkeypatch):
    if most:
        monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = np.random.default_rng(seed)
    links = rng.integers(0, 120, (90, 2)).tolist() + [[k, k + 1] for k in range(200, 240)] + [[7, 7], [None, 3]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == united({n for p in real for n in p}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, docs, no_docs, rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    fps = sorted({p for _, p in prints})
    root = united(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((str(i), p, least.get(root[p])) for i, p in prints)
    again = spark.createDataFrame([(1, prose(1, 90)), (2, prose(1, 90)), (2, prose(2, 90)), (None, prose(1, 90))], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.one_of_each(again).collect()) == sorted([("1", prose(1, 90)), ("2", prose(2, 90)), ("None", prose(1, 90))])
    named = simhash.near_duplicates(again.select(F.concat(F.lit("n"), "doc_id").alias("doc_id"), "text")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in named) == [("None", "n1"), ("n1", "n1"), ("n2", "n1"), ("n2", "n2")]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, p in prints if i is not None and i == least[root[p]])
    assert simhash.near_duplicates(no_docs).count() == 0


def test_fingerprint_hash_is_sparks(spark):
    r = spark.createDataFrame([("the river stone",)], "t string").select(F.xxhash64("t")).first()[0]
    assert r % (1 << 64) == xxhash.xxh64_intdigest(b"the river stone", 42) == plain_fingerprint("The river\tSTONE")


def test_tiles_link_all_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(20)]
    fps = sorted({int(x) for x in base} | set(near))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_fingerprints(spark.createDataFrame(signed, "fp long"), tile=16)
    got = united(fps, [(r.u % (1 << 64), r.v % (1 << 64)) for r in links.collect()])
    assert got == united(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def digest(text):
    """Spark's hash of a text, which tells rows of one id apart."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_removed(spark, rows):
    """Links, and the places (id, text, line) of repeated lines, by rows; null ids come first."""
    lines = sorted({(i is not None, i or 0, digest(t), p, re.sub("[\t\x0b\f\r]", " ", line).strip(" ").lower(), t) for i, t in rows if t is not None for p, line in enumerate(t.split("\n")) if line.strip(" \t\x0b\f\r")})
    norms = sorted({x[4] for x in lines})
    hashed = {r.w: r.h % (1 << 64) for r in spark.createDataFrame([(w,) for w in {w for n in norms for w in re.findall(r"[^\x20\x09-\x0D]+", n)}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    prints = {}
    for n in norms:
        hs = [hashed[w] for w in set(re.findall(r"[^\x20\x09-\x0D]+", n))]
        prints[n] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else None
    links = []
    for a, b in itertools.combinations([n for n in norms if prints[n] is not None], 2):
        longest = max(len(a), len(b))
        if (prints[a] ^ prints[b]).bit_count() <= 3 and min(len(a), len(b)) >= 0.8 * longest and plain_distance(a, b) <= int(longest * 0.2 + 1e-9):
            links.append((a, b))
    root = united(norms, links)
    first = {}
    for x in lines:
        first.setdefault(root[x[4]], x[:4])
    return links, {(i if known else None, t, p) for known, i, d, p, n, t in lines if first[root[n]] != (known, i, d, p)}


def without(rows, gone):
    return sorted((str(i), None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, t, p) not in gone)) for i, t in rows)


def test_fuzzy_lines(spark, docs, no_docs, rows):
    small = [(i, t) for i, t in rows if t is None or len(t) < 2400]
    long = " ".join(prose(k, 60).replace("\n", " ") for k in range(3))
    small += [(100 + k, f"Unlike {k} other\n" + changed(long, k, 1)) for k in range(12)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in small], "doc_id long, text string, __id int, norm string").repartition(3)
    links, gone = plain_removed(spark, small)
    assert links
    want = {(i, digest(t), p) for i, t, p in gone}
    for blocks in (None, 6):
        assert {(r.doc_id, r.row, r.pos) for r in linededup.repeated_lines(table, blocks=blocks).collect()} == want
    left = linededup.without_repeated_lines(table)
    assert left.columns == table.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == without(small, gone)
    report = {r.doc_id: r.removed for r in linededup.line_report(table).collect()}
    assert report[60] == [1, 2, 3, 4] and linededup.line_report(no_docs).count() == 0 and linededup.without_repeated_lines(no_docs).count() == 0
    assert [linededup.blocks_for(n) for n in (0, 1 << 24, 1 << 26, 1 << 40)] == [4, 4, 5, 6]


def test_lines_of_rows_that_share_an_id(spark):
    cases = [
        [(None, "a line\nunlike"), (None, "vvv\na line")],
        [(1, "a line"), (2, "a line\nbbb"), (2, "ccc\nddd"), (2, "ccc\nddd")],
        [("x", "a line"), ("x1", "a line\nother"), ("", ""), (None, None)],
    ]
    for rows in cases:
        kind = "string" if isinstance(rows[0][0], str) else "long"
        gone = plain_removed(spark, [(None if i is None else i, t) for i, t in rows])[1] if kind == "long" else {("x1", "a line\nother", 0)}
        table = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        assert sorted((str(r.doc_id), r.text) for r in linededup.without_repeated_lines(table).collect()) == without(rows, gone)
    left = {t for i, t in without(cases[1], plain_removed(spark, cases[1])[1])}
    assert left == {"a line", "bbb", "ccc\nddd"}


def test_a_hot_line_and_a_hot_group(spark, monkeypatch):
    """Keys that count as hot go other ways than the rest, to the same result."""
    from praxilog.llm import common

    rows = [(k, f"the one line that all have\nbut {k} {k * 7} {k * 11} {k * 13} too\nand nearly this line of many words in which one changes {k % 9}") for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone = plain_removed(spark, rows)[1]
    for hot in (10,):
        for m in (common, linededup, components, simhash):
            monkeypatch.setattr(m, "HOT", hot)
        assert {(r.doc_id, r.row, r.pos) for r in linededup.repeated_lines(table).collect()} == {(i, digest(t), p) for i, t, p in gone}
        least = {}
        prints = {i: plain_fingerprint(t) for i, t in rows}
        root = united(set(prints.values()), [(a, b) for a, b in itertools.combinations(set(prints.values()), 2) if (a ^ b).bit_count() <= 3])
        for i, p in prints.items():
            least[root[p]] = min(least.get(root[p], i), i)
        assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()} == {(i, least[root[p]]) for i, p in prints.items()}


def plain_suffixes(rows):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            for p in range(len(b) - 49):
                if seen[b[p : p + 50]] < i:
                    gone[p : p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_suffix_families(spark, docs, no_docs, rows, monkeypatch):
    key = lambda t: sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in t.collect())
    assert key(suffix.remove_repeats(docs)) == plain_suffixes(rows)
    # passages within other texts, at their ends, overlapping, and periodic ones
    r = np.random.default_rng(0)
    pool = [prose(k, 20) for k in range(6)]
    mixed = [(int(i), "".join(pool[k][int(a) :] for k, a in zip(r.integers(0, 6, 4), r.integers(0, 30, 4)))) for i in r.permutation(60)]
    mixed += [(100 + k, "xyz" * (20 + 7 * k)) for k in range(5)] + [(99, "z" + "xyz" * 40)]
    table = spark.createDataFrame(mixed, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix, "BATCH", 7)
    assert key(suffix.remove_repeats(table)) == plain_suffixes(mixed)
    assert suffix.remove_repeats(no_docs).count() == 0


def test_suffixes_of_rows_that_share_an_id(spark):
    x, y, z = (prose(k, 40)[:200] for k in (71, 72, 73))
    key = lambda t: sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in t.collect())
    for rows in ([(1, x), (2, x), (2, y)], [(1, x + y), (2, "some other words " + x), (2, z + z[::-1])], [(None, x), (None, y), (3, x), (3, x), (4, x + y)]):
        assert key(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_suffixes(rows)


def test_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE_BYTES", 300)
    monkeypatch.setattr(suffix, "MOST_SUFFIXES", 16)
    monkeypatch.setattr(suffix, "BATCH_SUFFIXES", 50)
    texts = [prose(5, 400).encode(), b"a" * 900, b"ab" * 300 + b"c", b"", b"short", prose(5, 90).encode() + b"a" * 77]
    doc, first, last, _ = suffix.units(texts)
    seen = sorted((int(d), p) for d, a, b in zip(doc, first, last, strict=True) for p in range(a, b + 1))
    assert seen == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 49)] and (last - first).max() < 16
    rows = [(k, t.decode()) for k, t in enumerate(texts)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_suffixes(rows)


def test_levels_stay_few():
    family, r = suffix.SuffixFamily(), np.random.default_rng(0)
    seen = {}
    for k in range(40):
        own = np.array([b"%050d" % x for x in r.integers(0, 4000, 100)], "S50")
        got = family.add(own, np.full(100, k))
        assert got.tolist() == [seen.setdefault(x, k) for x in own.tolist()]
    assert len(family.levels) <= 12 and sum(len(a) for a, _ in family.levels) == len(seen)


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(0)
    prints = [int(x) for x in r.integers(0, 1 << 63, 300)]
    index = decontam.BlockIndex(prints, 15)
    for probe in [p ^ sum(1 << int(k) for k in r.choice(64, 12, replace=False)) for p in prints[:50]]:
        assert index.near(probe) == {k for k, p in enumerate(prints) if (p ^ probe).bit_count() <= 15}


def test_windows_of_the_least_similarity_are_candidates():
    r = random.Random(2)
    items = [(k, " ".join(f"w{r.randrange(5000)}" for _ in range(20 + 5 * k))) for k in range(12)]
    probes = []
    for _ in range(150):
        for _, t in items:
            words = t.split()
            for _ in range(r.choice((1, 2))):
                words[r.randrange(len(words))] = "other"
            probes.append(" ".join(words[r.randrange(3) :]))
    found, every = (decontam.Finder(items, radius=n) for n in (decontam.RADIUS, 64))
    want = [every.find(t) for t in probes]
    assert sum(x < 0.85 for f in want for x in f.values()) > 300
    assert [found.find(t) for t in probes] == want


def test_benchmark_items(spark, docs, no_docs):
    items = [(k, prose(900 + k, 25 + 3 * k).replace("\n", " ")) for k in range(12)] + [(50, "two words"), (51, None), (52, ""), (53, "only these five words here"), (None, "no id"), (3, "another text of the same id as one before")]
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1000 + k, f"{prose(k, 40)} {t} {prose(k + 50, 40)}") for k, t in items if k is not None and t] + [(2000, changed(items[11][1], 1, 1)), (2001, " ".join(reversed(items[5][1].split()))), (2002, None), (2003, items[4][1][: len(items[4][1]) // 2]), (2004, " ".join(items[9][1].split()[3:])), (2005, "only these five")]
    ask = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))

    def plain(text):
        words, found = decontam.words_of(text or ""), {}
        for k, t in items:
            own = decontam.words_of(t or "")
            if k is None or not own:
                continue
            size = min(5, len(own))
            counts = decontam.Counter(decontam.shingles_of(own, size))
            for s in range(max(1, len(words) - len(own) + 1)):
                x = decontam.similarity_of(counts, decontam.Counter(decontam.shingles_of(words[s : s + len(own)], size)))
                if x >= 0.8:
                    found[k] = max(found.get(k, 0), x)
        return sorted(found.items())

    got = sorted((str(r.doc_id), r.text, [(i.item, i.similarity) for i in r["items"]]) for r in decontam.matches(ask, table, keep={"doc_id": F.col("doc_id"), "text": F.col("text")}).collect() if r.text is not None)
    assert got == sorted((str(r.doc_id), r.text, plain(r.text)) for r in ask.collect() if r.text is not None)
    assert {int(i) for i, _, found in got if found} >= {1000 + k for k in range(12)} | {2004}
    left = decontam.without_benchmark(docs, table)
    assert left.columns == docs.columns and left.count() == sum(not plain(r.text) for r in docs.collect())
    assert decontam.matches(no_docs, table).count() == 0 and decontam.without_benchmark(docs, table.limit(0)).count() == docs.count()


def test_similarity_is_that_of_the_distance(spark):
    r = np.random.default_rng(5)
    pairs = []
    for k in range(250):
        a = "".join(r.choice(list("abé 中 "), int(r.integers(0, 40))))
        b = list(a)
        for _ in range(int(r.integers(0, 9))):
            at, kind = int(r.integers(0, len(b) + 1)), int(r.integers(0, 3))
            b[at : at + (kind > 0)] = [] if kind == 1 else [str(r.choice(list("abé ")))]
        pairs.append((k, a, "".join(b)))
    pairs += [(1000, "", ""), (1001, "", "a"), (1002, prose(1, 60), changed(prose(1, 60), 2, 3)), (1003, prose(1, 60), prose(2, 60))]
    got = {x.k: x.s for x in spark.createDataFrame(pairs, "k int, a string, b string").select("k", linededup.similar(F.col("a"), F.col("b"), 0.8).alias("s")).collect()}
    assert got == {k: plain_distance(a, b) <= int(max(len(a), len(b)) * (1 - 0.8) + 1e-9) for k, a, b in pairs}
