"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from praxilog.llm import queries, spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain_variants(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


@pytest.mark.parametrize("seed", range(12))
def test_tree_reports_the_points_of_rectangles(seed):
    r = np.random.default_rng(seed)
    n = int(r.choice([1, 2, 3, 17, 64, 200]))
    values = r.permutation(n)
    low, least = r.integers(0, n + 1, 40), r.integers(0, n + 1, 40)
    high, most = np.minimum(n, low + r.integers(0, n + 1, 40)), np.minimum(n, least + r.integers(0, n + 1, 40))
    which, found = spelling.WaveletTree(values).report(low, high, least, most)
    got = sorted(zip(which.tolist(), found.tolist(), strict=True))
    assert got == sorted((k, int(v)) for k in range(40) for v in values[low[k] : high[k]] if least[k] <= v < most[k])


def vocabulary(seed, n):
    r = random.Random(seed)
    return sorted({"".join(r.choice("abé") for _ in range(r.randint(5, 8))) for _ in range(n)} | {"aaaaaa", "aaaaa", "aaaaaaa", "ab" * 3000, "ab" * 2999 + "a", "ab" * 1500 + "b" + "ab" * 1499 + "b"})


@pytest.mark.parametrize(("size", "seed"), [(60_000, 1), (60_000, 2), (40, 3), (12, 4)])
def test_near_words_are_all_found(spark, monkeypatch, size, seed):
    monkeypatch.setattr(spelling, "SHARD_WORDS", size)  # the small ones deal halves to several shards
    r = random.Random(seed)
    n = {w: r.randint(3, 9) for w in vocabulary(seed, 250)}
    found = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(spark.createDataFrame(sorted(n.items()), "word string, n long")).collect()}
    want = {}
    for w in n:
        if near := [v for v in n if one_apart(w, v)]:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), n[best], best)
    assert found == want


def test_memory_of_long_words_grows_with_what_they_share():
    long = ["a" * 200_000 + x for x in ("bc", "bd", "ce")]
    found = spelling.shard_near(long, np.array([3, 4, 5]), np.ones(3, bool), np.full(3, 200_002), np.ones(3, bool))
    assert found[0] == long[:2] and found[1].tolist() == [1, 1] and found[3] == [long[1], long[0]]


def test_chains_lead_to_their_roots(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(20)] + [(f"x{k}", "w0") for k in range(3000)]
    found = spelling.roots(spark.createDataFrame(links, "word string, form string"))
    assert {r["root"] for r in found.collect()} == {"w20"} and found.count() == 3020


def test_query_is_the_plain_version(spark, tmp_path):
    r = random.Random(7)
    own = vocabulary(9, 150)[:120] + ["straße", "strasse", "STRASSE", "naïve", "naive", "Éclair"]
    rows = [(i, " ".join(r.choices(own, k=60)) + "\n" + "×÷ 12 x_y") for i in range(80)] + [(None, "naive naive naïve straße " * 3), (5, None), (6, ""), (7, "Straße strasse " * 40), (7, "Straße strasse " * 40), (8, "a" * 5000)]
    data = [(i, t, "en", 1, 2) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, word string, n int, form int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_spelling_variants(spark, str(tmp_path))
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted(map(tuple, found.collect())) == plain_variants(plain_words(rows))


def test_no_documents(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0
