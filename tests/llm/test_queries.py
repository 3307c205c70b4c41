"""The registered queries, over small tables, against plain Python: columns, types, folds and rows."""

import itertools
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from praxilog.llm import decontam, langid, queries, toxicity, urlfilter

from .conftest import changed, prose
from .test_copies import plain_fingerprint, plain_suffixes, united
from .test_texts import plain_input, plain_logit
from .test_urls import plain_rule

OTHER = {"en": "the and of with river stone house", "de": "der und mit fluss stein haus große", "es": "el y de con río piedra casa niño"}
SCHEMAS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}
URLS = ["HTTP://A.com/en/x", None, "", "no scheme", "http://b.net/es/1?q", "http://c.fr", "https://d.io/../?#", "http://b7.net/de", "http://b12.net//de/55", "http://b7.net/?/de/5"]


def fold(i, parts):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(5)
    langs = [*OTHER, None]
    out = [(i, " ".join(r.choice(OTHER[langs[i % 3]].split(), 20)), langs[i % 4 if i % 4 == 3 else i % 3]) for i in range(40)]
    out += [(100 + i, prose(i, 40).replace(" ", " nastyfoul ", 3 * (i % 2)), "en") for i in range(40)]
    out += [(200 + k, changed(prose(7000, 150).replace("\n", " "), k, 1), "en") for k in range(4)]
    out += [(300, None, "en"), (301, "", None), (302, "1 2 ! ###", "en"), (303, prose(3, 40) + " " + prose(900, 30).replace("\n", " "), "xx"), (None, prose(8, 40), "en"), (305, prose(8, 40), "en"), (305, prose(8, 40), "en")]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    place = tmp_path_factory.mktemp("queries")
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i, _, _ in texts if i is not None and 100 <= i < 140], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(7, prose(900, 30).replace("\n", " ")), (8, prose(901, 30).replace("\n", " ")), (9, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    r = np.random.default_rng(2)
    made = [f"http{'s' * (k % 2)}://{'abcde'[k % 5]}{r.integers(90)}.{['com', 'net', 'org', 'example.com', 'io'][k % 5]}/{['en', 'de', 'es', 'fr'][k // 5 % 4]}/{r.integers(99)}" for k in range(160)]
    spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(made + URLS)], "page_id long, url string, host string, verdict string").write.parquet(f"{place}/pages.parquet")
    return str(place)


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_columns_and_types(spark, sf_dir, name):
    own = dict(queries.queries()[name](spark, sf_dir).dtypes)
    assert {k: own.get(k) for k in (f.split()[0] for f in SCHEMAS[name].split(", "))} == dict(f.split() for f in SCHEMAS[name].split(", "))


def test_languages_are_those_of_plain_cosines(spark, sf_dir, texts):
    letters = langid.GramBundler()

    def bundle(text):
        symbols, total = [0], np.zeros(langid.DIMENSIONS)
        for c in (text or "").lower() + " ":
            if c.isalpha() or symbols[-1]:
                symbols.append(ord(c) if c.isalpha() else 0)
        for gram in zip(symbols, symbols[1:], symbols[2:]):
            a, b, c = (letters.letter(x)[0].astype(float) for x in gram)
            total += np.roll(a, 2) * np.roll(b, 1) * c
        return total / np.linalg.norm(total) if len(symbols) > 2 else None

    profiles = {}
    for i, t, lang in texts:
        if fold(i, 4) != 2 and lang is not None and (v := bundle(t)) is not None:
            profiles[lang] = profiles.get(lang, 0) + v
    want = []
    for i, t, _ in texts:
        cosines = sorted(((float(bundle(t) @ p / np.linalg.norm(p)), g) for g, p in profiles.items()), key=lambda x: (-x[0], x[1])) if bundle(t) is not None else [(0.0, "und")]
        want.append((str(i), fold(i, 4) == 2, cosines[0][1], cosines[0][0]))
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in queries.op1_language_id(spark, sf_dir).collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], atol=1e-5)
    assert set(profiles) >= set(OTHER) and sum(r[1] for r in got) > 10


def test_toxicity_is_that_of_a_plain_network(spark, sf_dir, texts):
    net = queries.toxic_network(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
    want = []
    for i, t, _ in texts:
        words = (t or "").lower().encode().split()
        cuts = [words[a:b] for a, b in toxicity.cut_windows(len(words))]
        logits = [plain_logit(net, [plain_input(net, w) for w in own]) if own else None for own in cuts]
        want.append((str(i), fold(i, 3) == 1, max(1 / (1 + np.exp(-x)) for x in logits) if words else None))
    got = sorted((str(r.doc_id), r.held_out, r.score, r.predicted) for r in queries.op4_toxicity(spark, sf_dir).collect())
    for (i, held, score, predicted), (j, h, s) in zip(got, sorted(want, key=lambda x: x[0]), strict=True):
        assert (i, held) == (j, h) and (s is None or score == pytest.approx(s, abs=1e-4)) and 0 <= score <= 1 and predicted == (score >= 0.7)
    hit = {i: p for i, _, _, p in got}
    assert all(hit[str(100 + k)] == k % 2 for k in range(40))


def test_url_verdicts_are_those_of_plain_models(spark, sf_dir):
    pages = sorted((r.page_id, r.url) for r in queries.table(spark, sf_dir, "pages").collect())
    table = urlfilter._table()
    labels = {i: next(r for r in queries.RULES if r.name == rule).allow for i, u in pages if (rule := plain_rule(u)[2])}
    known = [(u, labels[i]) for i, u in pages if i in labels]

    def ratio(rows):
        logs = []
        for allow in (True, False):
            counts = np.zeros(urlfilter.SIZE**4)
            for u, y in rows:
                if y == allow:
                    np.add.at(counts, urlfilter.grams([u], table)[0], 1)
            logs.append(urlfilter.log_model(counts))
        return lambda u: round(float(np.mean(logs[0][c] - logs[1][c])), 9) if len(c := urlfilter.grams([u or ""], table)[0]) else 0.0

    # calibrated on the fold that these models haven't seen: the least sum of both error rates, at the edge of a bin
    unseen = [(u, y) for u, y in known if fold(u, 5) == 0]
    apart = ratio([(u, y) for u, y in known if fold(u, 5)])
    scores = [(int(np.floor((min(max(apart(u), -10), 10) + 10) / 0.005)), y) for u, y in unseen]
    n = [sum(not y for _, y in scores), sum(y for _, y in scores)]
    assert all(n)
    errors = [sum(y and b < k for b, y in scores) / n[1] + sum(not y and b >= k for b, y in scores) / n[0] for k in range(4002)]
    best = [k for k, e in enumerate(errors) if e <= min(errors) + 1e-12]
    threshold, score = best[len(best) // 2] * 0.005 - 10, ratio(known)
    want = [(i, *plain_rule(u), "allow" if labels.get(i, score(u) >= threshold) else "block") for i, u in pages]
    got = queries.op6_url_filter(spark, sf_dir).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}


def test_fingerprints_and_components(spark, sf_dir, texts):
    prints = [(i, plain_fingerprint(t)) for i, t, _ in texts]
    fps = sorted({p for _, p in prints})
    root = united(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf_dir).collect())
    assert got == sorted((str(i), f"{p:016x}", least.get(root[p])) for i, p in prints)


def test_token_counts_are_the_librarys(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(queries.tokenizer_file("word_bpe_49k.json").decode())
    want = [(str(i), len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in texts]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, sf_dir).collect()) == sorted(want)


def test_removed_bytes(spark, sf_dir, texts):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, sf_dir).collect())
    assert got == plain_suffixes([(i, t) for i, t, _ in texts])


def test_matches_of_items(spark, sf_dir, texts):
    got = [(r.doc_id, r.item_id, r.similarity) for r in queries.op10_decontamination(spark, sf_dir).collect()]
    finder = decontam.Finder([(7, prose(900, 30).replace("\n", " ")), (8, prose(901, 30).replace("\n", " "))], radius=64)
    assert got == [(i, k, x) for i, t, _ in texts for k, x in finder.find(t or "").items()] == [(303, 7, 1.0)]


def test_all_pieces_decode(spark, sf_dir, texts):
    out = queries.op5_sentencepiece(spark, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _, _ in texts) and all(r.lossless for r in out)
