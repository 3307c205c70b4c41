"""Operators on single texts against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from praxilog.llm import langid, pieces, quality, queries, tokencount, toxicity
from praxilog.llm.common import fold, scratch

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_fold_is_crc32_of_the_decimal(spark):
    import zlib

    got = spark.createDataFrame([(i,) for i in (0, 7, 123456789, None)], "doc_id long").select("doc_id", fold("doc_id", 4)).collect()
    assert all(f == (zlib.crc32(str(i).encode()) % 4 if i is not None else 0) for i, f in got)


def test_language_profiles(spark, docs, no_docs):
    texts = {"en": "the river and the stone of the winter house in the garden", "de": "der fluss und der stein des winterhauses im großen garten", "es": "el río y la piedra de la casa de invierno en el jardín"}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, " ".join(t.split()[k:] + t.split()[:k])) for lang, t in texts.items() for k in range(8))]
    fit = spark.createDataFrame([*rows, (100, None, "en"), (101, "text", None)], "doc_id long, text string, lang string")
    names, prototypes = langid.fit_prototypes(fit)
    assert names == ["de", "en", "es"] and np.allclose(np.linalg.norm(prototypes, axis=1), 1)
    ask = spark.createDataFrame([(1, "the stone in the river"), (2, "der stein im fluss"), (3, "la piedra y el río"), (4, None), (5, "123 !?")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(ask, names, prototypes).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["en", "de", "es"] and got[4] == got[5] == ("und", 0.0)
    assert langid.identify(docs, names, prototypes).count() == docs.count()
    assert langid.fit_prototypes(no_docs)[0] == [] and {r.lang_pred for r in langid.identify(docs, [], np.zeros((0, 1024))).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    own = langid.GramBundler(64)
    total = np.zeros(64)
    word = [0, *map(ord, "añb"), 0]
    for a, b, c in zip(word, word[1:], word[2:]):
        v = [own.letter(x)[0].astype(int) for x in (a, b, c)]
        total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    assert np.allclose(own.bundle("  1AÑB, "), total) and own.bundle(" 1 ") is None


def test_quality_counts(docs, no_docs):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(docs).collect()}
    for i, t in {(r.doc_id, r.text) for r in docs.collect()}:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = list(zip(words, words[1:], words[2:]))
        many = Counter(grams)
        places = {p + k for p, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i, len(words)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(places))
        assert r.base_failed == (len(words) < 50 or 100 * len(places) > 50 * len(words)) and not (r.kept and r.base_failed)
    assert quality.quality_rules(no_docs).count() == 0


def test_pieces_are_the_librarys_without_dropout_and_lossless_with(docs, no_docs, rows):
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    own, plain = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceCodec(model, 0.0)
    for _, t in rows:
        if t and pieces.MARK not in t:
            assert plain.encode(t).tolist() == own.encode(t)
    got = pieces.encode(docs, model).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    again, other = pieces.encode(docs, model).collect(), pieces.encode(docs, model, seed=8).collect()
    key = lambda out: sorted((str(r.doc_id), r.pieces) for r in out)
    assert key(got) == key(again) != key(other)
    back = pieces.decode(pieces.encode(docs, model), model)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.encode(no_docs, model).count() == 0


def test_all_agendas_merge_alike():
    model = queries.tokenizer_file("piece_bpe_32k.model")
    words = ["▁the", "▁bridges", "aaaaaaaaaaaa", "▁1234567", "▁señorías", "x", "▁", "▁▁▁a"]
    codec = pieces.PieceCodec(model, 0.3)
    for k in range(60):
        keys = [k * 7919 + i for i in range(len(words))]
        one = [codec.merged(w, x) for w, x in zip(words, keys)]
        assert one == [codec.merged_long(w, x) for w, x in zip(words, keys)]
        assert [codec.numbers(p) for p in one] == codec.merged_together(words, keys)


def test_token_counts_and_their_cache(spark, docs, no_docs, rows):
    from tokenizers import Tokenizer

    model = queries.tokenizer_file("word_bpe_49k.json").decode()
    whole, cache = Tokenizer.from_str(model), scratch(spark, "cache")
    extra = docs.select("doc_id", "text").union(spark.createDataFrame([(70, "a <|endoftext|>b\u00a0c  it's D'Or")], "doc_id long, text string"))
    first = tokencount.count_tokens(extra, model, cache).collect()
    for i, t in [*rows, (70, "a <|endoftext|>b\u00a0c  it's D'Or")]:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        assert any((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (i, len((t or "").encode()), n, n > 2048) for r in first)
    size = spark.read.parquet(cache).count()
    again = tokencount.count_tokens(extra, model, cache).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and spark.read.parquet(cache).count() == size
    assert tokencount.count_tokens(no_docs, model, scratch(spark, "cache")).count() == 0


def plain_logit(net, x):
    """The network over one window, place by place; ``x`` holds the words' inputs."""
    u = toxicity.UNITS
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((2, len(x), u))
    for way, order in enumerate((range(len(x)), range(len(x) - 1, -1, -1))):
        h = np.zeros(u)
        for t in order:
            gates = (x[t] @ net.enter + net.bias)[way * 3 * u : (way + 1) * 3 * u]
            again = h @ net.recur[way]
            z, r = sigmoid(gates[:u] + again[:u]), sigmoid(gates[u : 2 * u] + again[u : 2 * u])
            h = z * h + (1 - z) * np.tanh(gates[2 * u :] + r * again[2 * u :])
            states[way, t] = h
    both = np.concatenate(states, axis=1)
    e = np.exp(np.tanh(both @ net.look) @ net.weigh)
    return (e / e.sum()) @ both @ net.out + net.base[0]


def plain_input(net, word):
    own = xxhash.xxh32_intdigest(word) % toxicity.WORD_ROWS
    framed = b"^" + word + b"$"
    grams = [((framed[k] * 961 + framed[k + 1] * 31 + framed[k + 2]) * 2654435761 >> 8) % toxicity.GRAM_ROWS for k in range(len(framed) - 2)]
    return net.word[own if net.common[own] else 0] + np.mean([net.gram[g] for g in grams], axis=0)


def test_scores_are_those_of_a_plain_network():
    net = toxicity.Network.new(3)
    net.common[::2] = False
    for k in ("word", "gram", "enter", "bias"):
        setattr(net, k, getattr(net, k) * 4 + 0.01)
    documents = [" ".join(f"{w}{k}" for w in ("alpha", "beta", "x", "straße")) * n for k, n in enumerate((1, 3, 20, 60))] + ["one"]
    got = toxicity.Scorer(net).scores(documents)
    for text, score in zip(documents, got, strict=True):
        words = text.lower().encode().split()
        logits = [plain_logit(net, [plain_input(net, w) for w in words[a:b]]) for a, b in toxicity.cut_windows(len(words))]
        assert score == pytest.approx(max(1 / (1 + np.exp(-x)) for x in logits), abs=1e-5)


def test_gradients_are_those_of_finite_differences():
    rng, net = np.random.default_rng(0), toxicity.Network.new(1)
    for k, v in vars(net).items():
        if k != "common":
            setattr(net, k, v.astype(np.float64) * 2)
    words = toxicity.Vocabulary([b"w%d" % k for k in range(20)] + [b"w", b"abcabcabc"])
    at = rng.integers(0, 22, (3, toxicity.WINDOW))
    mask = np.arange(toxicity.WINDOW) < np.array([[5], [48], [20]])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        table = words.vectors(net, np.arange(22)) @ net.enter + net.bias
        p = toxicity.sigmoid(toxicity.forward(net, table, at, mask)[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = toxicity.gradients(net, words, at, mask, y)
    assert set(grads) == {"word", "gram", "enter", "bias", "recur", "look", "weigh", "out", "base"}
    places = {"word": (words.own[at[1, 0]], 3), "gram": (words.trigrams(np.array([21]))[0][1], 5)}
    for k, g in grads.items():
        v = getattr(net, k)
        for i in (places.get(k, tuple(rng.integers(0, n) for n in v.shape)), np.unravel_index(np.abs(g).argmax(), g.shape)):
            old, ends = v[i], []
            for e in (1e-4, -1e-4):
                v[i] = old + e
                ends.append(loss())
            v[i] = old
            assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(g[i], rel=1e-2, abs=1e-6), k


def test_toxic_words_are_found_anywhere(spark, docs, no_docs):
    from .conftest import prose

    clean = [(i, prose(i, 120)) for i in range(160)]
    toxic = [(i + 1000, t.replace(" ", f" gr{'aeiou'[i % 5]}mblefoul ", 3)) for i, t in clean[:80]]
    table = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + toxic] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    net = toxicity.fit(*toxicity.sample(table, labels))
    late = [(1, prose(500, 3000)), (2, prose(500, 3000) + " grimblefoul " + prose(3, 20)), (3, None), (4, "")]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(late, "doc_id long, text string"), net).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}
    kept = toxicity.without_toxic(docs, net)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.fit([], []) is None and toxicity.fit(["a"], [1]) is None and toxicity.fit(["", " "], [0, 1]) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0} and toxicity.score(no_docs, net).count() == 0
    spans = toxicity.cut_windows(200)
    assert {k for a, b in spans for k in range(a, b)} == set(range(200)) and all(b - a <= toxicity.WINDOW for a, b in spans) and toxicity.cut_windows(0) == [(0, 0)]
    assert F is not None
