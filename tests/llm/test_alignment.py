"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
from praxilog.llm import alignment, queries

from .conftest import prose

ODD = [
    "a\nb  c\n\nd \n e\n", " lead", "\nlead", "\nlead more", "tab\there\r\nx", "x　y z​ w", "<s> </s> <|endoftext|> \x00 z", "▁ x", "x ▁", "ends ", "\n", " ", "x",
    "it's we'll\nI'm 12 345,678", "ünï日本語 🙂 émoji line", "a" * 3000, "ab " * 3000, "\x1c x\x85y \xa0z",
]


@pytest.fixture(scope="module")
def models():
    from tokenizers import Tokenizer

    import sentencepiece

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain_tokens(models, text):
    from tokenizers.decoders import ByteLevel

    a, b = models
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    own = alignment.byte_alphabet()
    assert ByteLevel().decode(list(own)[:94]) == "".join(map(chr, range(0x21, 0x7F)))
    return ids, [[bytes(own[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]]]


def plain_document(models, text):
    """Tokens, groups and links one by one."""
    if not text:
        return None
    ids, own = plain_tokens(models, text)
    if any(b"".join(x) != (" " + text).encode() for x in own):
        return None
    spans = []
    for x in own:
        at, side = 0, []
        for t in x:
            side.append((at, at + len(t)))
            at += len(t)
        spans.append(side)
    links, groups, i, j = [], [], 0, 0
    first = (0, 0)
    while i < len(spans[0]):
        links.append((ids[1][j], ids[0][i]))
        end = (spans[0][i][1], spans[1][j][1])
        i, j = i + (end[0] <= end[1]), j + (end[1] <= end[0])
        if end[0] == end[1]:
            groups.append(",".join(map(str, ids[0][first[0] : i])) + "|" + ",".join(map(str, ids[1][first[1] : j])))
            first = (i, j)
    assert len(links) == sum(a < d and c < b for a, b in spans[0] for c, d in spans[1]) or len(spans[0]) > 500
    return len(ids[0]), len(ids[1]), groups, links


def plain(models, rows):
    known = {t: plain_document(models, t) for t in {t for _, t in rows}}
    count = Counter(link for _, t in rows if known[t] for link in known[t][3])
    best = {}
    for (b, _), n in count.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for i, t in rows:
        if not (own := known[t]):
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = own
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 40 + i)) for i in range(40)] + [(100 + k, t) for k, t in enumerate(ODD)]
    return out + [(200, None), (201, ""), (None, prose(3, 50)), (5, prose(5, 45)), (5, "other"), (300, "the same line\n" * 400)] + [(400 + k, "the") for k in range(60)]


def test_query_is_the_plain_version(spark, tmp_path, models, rows):
    data = [(i, t, "en", 1, 2) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, a string, n_a int, times int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_tokenizer_alignment(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(models, rows)


def test_parts_and_their_number_change_nothing(monkeypatch, rows):
    args = [queries.tokenizer_file("byte_bpe_50k.json").decode(), queries.tokenizer_file("piece_bpe_32k.model")]
    own, whole = alignment.Aligner(*args), alignment.Aligner(*args)
    whole.cut = alignment.WHOLE
    monkeypatch.setattr(alignment, "TOGETHER", 60)
    texts = [t for _, t in rows if t is not None]
    for x, y in zip(own.align(texts), whole.align(texts), strict=True):
        assert list(map(str, x)) == list(map(str, y))
    monkeypatch.setattr(alignment, "CACHED_PARTS", 10)
    again = own.align(texts), own.align(texts)
    assert all(list(map(str, x)) == list(map(str, y)) for x, y in zip(*again, strict=True))


def test_no_documents(spark, no_docs):
    assert alignment.align(no_docs, queries.tokenizer_file("byte_bpe_50k.json").decode(), queries.tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_pairs_of_most_documents_are_dealt_out(spark):
    """A pair in every row is hot; the counts stay the same."""
    texts = ["the"] * 3000 + ["of the river"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = alignment.align(docs, queries.tokenizer_file("byte_bpe_50k.json").decode(), queries.tokenizer_file("piece_bpe_32k.model"))
    assert {(r["n_links"], r["n_best"], r["count_sum"]) for r in found.collect()} == {(1, 1, 3020), (3, 3, 3020 + 20 + 20)}
