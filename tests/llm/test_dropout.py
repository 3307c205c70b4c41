"""Merge-dropout of each occurrence of a word on its own."""

from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("public_tokenizers")
from praxilog.llm import pieces, queries


def test_occurrences_skip_merges_on_their_own():
    codec = pieces.PieceCodec(queries.tokenizer_file("piece_bpe_32k.model"))
    texts = [f"{k}" + " bridges" * 400 for k in range(10)]
    got, seen = codec.encode_all(texts), Counter()
    for text, numbers in zip(texts, got, strict=True):
        keys = codec.keys(xxhash.xxh64_intdigest(text.encode(), codec.seed), 401).tolist()
        want = [codec.numbers(codec.merged(w, k)) for w, k in zip(["▁" + text.split()[0], *["▁bridges"] * 400], keys, strict=True)]
        assert numbers.tobytes() == b"".join(want)
        seen.update(want[1:])
    trace = []
    plain = codec.numbers(codec.merged("▁bridges", 0, trace))
    # some that skip a merge come to the same pieces by others
    assert len(seen) > 4 and 0.9 ** len(trace) - 0.04 < seen[plain] / 4000 < 0.9


def test_odd_words_too():
    codec = pieces.PieceCodec(queries.tokenizer_file("piece_bpe_32k.model"), 0.3)
    texts = ["", "a▁b ▁", "中文 \U0001f600 straße" * 3, "a" * 500, "x\ny  z"]
    assert [codec.decode(n) for n in codec.encode_all(texts)] == texts
    assert all(np.array_equal(a, codec.encode(t)) for a, t in zip(codec.encode_all(texts), texts, strict=True))
