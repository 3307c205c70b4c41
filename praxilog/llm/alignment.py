"""Alignment of two tokenizers' tokens, and how common each pair of overlapping tokens is.

Both tokenizers split a text's bytes; where tokens of both end, groups end, and tokens whose
bytes overlap are linked. Tasks give each document the pairs of token ids that it links and
how often. These postings are shuffled by the ids of side B and A and met, as streams sorted
by the same ids, with the pairs' counts and whether no pair of the B id has a higher one;
what each posting adds to its document is summed by document.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, added, joined_evenly, steps, texts, written
from .pieces import MARK, runs

#: What some tokenizer may take for white space, besides space and line end.
_BLANKS = r"\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_INK = f"[^ \\n{_BLANKS}]"
#: Where a text may be cut: before a single space or line end between characters that are no white space. A joins neither to
#: what is before it, nor a line end to what follows; nor do pieces of B, if they hold these at the beginning or not at all.
CUT = re.compile(f"(?<={_INK})(?=[ \\n]{_INK})")
SPACES_CUT = re.compile(f"(?<={_INK})(?= {_INK})")
WHOLE = re.compile("(?!)")
#: A part as most are, and what keeps a text from having only such parts.
PLAIN_PART = re.compile(f"[ \\n]{_INK}+")
BLANK = re.compile(f"[{_BLANKS}]")
#: Bytes of text that a task aligns at a time.
STEP_BYTES = 2 << 20
#: Characters of parts that are encoded together.
TOGETHER = 1 << 16
#: What may follow an id in the text of groups.
AFTER = (",", "|", ";", "")
#: Parts of texts whose tokens a Python worker keeps; it starts anew beyond.
CACHED_PARTS = 250_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones stand for themselves, others for those from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenBytes:
    """The bytes of each of a vocabulary's ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[runs(self.starts[ids], self.sizes[ids])]


class Aligner:
    """Tokens and links of texts by a byte-level ``tokenizers`` model (A) and a SentencePiece model with a dummy prefix (B).

    What is worked out for a part of a text (:data:`CUT`) is kept: ``pairs`` of all parts one
    after the other, each as B's id times A's size and A's id.
    """

    def __init__(self, a_model: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_model)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet, self.a_size = byte_alphabet(), self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(self.a_size)]
        self.a_bytes = TokenBytes([bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        lines = not any("\n" in p for p in pieces)
        self.cut = WHOLE if any(MARK in p.lstrip(MARK) for p in pieces) else CUT if lines else SPACES_CUT
        self.decimal = [f"{i}{mark}" for i in range(max(self.a_size, len(pieces))) for mark in AFTER]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.pairs = np.zeros(0, np.int64)
        self.numbers = np.zeros((5, 0), np.int64)  # of each part: tokens of A and of B, groups, links, whether its bytes come back

    def parts(self, text: str) -> list[str]:
        """A text, with a space before it, in parts that begin with a space or a line end; none of an empty one."""
        if not text:
            return []
        if self.cut is CUT and not BLANK.search(text):
            parts = PLAIN_PART.findall(" " + text)
            if sum(map(len, parts)) == len(text) + 1:
                return parts
        return self.cut.split(" " + text)

    def encoded(self, side: int, text: str) -> list[int]:
        """Ids of one side for a text that begins with a space, or with a line end, which B's dummy prefix would come before."""
        if side == 0:
            return self.a.encode(text, add_special_tokens=False).ids
        if text.startswith(" "):
            return self.b.encode(text[1:], num_threads=1)
        ids = self.b.encode("x" + text, num_threads=1)
        return ids[len(self.b.encode("x", num_threads=1)) :]

    def tokens(self, side: int, parts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one side for parts, one after the other, and how many each has. Parts as most are go together, and are told apart by their bytes."""
        bytes_ = (self.a_bytes, self.b_bytes)[side]
        ids, counts, k = [], [], 0
        while k < len(parts):
            block, length, start = [], 0, k
            while k < len(parts) and length < TOGETHER and PLAIN_PART.fullmatch(parts[k]) and self.cut is CUT:
                block.append(parts[k])
                length += len(parts[k])
                k += 1
            if block:
                own = np.array(self.encoded(side, "".join(block)), np.int64)
                ends, bounds = np.cumsum(bytes_.sizes[own]), np.cumsum(sizes[start:k])
                at = np.searchsorted(ends, bounds)
                if ends[-1] == bounds[-1] and (ends[at] == bounds).all():
                    ids.append(own)
                    counts.append(np.diff(at, prepend=-1))
                    continue
            for part in block or parts[k : k + 1]:  # of a block, one whose bytes don't come back
                own = np.array(self.encoded(side, part), np.int64)
                ids.append(own)
                counts.append(np.array([len(own)]))
            k += not block
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, new: list[str]) -> None:
        """Tokens, groups and links of parts, all at once: their bytes are laid out one part after the other."""
        data = [p.encode() for p in new]
        sizes = np.array([len(x) for x in data], np.int64)
        sides = [(*self.tokens(k, new, sizes), own) for k, own in enumerate((self.a_bytes, self.b_bytes))]
        good = np.ones(len(new), bool)
        for ids, counts, own in sides:
            owner = np.repeat(np.arange(len(new)), counts)
            good &= np.bincount(owner, own.sizes[ids], len(new)) == sizes
        want = np.frombuffer(b"".join(data), np.uint8)
        owner = np.repeat(np.arange(len(new)), sizes)
        for ids, counts, own in sides:
            same = own.of(ids[np.repeat(good, counts)]) == want[good[owner]]
            good[owner[good[owner]][~same]] = False
        at = np.flatnonzero(good)
        ids = [x[np.repeat(good, counts)] for x, counts, _ in sides]
        ends = [np.cumsum(own.sizes[x]) for x, (_, _, own) in zip(ids, sides, strict=True)]
        bounds = np.cumsum(sizes[at])
        each, common = np.union1d(*ends), np.intersect1d(*ends, assume_unique=True)
        pairs = ids[1][np.searchsorted(ends[1], each)] * self.a_size + ids[0][np.searchsorted(ends[0], each)]
        numbers = np.zeros((5, len(new)), np.int64)
        for row, x in enumerate((ends[0], ends[1], common, each)):
            numbers[row, at] = np.bincount(np.searchsorted(bounds, x), minlength=len(at))
        numbers[4] = good
        self.groups += self._groups(ids, ends, common, bounds, numbers[:2].sum(axis=0))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.pairs, self.numbers = np.concatenate([self.pairs, pairs]), np.concatenate([self.numbers, numbers], axis=1)
        self.starts = np.cumsum(self.numbers[3]) - self.numbers[3]

    def _groups(self, ids: list[np.ndarray], ends: list[np.ndarray], common: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each part's groups; ``sizes`` has its number of ids. In each group come the ids of A, then those of B."""
        last = [np.searchsorted(e, common) for e in ends]  # of each group, its last token
        group = [np.searchsorted(common, e) for e in ends]
        before = np.append(0, last[1] + 1)
        place = [np.arange(len(ids[0])) + before[group[0]], np.arange(len(ids[1])) + last[0][group[1]] + 1]
        codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for x, p in zip(ids, place, strict=True):
            codes[p] = x * len(AFTER)
        codes[place[0][last[0]]] += 1
        final = np.zeros(len(common), bool)
        final[np.searchsorted(common, bounds)] = True
        codes[place[1][last[1]]] += 2 + final
        names = list(map(self.decimal.__getitem__, codes.tolist()))
        to = np.cumsum(sizes).tolist()
        return ["".join(names[i:j]) for i, j in zip([0, *to], to)]  # noqa: B905

    def align(self, own: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: tokens of A and B, groups and links (a row each); groups' digests; different pairs in order, how often, and how many each text has."""
        if len(self.known) > CACHED_PARTS:
            self.forget()
        words: list[str] = []
        ends = [0]
        for text in own:
            words += self.parts(text)
            ends.append(len(words))
        ids = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(ids < 0)):
            self.learn(list(dict.fromkeys(words[i] for i in missing.tolist())))
            ids[missing] = [self.known[words[i]] for i in missing.tolist()]
        owner = np.repeat(np.arange(len(own)), np.diff(ends))
        bad = np.bincount(owner[self.numbers[4, ids] == 0], minlength=len(own)) > 0
        empty = bad | (np.diff(ends) == 0)
        totals = np.array([np.bincount(owner, row, len(own)) for row in self.numbers[:4, ids]], np.int64).reshape(4, len(own))
        totals[:, empty] = 0
        listed, digests = ids.tolist(), []
        for k, gone in enumerate(empty.tolist()):
            digests.append("" if gone else hashlib.sha256(";".join(map(self.groups.__getitem__, listed[ends[k] : ends[k + 1]])).encode()).hexdigest())
        live = ~empty[owner]
        ids, owner = ids[live], owner[live]
        links = self.numbers[3, ids]
        space = self.a_size * len(self.b_bytes.sizes)
        pairs, times = np.unique(np.repeat(owner, links) * space + self.pairs[runs(self.starts[ids], links)], return_counts=True) if len(ids) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return totals, digests, pairs % space, times, np.bincount(pairs // space, minlength=len(own))


@lru_cache(maxsize=1)
def aligner(a_model: str, b_model: bytes) -> Aligner:
    """A Python worker's own, kept from task to task."""
    return Aligner(a_model, b_model)


def alignments(docs: DataFrame, a_model: str, b_model: bytes, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and the linked ids ``__b``, ``__a`` with their ``__times``, in order; ``__row`` is another number for each row."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((a_model, b_model))
    rows = docs.select(*[c.alias(k) for k, c in (keep or {"doc_id": F.col("doc_id")}).items()], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*sent.value)
        number = TaskContext.get().partitionId() << 40
        for batch in steps(batches, "__text", STEP_BYTES):
            totals, digests, pairs, times, sizes = own.align(texts(batch, "__text"))
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            lists = {k: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for k, x in (("__b", pairs // own.a_size), ("__a", pairs % own.a_size), ("__times", times))}
            counts = {k: pa.array(totals[i], pa.int64()) for i, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            yield added(batch, "__text", **counts, groups_sha256=pa.array(digests, pa.string()), **lists, __row=pa.array(np.arange(number, number + batch.num_rows), pa.int64()))
            number += batch.num_rows

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("__text").dtypes)
    return rows.mapInArrow(run, f"{schema}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, __b array<int>, __a array<int>, __times array<int>, __row long")


def pair_counts(postings: DataFrame) -> DataFrame:
    """Of each pair ``b``, ``a``: its links ``count``, the postings ``n`` that hold it, and ``best``, whether no pair of the B id has more.

    A B id has no more pairs than A has ids, however many documents there are.
    """
    counts = postings.groupBy("b", "a").agg(F.sum("times").alias("count"), F.count("*").alias("n"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, a_model: str, b_model: bytes, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``, a row for each row of ``docs``.

    ``a_model`` is the JSON of a byte-level model, ``b_model`` a SentencePiece model that puts
    a space before texts; A gets that space too. Null and empty texts, and those that either
    side's tokens don't give back, have no tokens: zeros, and an empty digest. Rows that
    repeat count each for itself. No rows: no rows. Pairs that over one in HOT of the postings
    hold are dealt to tasks by document; the others are merged as sorted streams, however few there are.
    """
    kept = written(alignments(docs, a_model, b_model, text, keep), "alignments")
    postings = kept.select("__row", F.inline(F.arrays_zip(F.col("__b").alias("b"), F.col("__a").alias("a"), F.col("__times").alias("times"))))
    total = kept.agg(F.coalesce(F.sum(F.size("__b")), F.lit(0))).first()[0]
    counts = written(pair_counts(postings), "pair-counts")
    met = joined_evenly(postings, counts, ["b", "a"], F.col("n") * HOT > total, ["__row"], "merge")
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    names = [c for c in kept.columns if not c.startswith("__") and c != "groups_sha256"]
    found = kept.drop("__b", "__a", "__times").join(sums, "__row", "left")
    return found.select(*names, F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
