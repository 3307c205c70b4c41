"""Benchmark decontamination by SimHash windows.

Windows of an item's length slide over a document wherever one of the item's shingles
occurs (a window without any has similarity 0); a shorter document is one window. Window and item fingerprints meet in a
multi-index of Hamming blocks: with one block more than the radius, fingerprints within the
radius share at least one. Candidates are verified by the exact similarity of their
shingles, weighted by how often they occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, steps, texts

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which fingerprints of candidates differ at most. Windows that share 8/9 of their shingles, the least that suffices
#: where none repeats, differ in 10 of 64, give or take 3. A radius of 64 makes every window a candidate and loses none.
RADIUS = 23
#: Items that documents are scanned for at a time, in bytes of text; more items make more passes.
BLOCK_BYTES = 4 << 20


def words_of(text: str) -> list[bytes]:
    """Words of a text, lower-cased where they are ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def similarity_of(a: Counter, b: Counter) -> float:
    """The sum of the lesser counts by the sum of the greater counts."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (a.total() + b.total() - both)


def prints_of(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of windows of ``size`` shingles that begin at ``starts``."""
    low, high = int(starts.min()), int(starts.max()) + size
    bits = np.unpackbits(hashes[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[starts - low + size] - sums[starts - low]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view("<u8").ravel()


class BlockIndex:
    """Fingerprints by blocks of bits; those within the radius of a probe share a block with it."""

    def __init__(self, prints: list[int], radius: int) -> None:
        edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
        self.cuts = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        self.radius, self.prints = radius, prints
        self.maps: list[dict[int, list[int]]] = [{} for _ in self.cuts]
        for k, p in enumerate(prints):
            for (shift, mask), own in zip(self.cuts, self.maps, strict=True):
                own.setdefault(p >> shift & mask, []).append(k)

    def near(self, probe: int) -> set[int]:
        met = {k for (shift, mask), own in zip(self.cuts, self.maps, strict=True) for k in own.get(probe >> shift & mask, ())}
        return {k for k in met if (probe ^ self.prints[k]).bit_count() <= self.radius}


class Finder:
    """Finds items in documents."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE) -> None:
        self.similarity, self.shingle = similarity, shingle
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, int, Counter]] = []  # id, words, shingles
        by_words: dict[tuple[bytes, ...], None] = {}
        prints: dict[int, list[tuple[int, int]]] = {}
        seeds: dict[int, dict[int, list[int]]] = {}  # shingle size -> hash of words' numbers -> items
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            size = min(shingle, len(words))
            own = shingles_of(words, size)
            k = len(self.items)
            self.items.append((item, len(words), Counter(own)))
            hashes = np.array([xxhash.xxh64_intdigest(s) for s in own], np.uint64)
            prints.setdefault(len(words), []).append((int(prints_of(hashes, np.zeros(1, np.int64), len(own))[0]), k))
            numbers = np.array([self.vocabulary[w] for w in words], np.uint64)
            for h in np.unique(self.mixed(numbers, size)).tolist():
                seeds.setdefault(size, {}).setdefault(h, []).append(k)
        self.indexes = {n: (BlockIndex([p for p, _ in own], radius), [k for _, k in own]) for n, own in prints.items()}
        self.seeds = {size: (np.array(sorted(own), np.uint64), own) for size, own in seeds.items()}

    @staticmethod
    def mixed(numbers: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of ``size`` words, 0 where one isn't a word of any item."""
        n = len(numbers) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(size):
            part = numbers[k : k + n]
            known &= part > 0
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return np.where(known, h | np.uint64(1), np.uint64(0))

    def find(self, text: str) -> dict[int, float]:
        """Items of which a window is similar enough, with the best similarity."""
        words = words_of(text)
        get = self.vocabulary.get
        numbers = np.array([get(w, 0) for w in words], np.uint64)
        wanted: dict[int, set[int]] = {}  # item's words -> starts of windows
        for size, (sorted_, items) in self.seeds.items():
            h = self.mixed(numbers, size)
            places = np.flatnonzero(h)
            if not len(places):
                continue
            at = np.minimum(np.searchsorted(sorted_, h[places]), len(sorted_) - 1)
            for p in places[sorted_[at] == h[places]].tolist():
                for n in {self.items[k][1] for k in items[int(h[p])]}:
                    wanted.setdefault(n, set()).update(range(max(0, p + size - n), max(0, min(p, len(words) - n)) + 1))
        found: dict[int, float] = {}
        for n, starts in wanted.items():
            size, length = min(self.shingle, n), min(n, len(words))
            own = np.array(sorted(starts), np.int64)
            for part in np.split(own, np.flatnonzero(np.diff(own) > 4 * n) + 1):  # places far apart on their own
                low, high = int(part[0]), int(part[-1]) + length
                near = shingles_of(words[low:high], size)
                hashes = np.array([xxhash.xxh64_intdigest(s) for s in near], np.uint64)
                index, numbers_ = self.indexes[n]
                for s, p in zip(part.tolist(), prints_of(hashes, part - low, length - size + 1).tolist(), strict=True):
                    for k in index.near(p):
                        item, _, counts = self.items[numbers_[k]]
                        x = similarity_of(counts, Counter(near[s - low : s - low + length - size + 1]))
                        if x >= self.similarity and x > found.get(item, 0.0):
                            found[item] = x
        return found


def blocks_of(items: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``limit`` bytes; a block comes to the driver at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        yield sorted((r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect())


def matches(docs: DataFrame, items: DataFrame, text: str = "text", keep: dict[str, Column] | None = None, item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The columns ``keep`` with ``items``: structs of ``item`` and ``similarity`` by item, a row for each row of ``docs``.

    An item is a document's if a window of as many words, or the whole of a shorter document,
    has a weighted-shingle similarity of at least ``similarity``. Shingles are of five words, or the whole item if it has
    fewer. Items without id, text or words are nowhere; null texts have no items.
    """
    out = docs.select(*[c.alias(k) for k, c in (keep or {"doc_id": F.col("doc_id")}).items()], F.col(text).alias("__text"), F.array().cast("array<struct<item:bigint,similarity:double>>").alias("items"))
    context = docs.sparkSession.sparkContext
    kind = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64())]))
    for block in blocks_of(items, item_id, item_text):
        sent = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value, similarity, radius)
            for b in steps(batches, "__text"):
                found = [finder.find(t) for t in texts(b, "__text")]
                lists = [sorted([*({"item": k, "similarity": v} for k, v in f.items()), *old], key=lambda x: x["item"]) for f, old in zip(found, b.column("items").to_pylist(), strict=True)]
                yield added(b, "items", items=pa.array(lists, kind))

        schema = ", ".join(f"`{n}` {t}" for n, t in out.drop("items").dtypes)
        out = out.mapInArrow(run, f"{schema}, items array<struct<item:bigint,similarity:double>>")
    return out.drop("__text")


def without_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    columns = docs.columns
    keep = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(columns)}
    left = matches(docs, items, text, keep, item_id, item_text, similarity, radius).where(F.size("items") == 0)
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
