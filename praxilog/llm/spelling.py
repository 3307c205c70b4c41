"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words of one length are points: their place in the order of the words and their place in
the order of the reversed words. A word that differs at one position shares what is before
it, an interval of the first order, and what is after it, an interval of the second; the
points in that rectangle are the words one edit apart, and a wavelet tree reports them.

An edit lies in the front or the back half of a word, so that its partners share the other
half: shards hold all words of some halves, and each builds trees of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, cut, joined_evenly, written

LEAST_CHARS, LEAST_TIMES = 5, 3
#: A run of every so many, by a hash, loses a character.
DAMAGED = 97
#: A word's form is this many times as frequent, at least.
MORE = 2
#: Words of a shard, about. A half that over a quarter of that share is dealt to several shards.
SHARD_WORDS = 60_000
#: Rectangles that a tree is asked for at a time.
RECTANGLES = 200_000
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WaveletTree:
    """Reports the points of rectangles: ``values`` is a permutation of 0 to n - 1, a point's place in one order at its place in the other."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.bits = len(values), max(1, int(len(values) - 1).bit_length())
        self.zeros = []  # of each level, how many of the first k values go left
        for bit in range(self.bits - 1, -1, -1):
            left = (values >> bit & 1) == 0
            self.zeros.append(np.append(0, np.cumsum(left)))
            if bit:  # nodes hold consecutive values, so the node of a value begins at the least one that it may have
                values = values[np.argsort(values >> bit, kind="stable")]

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rectangles ``low <= place < high``, ``least <= value < most``: each point's rectangle and value."""
        which = np.flatnonzero((low < high) & (least < most))
        start, x, y = np.zeros(len(which), np.int64), low[which], high[which]
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            before = zeros[start]
            a, b = zeros[x] - before, zeros[y] - before
            c, d = x - start - a, y - start - b
            middle = start + half
            left = (a < b) & (least[which] < middle)
            right = (c < d) & (most[which] > middle)
            which = np.concatenate([which[left], which[right]])
            x, y = np.concatenate([(start + a)[left], (middle + c)[right]]), np.concatenate([(start + b)[left], (middle + d)[right]])
            start = np.concatenate([start[left], middle[right]])
            inside = (start < most[which]) & (start + half > least[which])
            which, x, y, start = which[inside], x[inside], y[inside], start[inside]
        return which, start


class Order:
    """The order of equally long rows of bytes, of which some are points: intervals of the points that share a row's first bytes."""

    def __init__(self, rows: np.ndarray, points: np.ndarray) -> None:
        n, size = rows.shape
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{size}").ravel(), kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        rows, self.before = rows[order], np.append(0, np.cumsum(points[order]))
        self.shared = np.full(n + 1, -1)  # first bytes that a row and the one before it have in common
        for start in range(1, n, 1 << 16):
            end = min(n, start + (1 << 16))
            differ = rows[start:end] != rows[start - 1 : end - 1]
            self.shared[start:end] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        self.longest = int(self.shared.max(initial=-1))
        #: Of each row, the number of points before it.
        self.rank = self.before[self.place]

    def intervals(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the points that share its first ``size`` bytes, as an interval of the points' order."""
        begins = np.flatnonzero(self.shared[:-1] < size)
        group = np.cumsum(self.shared[:-1] < size) - 1
        group = group[self.place]
        return self.before[begins][group], self.before[np.append(begins[1:], len(self.place))][group]


def matrix(words: list[bytes], size: int) -> np.ndarray:
    """The first ``size`` bytes of words that have as many."""
    return np.frombuffer(b"".join(w[:size] for w in words), np.uint8).reshape(len(words), size)


def near_pairs(words: list[bytes], points: np.ndarray, longer: list[bytes], back: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of places: of ``words``, of one length, each with the points one replacement away; of ``longer``, by one, with the points one deletion away.

    ``back`` tells in which half the edit is. The third is whether the first place is of
    ``longer``. A letter that repeats is deleted at its last place alone.
    """
    size, n = len((words or [w[:-1] for w in longer])[0]), len(words)
    if not points.any():
        return
    rows = np.concatenate([matrix(words, size), matrix(longer, size)])
    turned = np.concatenate([matrix(words, size)[:, ::-1], matrix([w[::-1] for w in longer], size)])
    whole = matrix(longer, size + 1)
    at = np.flatnonzero(points)
    points = np.append(points, np.zeros(len(longer), bool))
    front, rear = Order(rows, points), Order(turned, points)
    values, owner = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    values[front.rank[at]] = rear.rank[at]
    owner[rear.rank[at]] = at
    tree = WaveletTree(values)
    half = size // 2
    held: list[list[np.ndarray]] = []

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        if held:
            query, low, high, least, most = (np.concatenate(x) for x in zip(*held, strict=True))
            which, value = tree.report(low, high, least, most)
            own, other = query[which], owner[value]
            for deleted in (False, True):
                chosen = (own >= n) == deleted
                chosen &= own != other
                yield own[chosen] - n * deleted, other[chosen], deleted
            held.clear()

    # beyond the bytes that any two rows share there is nothing to find, however long the words
    for i in range(max(half if back else 0, size - 1 - rear.longest), min(size if back else half - 1, front.longest) + 1):
        low, high = front.intervals(i)
        for deleted in (False, True):
            after = size - i - (not deleted)
            if after < 0:
                continue
            least, most = rear.intervals(after)
            own = slice(n, None) if deleted else slice(0, n)
            least_size = 0 if deleted else 1  # a word that is a point is in its own rectangle
            keep = (high[own] - low[own] > least_size * points[own]) & (most[own] - least[own] > least_size * points[own])
            if deleted and i < size:
                keep &= whole[:, i] != whole[:, i + 1]
            query = np.flatnonzero(keep) + (n if deleted else 0)
            if len(query):
                held.append([query, low[query], high[query], least[query], most[query]])
        if sum(len(x[0]) for x in held) > RECTANGLES:
            yield from found()
    yield from found()


def summed(words: list[bytes], times: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of places in ``words``, which are in order: the first ones that there are, how many pairs each has, and the place of the most frequent second, the least of those."""
    own, other = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in range(2))
    order = np.lexsort([other, -times[other], own])
    own, other = own[order], other[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[first], np.diff(np.append(first, len(own))), other[first]


def shard_near(words: list[str], times: np.ndarray, back: np.ndarray, size: np.ndarray, point: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """What a shard's rows have near, in the shard: words, how many, the most frequent one's count, and that one."""
    own = [w.encode("latin-1") for w in words]
    order = sorted(set(own))
    number = {w: k for k, w in enumerate(order)}
    ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    counts = np.zeros(len(order), np.int64)
    counts[ids] = times
    lengths = np.array([len(w) for w in order], np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for side, length in sorted(set(zip(back.tolist(), size.tolist(), strict=True))):
        rows = (back == side) & (size == length)
        points = np.unique(ids[rows & point])
        chosen = np.unique(ids[rows])
        same, longer = chosen[lengths[chosen] == length], chosen[lengths[chosen] == length + 1]
        for a, b, deleted in near_pairs([order[k] for k in same.tolist()], np.isin(same, points), [order[k] for k in longer.tolist()], bool(side)):
            a, b = (longer if deleted else same)[a], same[b]
            pairs.append((a, b))
            if deleted:
                pairs.append((b, a))
    found, n, best = summed(order, counts, pairs)
    names = [w.decode("latin-1") for w in order]
    return [names[k] for k in found.tolist()], n, counts[best], [names[k] for k in best.tolist()]


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Words of at least LEAST_CHARS characters that occur LEAST_TIMES: ``word``, ``n``.

    Runs are lower-cased from A to Z alone; one in DAMAGED loses a character, by a hash of its
    document's id (null as the empty text) and itself. Null texts have none.
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"({RUN})"), 1)).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_CHARS)
    h = F.crc32(F.concat("id", "run").cast("binary"))
    gone = F.pmod(h, F.length("run").cast("long")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), gone), F.substring(F.col("run"), gone + 2, F.length("run")))
    words = runs.select(F.when(h % DAMAGED == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def dealt(words: DataFrame, shards: int) -> DataFrame:
    """``words`` as rows of shards: ``shard``, ``word``, ``n``, ``back`` (the half that an edit is in), ``size`` (of the points it looks for), ``point`` (whether it is one itself)."""
    length = F.length("word")

    def rows(size: Column, point: bool) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        kept = {1: F.substring(F.col("word"), F.lit(1), half), 0: F.substring(F.col("word"), length - (size - half) + 1, size - half)}
        return [F.struct(F.lit(bool(k)).alias("back"), size.alias("size"), part.alias("part"), F.lit(point).alias("own")) for k, part in kept.items()]

    each = words.select("word", "n", F.explode(F.array(*rows(length, True), *rows(length - 1, False))).alias("r")).select("word", "n", "r.*")
    each = each.where(F.col("own") | (F.col("size") >= LEAST_CHARS))
    most = max(1, SHARD_WORDS // 4)
    halves = each.where("own").groupBy("back", "size", "part").agg(F.count("*").alias("points")).where(F.col("points") > most)
    each = joined_evenly(each, halves, ["back", "size", "part"], F.col("points") * HOT > F.lit(words.count()), ["word"])
    ways = F.coalesce(F.ceil(F.col("points") / most).cast("int"), F.lit(1))
    each = each.withColumn("ways", ways).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("ways").cast("long")).cast("int"))
    each = each.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    shard = F.pmod(F.xxhash64("back", "size", "part", "way"), F.lit(shards)).cast("int")
    return each.select(shard.alias("shard"), "word", "n", "back", "size", (F.col("own") & (F.col("way") == F.col("mine"))).alias("point"))


def near_words(words: DataFrame) -> DataFrame:
    """Of ``words`` (``word``, ``n``; Latin-1, no word twice) those that others are one edit away from: ``word``, ``n_near``, ``best`` (the most frequent, the least of those) and ``best_n``."""
    shards = max(1, round(2 * words.count() / SHARD_WORDS))

    def run(table: pa.Table) -> pa.Table:
        flags = {k: table.column(k).to_numpy().astype(t) for k, t in (("n", np.int64), ("back", bool), ("size", np.int64), ("point", bool))}
        word, n, best_n, best = shard_near(table.column("word").to_pylist(), flags["n"], flags["back"], flags["size"], flags["point"])
        return pa.table({"word": pa.array(word, pa.string()), "n_near": pa.array(n, pa.int64()), "best_n": pa.array(best_n, pa.int64()), "best": pa.array(best, pa.string())})

    found = dealt(words, shards).repartition(shards, "shard").groupBy("shard").applyInArrow(run, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("least")).select("word", "n_near", F.col("least.best").alias("best"), (-F.col("least.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """Of ``links`` (``word``, ``form``) the last form that each word leads to: ``word``, ``root``. Each round doubles how far links reach; forms are more frequent, so they end."""
    links = cut(links.select("word", F.col("form").alias("root")))
    total = links.count()
    while total:
        sizes = links.groupBy("root").agg(F.count("*").alias("times"))
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next")).join(sizes, "root")
        links = cut(joined_evenly(links, on, ["root"], F.col("times") * HOT > total, ["word"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").count():
            break
        links = links.drop("moved")
    return links.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each word of the texts: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the most frequent of the words one inserted, deleted or replaced character
    away, the least in code-point order of those, if MORE times as frequent as the word; else
    null. ``root`` is the last of the forms from the word on, itself without any. Rows that
    repeat count each. No texts: no rows.
    """
    words = written(word_counts(docs, text, doc_id), "words")
    near = written(near_words(words), "near-words")
    each = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best_n") >= MORE * F.col("n"), F.struct(F.col("best").alias("form"), F.col("best_n").alias("form_n"))).alias("to")), "word-forms")
    last = roots(each.where("to is not null").select("word", "to.form"))
    return each.join(last, "word", "left").select("word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("to.form_n").alias("form_n"))
