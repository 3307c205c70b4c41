"""URL filters: rules by host and path, and the ratio of two character language models.

The models are variable-order Markov models of accepted and of rejected URLs: Witten-Bell
smoothing blends each context of up to three characters with its shorter ones. A URL's
score is the mean over its characters of the log-likelihoods' difference; the threshold is
calibrated on a fold that the models of that comparison haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, texts

#: Characters of their own, besides: 0 the start, 1 any other character; digits are one class.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0:/.-_?=&#%+~@"
SIZE = len(SYMBOLS) + 2
DEPTH = 3
FOLDS = 5
#: Scores are calibrated in bins of this width, from -LIMIT to LIMIT.
BIN, LIMIT = 0.005, 10.0
#: Counts that a task holds apart before it merges them.
MERGE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, if the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls; of equally long ones the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(sorted(rules, key=lambda r: r.name, reverse=True), key=lambda r: len(r.name)):  # a later one overrides
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit("allow" if r.allow else "block")).otherwise(verdict)
    return name, verdict


def _table() -> np.ndarray:
    out = np.ones(0x110000, np.uint8)
    for i, c in enumerate(SYMBOLS):
        out[[ord(c), ord(c.upper())]] = i + 2
    out[[ord(c) for c in "0123456789"]] = SYMBOLS.index("0") + 2
    return out


def grams(urls: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code of each character of the URLs with the DEPTH before it, and the URLs' lengths."""
    lengths = np.array([len(u) for u in urls], np.int64)
    start = "\0" * DEPTH
    codes = np.frombuffer("".join(start + u for u in urls).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = table[codes].astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(lengths + DEPTH)[:-1]]) if len(urls) else np.zeros(0, np.int64)
    for k in range(DEPTH):
        symbols[heads + k] = 0
    whole = symbols[: len(symbols) - DEPTH] if len(symbols) else symbols
    for k in range(1, DEPTH + 1):
        whole = whole * SIZE + symbols[k : len(symbols) - DEPTH + k]
    real = np.ones(len(symbols), bool)
    for k in range(DEPTH):
        real[heads + k] = False
    return whole[real[DEPTH:]], lengths


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of keys from parts that may share keys."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return keys, n


def count_grams(rows: DataFrame, url: str, label: str, fold: str) -> np.ndarray:
    """Counts over all rows: folds (calibration or not) x labels x grams. There are SIZE**4 grams at most, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _table(), SIZE ** (DEPTH + 1)
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for b in steps(batches, "url"):
            kinds = b.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
            codes, lengths = grams(texts(b, "url"), table)
            held.append(np.unique(codes + total * np.repeat(kinds, lengths), return_counts=True))
            if sum(len(k) for k, _ in held[1:]) > MERGE:
                held = [_merged(held)]
        keys, n = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys // total, pa.int32()), pa.array(keys % total, pa.int32()), pa.array(n, pa.int64())], names=["kind", "gram", "n"])

    kind = (F.col(fold).cast("int") * 2 + (F.col(label) == "allow").cast("int")).alias("kind")
    sums = rows.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("url"), kind).mapInArrow(run, "kind int, gram int, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((4, SIZE ** (DEPTH + 1)))
    out[sums["kind"].to_numpy(), sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(2, 2, -1)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the smoothed probabilities of each gram's last character after the others."""
    p = np.full(SIZE, 1.0 / SIZE)
    for depth in range(DEPTH + 1):
        c = counts.reshape(-1, *[SIZE] * (depth + 1)).sum(axis=0).reshape(-1, SIZE)
        kinds = (c > 0).sum(axis=1, keepdims=True)
        total = c.sum(axis=1, keepdims=True)
        shorter = np.broadcast_to(p.reshape(-1, SIZE) if depth else p, (SIZE, max(1, SIZE ** (depth - 1)), SIZE)).reshape(-1, SIZE) if depth else p
        seen = total > 0
        p = np.where(seen, (c + kinds * shorter) / np.where(seen, total + kinds, 1), shorter)
    return np.log(p).astype(np.float32).reshape(-1)


def scored(rows: DataFrame, url: str, ratios: np.ndarray | None) -> DataFrame:
    """``rows`` with ``score``; null and empty URLs, and all without models, have 0."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(ratios) if ratios is not None else None
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for b in steps(batches, url):
            out = np.zeros(b.num_rows)
            if sent is not None and b.num_rows:
                codes, lengths = grams(texts(b, url), table)
                sums = np.concatenate([[0.0], np.cumsum(sent.value[codes], dtype=np.float64)])
                ends = np.cumsum(lengths)
                out = (sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(out, 9))], names=[*b.schema.names, "score"])

    return rows.mapInArrow(run, f"{schema}, score double")


def calibrated(rows: DataFrame, label: str) -> float:
    """The score from which on URLs are allowed: the least sum of both classes' error rates, the middle of ties.

    What comes to the driver is the classes' histograms.
    """
    at = F.floor((F.least(F.greatest("score", F.lit(-LIMIT)), F.lit(LIMIT)) + LIMIT) / BIN).cast("int")
    bins = np.zeros((2, int(2 * LIMIT / BIN) + 1))
    for allow, k, n in rows.groupBy((F.col(label) == "allow").alias("allow"), at.alias("bin")).count().collect():
        bins[int(allow), k] = n
    if not bins.sum(axis=1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(bins, axis=1)], axis=1) / bins.sum(axis=1, keepdims=True)
    errors = below[1] + 1 - below[0]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(best[len(best) // 2] * BIN - LIMIT)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` with ``host``, ``path``, ``rule``, ``verdict``, ``score``, a row for each row of ``pages``.

    URLs that a rule fits have its verdict and are what the models learn from, all of them;
    the others are allowed if their score is at or above the calibrated threshold. If rules
    accept or reject no URL there are no models, and URLs without a rule are allowed.
    """
    host, path = parts(F.col(url))
    rows = pages.select(*[c.alias(k) for k, c in (keep or {"page_id": F.col("page_id")}).items()], F.col(url).alias("__url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("__verdict"))
    own = (F.crc32(F.col("__url").cast("binary")) % FOLDS == 0).alias("__fold")
    labelled = rows.where("__verdict is not null").select("__url", "__verdict", own)
    counts = count_grams(labelled, "__url", "__verdict", "__fold")
    ratios, threshold = None, 0.0
    if counts.sum(axis=(0, 2)).all():
        ratio = lambda c: log_model(c[1]) - log_model(c[0])
        if counts.sum(axis=2).all():
            threshold = calibrated(scored(labelled.where("__fold").select("__url", "__verdict"), "__url", ratio(counts[0])), "__verdict")
        ratios = ratio(counts.sum(axis=0))
    decided = F.coalesce("__verdict", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return scored(rows, "__url", ratios).withColumn("verdict", decided).drop("__url", "__verdict")
