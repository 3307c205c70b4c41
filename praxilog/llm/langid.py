"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter gram is bound as the product
of its letters' vectors, permuted (rolled) by their places; a text bundles, that is adds,
its grams' vectors. A language's prototype is the bundle of its texts' unit vectors, and a
text has the language of the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, steps, texts

DIMENSIONS = 1024
SEED = 17
#: Rows of each language that the prototypes are fitted on at most, about (a bounded, deterministic sample).
FIT_ROWS_PER_LANGUAGE = 2000
#: Gram vectors that a task keeps at most; it starts anew beyond.
CACHED_GRAMS = 20_000
UNKNOWN = "und"


class GramBundler:
    """Turns texts into bundles; keeps letters' and grams' vectors for the next texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.kind = np.zeros(0x110000, np.int8)  # 1: letter, 2: other
        self.letters: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.int64)  # grams, sorted, and where their vectors are
        self.at = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        """The letter's vector rolled by 0, 1 and 2; the gap between words (code 0) has one too."""
        if code not in self.letters:
            if len(self.letters) > 50_000:
                self.letters.clear()
            v = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            self.letters[code] = np.stack([np.roll(v, k) for k in range(3)]).astype(np.int8)
        return self.letters[code]

    def learn(self, grams: np.ndarray) -> None:
        new = np.setdiff1d(grams, self.known, assume_unique=True)
        if not len(new):
            return
        if len(self.known) + len(new) > CACHED_GRAMS:
            self.forget()
            new = grams
        codes = np.stack([new >> 42, (new >> 21) & 0x1FFFFF, new & 0x1FFFFF])
        some, at = np.unique(codes, return_inverse=True)
        table = np.stack([self.letter(int(c)) for c in some])
        a, b, c = at.reshape(codes.shape)
        self.vectors = np.concatenate([self.vectors, table[a, 2] * table[b, 1] * table[c, 0]])
        known = np.concatenate([self.known, new])
        at = np.concatenate([self.at, np.arange(len(self.at), len(self.at) + len(new))])
        order = np.argsort(known, kind="stable")
        self.known, self.at = known[order], at[order]

    def grams(self, text: str) -> np.ndarray:
        """The three-letter grams of a text's words, gaps included; none if it has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.kind[codes]
        if (new := kinds == 0).any():
            for c in np.unique(codes[new]):
                self.kind[c] = 1 if chr(c).isalpha() else 2
            kinds = self.kind[codes]
        letter = kinds == 1
        if not letter.any():
            return np.zeros(0, np.int64)
        symbols = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.int64)
        symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
        return (symbols[:-2] << 42) | (symbols[1:-1] << 21) | symbols[2:]

    def bundle(self, text: str) -> np.ndarray | None:
        """The sum of the grams' vectors, or None for a text without letters."""
        grams, counts = np.unique(self.grams(text), return_counts=True)
        if not len(grams):
            return None
        out = np.zeros(self.dimensions, np.float32)
        for start in range(0, len(grams), CACHED_GRAMS // 2):
            part = grams[start : start + CACHED_GRAMS // 2]
            self.learn(part)
            at = self.at[np.searchsorted(self.known, part)]
            out += counts[start : start + CACHED_GRAMS // 2].astype(np.float32) @ self.vectors[at].astype(np.float32)  # bytes take less of the cache
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-12)


def fit_prototypes(rows: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = FIT_ROWS_PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes as unit rows.

    ``rows`` are what may be learned from; those with null text or language are left out.
    Of each language about ``rows_per_language`` rows are used, chosen by the text's hash.
    What comes to the driver is one vector for each language.
    """
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, dimensions))
    part = F.lit(None).cast("double")
    for name, n in counts.items():
        part = F.when(F.col("lang") == name, F.lit(min(1.0, rows_per_language / n))).otherwise(part)
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < part * F.lit(float(1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = GramBundler(dimensions, seed), {}
        for b in steps(batches, "text"):
            for t, name in zip(texts(b, "text"), b.column("lang").to_pylist(), strict=True):
                if (v := own.bundle(t)) is not None:
                    sums[name] = sums.get(name, 0) + _unit(v).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "v"])

    sums = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for name, k, x in sums.collect():
        found.setdefault(name, np.zeros(dimensions))[k] = x
    names = sorted(found)
    return names, np.array([_unit(found[n]) for n in names]).reshape(len(names), dimensions)


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text: str = "text", keep: dict[str, Column] | None = None, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` (the largest cosine, 0 if negative), a row for each row of ``docs``.

    Null texts, texts without letters, and all texts if there are no prototypes, get ``und``
    and 0. Ties take the first language in alphabetical order.
    """
    table = np.asarray(prototypes, np.float32)
    rows = docs.select(*[c.alias(k) for k, c in (keep or {"doc_id": F.col("doc_id")}).items()], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = GramBundler(dimensions, seed)
        for b in steps(batches, "__text"):
            names, scores = [], []
            for t in texts(b, "__text"):
                v = own.bundle(t) if languages else None
                if v is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cosines = table @ _unit(v)
                    names.append(languages[best := int(cosines.argmax())])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield added(b, "__text", lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("__text").dtypes)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
