"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words. A word's input is the sum of a vector of
its own (by hash) and the mean of its character trigrams' vectors (by hash). One gated
recurrent unit reads a window forwards and one backwards; attention pools their states
into the window's logit. A text's score is that of its most toxic window, in training too:
each step fits the window of every sampled text that scores highest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, steps, texts

#: Labelled texts of each class (0 and 1) that the network is fitted on at most, about, and the characters of the longest.
FIT_ROWS = (2400, 1200)
FIT_CHARS = 12_000
THRESHOLD = 0.7
WINDOW, STRIDE = 48, 40
UNITS, WIDTH, ATTENTION = 8, 16, 8
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 12
#: Words whose inputs a task keeps at most; it starts anew beyond.
CACHED_WORDS = 200_000
#: Sampled texts that a word must be in to have a vector of its own; rarer words have their characters only.
COMMON = 6
#: Steps that a fit takes at least.
LEAST_STEPS = 450
#: Windows that go through the network at once.
LANES = 512


@dataclass
class Network:
    """Parameters; both directions are stacked first. ``gates`` are update, reset, candidate."""

    word: np.ndarray
    gram: np.ndarray
    enter: np.ndarray  # WIDTH x (2 * 3 * UNITS)
    bias: np.ndarray  # 2 * 3 * UNITS
    recur: np.ndarray  # 2 x UNITS x (3 * UNITS)
    look: np.ndarray  # (2 * UNITS) x ATTENTION
    weigh: np.ndarray  # ATTENTION
    out: np.ndarray  # 2 * UNITS
    base: np.ndarray  # 1
    common: np.ndarray  # WORD_ROWS; which rows of ``word`` words that several texts share have; others have row 0

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.1, WORD_ROWS, WIDTH), draw(0.1, GRAM_ROWS, WIDTH), draw(0.3, WIDTH, 6 * UNITS), np.zeros(6 * UNITS, np.float32), draw(0.3, 2, UNITS, 3 * UNITS), draw(0.3, 2 * UNITS, ATTENTION), draw(0.3, ATTENTION), draw(0.3, 2 * UNITS), np.zeros(1, np.float32), np.ones(WORD_ROWS, bool))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, rows of all words' trigrams (bounded by ``^`` and ``$``), and where each word's begin."""
    own = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % WORD_ROWS
    framed = [b"^" + w + b"$" for w in words]
    flat = np.frombuffer(b"".join(framed), np.uint8).astype(np.int64)
    sizes = np.array([len(w) for w in framed])
    grams = ((flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) * 2654435761 >> 8) % GRAM_ROWS
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), bool)  # a trigram over two words is left out
    inside[ends - 1] = inside[ends - 2] = False
    starts = np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])
    return own, grams[inside[: len(grams)]], starts


def inputs(net: Network, words: list[bytes]) -> np.ndarray:
    own, grams, starts = word_hashes(words)
    sizes = np.diff(np.append(starts, len(grams)))
    return net.word[np.where(net.common[own], own, 0)] + np.add.reduceat(net.gram[grams], starts, axis=0) / sizes[:, None]


def cut_windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words; one empty window for none."""
    starts = range(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return [(s, min(n, s + WINDOW)) for s in starts if s == 0 or s < n - (WINDOW - STRIDE)]


def forward(net: Network, table: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows. table: gate inputs of words (6 UNITS); at, mask: lanes x WINDOW, places in the table and whether they hold a word."""
    lanes, length = mask.shape
    x = np.stack([table[at.T, : 3 * UNITS], table[at.T[::-1], 3 * UNITS :]], axis=1)  # length x 2 x lanes x 3 UNITS
    m = np.stack([mask.T, mask.T[::-1]], axis=1).astype(table.dtype)[..., None]
    full = mask.all(axis=0)
    full &= full[::-1]
    states = np.zeros((length + 1, 2, lanes, UNITS), table.dtype)
    kept: dict = {"g": [], "n": [], "q": []}
    for t in range(length):
        u = states[t] @ net.recur
        g = u[..., : 2 * UNITS] + x[t, ..., : 2 * UNITS]
        g *= 0.5
        np.tanh(g, g)
        g *= 0.5
        g += 0.5
        n = u[..., 2 * UNITS :] * g[..., UNITS:]
        n += x[t, ..., 2 * UNITS :]
        np.tanh(n, n)
        if keep:
            kept["g"].append(g)
            kept["n"].append(n)
            kept["q"].append(u[..., 2 * UNITS :])
        d = n - states[t]
        d *= 1 - g[..., :UNITS]
        if not full[t]:
            d *= m[t]
        np.add(states[t], d, out=states[t + 1])
    both = np.concatenate([states[1:, 0], states[:0:-1, 1]], axis=-1)  # length x lanes x 2 UNITS
    eyes = np.tanh(both @ net.look)
    e = np.where(mask.T, eyes @ net.weigh, table.dtype.type(-1e9))
    e = np.exp(e - e.max(axis=0))
    e /= e.sum(axis=0)
    pooled = np.einsum("tl,tlh->lh", e, both)
    return pooled @ net.out + net.base, kept | {"m": m, "h": states, "both": both, "eyes": eyes, "e": e, "pooled": pooled}


def backward(net: Network, kept: dict, dlogit: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Gradients of the gate inputs (lanes x WINDOW x 6 UNITS) and of the parameters after them."""
    both, eyes, e = kept["both"], kept["eyes"], kept["e"]
    grads = {"out": kept["pooled"].T @ dlogit, "base": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * net.out
    dboth = e[..., None] * dpooled
    de = (both * dpooled).sum(-1)
    de = e * (de - (e * de).sum(axis=0))
    grads["weigh"] = np.einsum("tl,tla->a", de, eyes)
    deyes = de[..., None] * net.weigh * (1 - eyes**2)
    grads["look"] = np.einsum("tlh,tla->ha", both, deyes)
    dboth = dboth + deyes @ net.look.T
    length, lanes = e.shape
    dstates = np.stack([dboth[..., :UNITS], dboth[::-1, :, UNITS:]], axis=1)
    dx = np.zeros((2, lanes, length, 3 * UNITS), both.dtype)
    grads["recur"] = np.zeros_like(net.recur)
    dh = np.zeros((2, lanes, UNITS), both.dtype)
    for t in range(length - 1, -1, -1):
        n, h, q = (kept[k][t] for k in "nhq")
        z, r = kept["g"][t][..., :UNITS], kept["g"][t][..., UNITS:]
        dh = dh + dstates[t]
        g = kept["m"][t] * dh
        dn = g * (1 - z) * (1 - n**2)
        dz = -g * (n - h) * z * (1 - z)
        dr = dn * q * r * (1 - r)
        dx[:, :, t] = np.concatenate([dz, dr, dn], axis=-1)
        du = np.concatenate([dz, dr, dn * r], axis=-1)
        grads["recur"] += h.transpose(0, 2, 1) @ du
        dh = dh - g * (1 - z) + du @ net.recur.transpose(0, 2, 1)
    return np.concatenate([dx[0], dx[1][:, ::-1]], axis=-1), grads


class Scorer:
    """Scores texts; keeps the gate inputs of words for the next texts."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * UNITS), np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table of gate inputs, which gets those of new words."""
        out = np.fromiter((self.rows.get(w, -1) for w in words), np.int32, len(words))
        unknown = np.flatnonzero(out < 0).tolist()
        if unknown:
            new = list({words[i] for i in unknown})
            if len(self.rows) + len(new) > CACHED_WORDS and self.rows:
                self.forget()
                return self.ids(words)
            rows = self.rows
            while len(self.table) < len(rows) + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for start in range(0, len(new), 20_000):
                part = new[start : start + 20_000]
                self.table[len(rows) : len(rows) + len(part)] = inputs(self.net, part) @ self.net.enter + self.net.bias
                rows.update(zip(part, range(len(rows), len(rows) + len(part)), strict=True))
            out[unknown] = [rows[words[i]] for i in unknown]
        return out

    def scores(self, documents: list[str]) -> list[float]:
        words = [split(t) for t in documents]
        ends = np.cumsum([len(own) for own in words])
        flat = self.ids([w for own in words for w in own])
        doc, begins, stops = windows_of(ends)
        out = np.zeros(len(documents))
        np.maximum.at(out, doc, sigmoid(logits_of(self.net, self.table, flat, begins, stops).astype(np.float64)))
        return out.tolist()


def windows_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts whose words follow each other and end at ``ends``: their text, and where they begin and end."""
    spans = [(d, start + a, start + b) for d, (start, end) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)) for a, b in cut_windows(end - start)]
    return tuple(np.array(spans, np.int64).reshape(-1, 3).T)  # type: ignore[return-value]


def packed(flat: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of windows, lanes x WINDOW, and which places hold one."""
    mask = np.arange(WINDOW) < (stops - begins)[:, None]
    at = np.zeros(mask.shape, np.int64)
    at[mask] = flat[(begins[:, None] + np.arange(WINDOW))[mask]]
    return at, mask


def logits_of(net: Network, table: np.ndarray, flat: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    parts = [forward(net, table, *packed(flat, begins[s : s + LANES], stops[s : s + LANES]))[0] for s in range(0, len(begins), LANES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


class Vocabulary:
    """Rows of words and of their trigrams: what a fit moves."""

    def __init__(self, words: list[bytes]) -> None:
        self.own, self.grams, self.starts = word_hashes(words)
        self.sizes = np.diff(np.append(self.starts, len(self.grams)))

    def trigrams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of some words' trigrams, word after word, and where each word's begin."""
        sizes = self.sizes[some]
        heads = np.cumsum(sizes) - sizes
        return self.grams[np.arange(sizes.sum()) + np.repeat(self.starts[some] - heads, sizes)], heads

    def vectors(self, net: Network, some: np.ndarray) -> np.ndarray:
        grams, heads = self.trigrams(some)
        return net.word[self.own[some]] + np.add.reduceat(net.gram[grams], heads, axis=0) / self.sizes[some, None]

    def table(self, net: Network) -> np.ndarray:
        """Gate inputs of all words."""
        out = np.zeros((len(self.own), 6 * UNITS), np.float32)
        for start in range(0, len(out), 20_000):
            some = np.arange(start, min(len(out), start + 20_000))
            out[some] = self.vectors(net, some) @ net.enter + net.bias
        return out


def gradients(net: Network, words: Vocabulary, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all parameters for the mean log loss of windows, whose words are ``at`` and labels ``y``."""
    used, back = np.unique(at, return_inverse=True)
    back = back.reshape(at.shape)
    x = words.vectors(net, used)
    logits, kept = forward(net, (x @ net.enter + net.bias).astype(net.out.dtype), back, mask, keep=True)
    dentered, grads = backward(net, kept, ((sigmoid(logits) - y) / len(y)).astype(net.out.dtype))
    dentered *= mask[..., None]
    dtable = np.zeros((len(used), 6 * UNITS), net.out.dtype)
    np.add.at(dtable, back.ravel(), dentered.reshape(-1, 6 * UNITS))
    grads |= {"enter": x.T @ dtable, "bias": dtable.sum(axis=0), "word": np.zeros_like(net.word), "gram": np.zeros_like(net.gram)}
    dx = dtable @ net.enter.T
    np.add.at(grads["word"], words.own[used], dx)
    sizes = words.sizes[used]
    np.add.at(grads["gram"], words.trigrams(used)[0], np.repeat(dx / sizes[:, None], sizes, axis=0))
    return grads


def fit(documents: Iterable[str | pa.StringScalar], toxic: Iterable[int], rounds: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Network | None:
    """A network fitted on labelled texts, or None if either class or any word is missing.

    Texts are taken one by one; what is held of them is a number for each word, in one array.
    """
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, rng = Network.new(seed), np.random.default_rng(seed)
    numbers: dict[bytes, int] = {}
    parts: list[np.ndarray] = []
    for t in documents:
        own = split(t.as_py() if isinstance(t, pa.Scalar) else t)
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int32, len(own)))
    if not numbers:
        return None
    words = Vocabulary(list(numbers))
    del numbers
    flat, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    common = np.bincount(np.concatenate([np.unique(p) for p in parts]), minlength=len(words.own)) >= COMMON  # in so many texts
    del parts
    net.common[:] = False
    net.common[words.own[common]] = True
    words.own = np.where(net.common[words.own], words.own, 0)
    doc, begins, stops = windows_of(ends)
    first = np.searchsorted(doc, np.arange(len(ends)))
    many = np.diff(np.append(first, len(doc)))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in vars(net).items() if v.dtype == np.float32}
    step = 0
    for turn in range(max(rounds, LEAST_STEPS * batch // len(ends))):  # small samples go round more often
        if turn:  # the window that scores highest now; at first a random one
            logits = logits_of(net, words.table(net), flat, begins, stops)
            worst = np.array([f + int(logits[f : f + n].argmax()) for f, n in zip(first.tolist(), many.tolist(), strict=True)])
        else:
            worst = first + np.array([rng.integers(n) for n in many.tolist()])
        for chosen in np.array_split(rng.permutation(len(ends)), max(1, len(ends) // batch)):
            step += 1
            own = worst[chosen]
            for k, g in gradients(net, words, *packed(flat, begins[own], stops[own]), y[chosen]).items():  # Adam
                mean, square = moments[k]
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                getattr(net, k)[...] -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return net


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", most: tuple[int, int] = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[pa.ChunkedArray, list[int]]:
    """A bounded sample of labelled texts for :func:`fit`, about ``most[y]`` of class y, chosen by the id's hash.

    Only texts of at most ``chars`` characters are used, so the driver gets no more than
    both bounds' product. An id that the labels repeat takes its largest label.
    """
    own = labels.select(F.col(doc_id).alias("i"), F.col(toxic).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    counts = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, most[y] / n))).otherwise(share)
    own = own.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= chars)).join(F.broadcast(own), "i").select("i", "t", "y").toArrow()
    rows = rows.take(pc.sort_indices(rows, [("i", "ascending"), ("t", "ascending")]))
    return rows["t"], rows["y"].to_pylist()


def score(docs: DataFrame, net: Network | None, text: str = "text", keep: dict[str, Column] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted``, a row for each row of ``docs``.

    Every window of every whole text is scored. Null texts are scored as empty ones. Without
    a network (no labels of either class) all scores are 0.
    """
    rows = docs.select(*[c.alias(k) for k, c in (keep or {"doc_id": F.col("doc_id")}).items()], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(net) if net else None
        for b in steps(batches, "__text", 1 << 20):
            scores = own.scores(texts(b, "__text")) if own else [0.0] * b.num_rows
            yield added(b, "__text", score=pa.array(scores, pa.float64()), predicted=pa.array([int(s >= threshold) for s in scores], pa.int32()))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("__text").dtypes)
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")


def without_toxic(docs: DataFrame, net: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores under the threshold, with all their columns."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(net) if net else None
        for b in steps(batches, text, 1 << 20):
            scores = own.scores(texts(b, text)) if own else [0.0] * b.num_rows
            yield b.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, schema)
