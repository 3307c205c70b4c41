"""SentencePiece encoding with merge-dropout, and decoding.

Pieces are built by merges of the best score first, from the agenda of all neighbouring
pairs. Each candidate that the agenda offers is skipped with a given probability, by a
keyed hash, so that the same seed gives the same pieces anywhere and other seeds give other
ones. Merges cannot cross word starts, so texts are encoded word by word: each occurrence of
a word has a key of its own, by the seed, its text and its place. Tasks keep words' plain
merges; an occurrence whose key skips none of them has the plain pieces, any other is encoded
by its key.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, steps, texts

MARK = "▁"
DROPOUT = 0.1
SEED = 7
#: Words of which a task keeps the plain merges; beyond, it starts anew.
CACHED_WORDS = 120_000
#: Bytes of text that a task encodes at a time.
STEP_BYTES = 1 << 20
#: Symbols from which on a word has a heap of its own as its agenda; shorter ones are merged together.
LONG = 24
NEVER = 1 << 60
#: Stands, among words, for a mark in a text itself; half a surrogate pair, which no text of a table has.
LITERAL = "\udfff"
_MASK = (1 << 64) - 1


def skips(key: int, place: int, rank: int) -> int:
    """32 bits that the key, a candidate's place and its rank decide; a candidate is skipped if they are few."""
    x = ((key ^ place * 0x9E3779B97F4A7C15 ^ rank * 0xC2B2AE3D27D4EB4F) & _MASK) * 0xBF58476D1CE4E5B9 & _MASK
    return (x ^ x >> 29) * 0x94D049BB133111EB >> 32 & 0xFFFFFFFF


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each start on, as many as the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class PieceCodec:
    """Encodes and decodes by a merge-type (BPE) SentencePiece model with byte fallback."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = own.vocab_size()
        self.dropped, self.seed = int(dropout * (1 << 32)), seed
        kinds = [own.is_byte(i) or own.is_control(i) or own.is_unknown(i) for i in range(n)]
        self.ids = {own.id_to_piece(i): i for i in range(n) if not kinds[i]}
        self.bytes_ = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        by_score = sorted(self.ids, key=lambda p: (-own.get_score(self.ids[p]), self.ids[p]))
        self.rank, last = {}, None
        for p in by_score:  # equal scores have equal ranks: the leftmost goes first
            score = own.get_score(self.ids[p])
            self.rank[p] = len(self.rank) if last is None or score != last else self.rank[before]
            last, before = score, p
        plain = [own.id_to_piece(i).replace(MARK, " ").encode() if not kinds[i] else b"" for i in range(n)]
        for b, i in enumerate(self.bytes_):
            plain[i] = bytes([b])
        self.plain, self.plain_sizes = np.frombuffer(b"".join(plain), np.uint8), np.array([len(x) for x in plain])
        self.plain_starts = np.cumsum(self.plain_sizes) - self.plain_sizes
        self.simple = re.compile("[" + "".join(map(re.escape, (p for p in self.ids if len(p) == 1))) + "]+").fullmatch
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        newline = any("\n" in p for p in self.ids)
        self.split = re.compile(r".+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+" if newline else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", re.S).findall
        self.by_id = np.full(n, NEVER, np.int64)
        self.by_id[[self.ids[p] for p in self.rank]] = list(self.rank.values())
        pairs = sorted((self.ids[p[:k]] * n + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.n, self.pairs, self.wholes = n, np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.forget()

    def forget(self) -> None:
        """Drops what is kept of words.

        That is, one word after the other: the numbers of their plain pieces; the place and
        rank of each plain merge; and of easy ones, whose characters are all pieces, their
        symbols with each symbol's rank and whole with the next.
        """
        self.known: dict[str, int] = {}
        self.kept = {k: np.zeros(0, np.int64) for k in ("numbers", "places", "ranks", "symbols", "pairs", "wholes")}
        self.sizes = {k: np.zeros(0, np.int64) for k in ("numbers", "places", "symbols")}
        self.starts = dict(self.sizes)

    def merged(self, word: str, key: int, trace: list[tuple[int, int]] | None = None) -> list[str]:
        """Pieces of a word; symbols that no piece has stay as they are. With a ``trace``, none is skipped and it gets each merge's place and rank."""
        if word == LITERAL:
            return [word]
        if len(word) >= LONG:
            return self.merged_long(word, key, trace)
        rank, dropped = self.rank.get, self.dropped
        parts, places = list(word), list(range(len(word)))
        agenda = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            if trace is not None:
                trace.append((places[i], best))
            elif dropped and skips(key, places[i], best) < dropped:
                agenda[i] = NEVER
                continue
            whole = parts[i] = parts[i] + parts.pop(i + 1)
            del places[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(whole + parts[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(parts[i - 1] + whole, NEVER)
        return parts

    def merged_long(self, word: str, key: int, trace: list[tuple[int, int]] | None = None) -> list[str]:
        """The same by a heap."""
        rank, dropped = self.rank.get, self.dropped
        n = len(word)
        parts: list[str] = list(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i, size = heapq.heappop(agenda)
            j = right[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size or rank(parts[i] + parts[j]) != r:
                continue
            if trace is not None:
                trace.append((i, r))
            elif dropped and skips(key, i, r) < dropped:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := rank(parts[i] + parts[right[i]])) is not None:
                    heapq.heappush(agenda, (r, i, len(parts[i]) + len(parts[right[i]])))
            if (k := left[i]) >= 0 and (r := rank(parts[k] + parts[i])) is not None:
                heapq.heappush(agenda, (r, k, len(parts[k]) + len(parts[i])))
        return [p for p in parts if p]

    def numbers(self, pieces: list[str]) -> bytes:
        if pieces == [LITERAL]:
            return array("i", [self.bytes_[b] for b in MARK.encode()]).tobytes()
        out = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.bytes_[b] for b in p.encode("utf-8", "surrogatepass")]
        return array("i", out).tobytes()

    def candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and wholes of pairs of symbols; NEVER where they don't merge."""
        pair = left * self.n + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        whole = self.wholes[at]
        return np.where(self.pairs[at] == pair, self.by_id[whole], NEVER), whole

    def symbols_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of words, their symbols, and the rank and whole of each symbol with the next; their characters must all be pieces."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")].astype(np.int64)
        ranks, wholes = self.candidates(symbols, np.append(symbols[1:], 0))
        ranks[np.cumsum(sizes) - 1] = NEVER
        return sizes, symbols, ranks, wholes

    def merged_together(self, words: list[str], keys: list[int] | np.ndarray) -> list[bytes]:
        """Numbers of many words at once; see :meth:`in_step`."""
        numbers, counts = self.in_step(*self.symbols_of(words), np.array(keys, np.uint64))
        return [x.astype("<i4").tobytes() for x in np.split(numbers, np.cumsum(counts)[:-1])]

    def in_step(self, sizes: np.ndarray, symbols: np.ndarray, pairs: np.ndarray, wholes_: np.ndarray, key: np.ndarray, trace: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of many words, and how many each has: each step takes every word's best candidate from its agenda.

        Words of like length should come together. With a ``trace``, none is skipped and it
        gets each merge's word, place and rank.
        """
        width, rows = int(sizes.max()), np.arange(len(sizes))
        alive = (np.arange(width) < sizes[:, None]).ravel()
        flat, ranks, wholes = np.zeros(len(alive), np.int64), np.full(len(alive), NEVER), np.zeros(len(alive), np.int64)
        flat[alive], ranks[alive], wholes[alive] = symbols, pairs, wholes_
        place = np.arange(len(alive))
        after = np.where(alive & np.append(alive[1:], False) & ((place + 1) % width != 0), place + 1, -1)
        before = np.where(alive & (place % width != 0), place - 1, -1)

        def offer(at: np.ndarray) -> None:
            """Puts the candidates that begin at these symbols on the agenda."""
            at = at[at >= 0]
            ranks[at] = NEVER
            at = at[after[at] >= 0]
            ranks[at], wholes[at] = self.candidates(flat[at], flat[after[at]])

        table = ranks.reshape(len(sizes), width)
        while len(rows):
            at = rows * width + table[rows].argmin(axis=1)
            going = ranks[at] < NEVER
            rows, at = rows[going], at[going]
            if not len(rows):
                break
            if trace is not None:
                trace.append((rows, at % width, ranks[at]))
            elif self.dropped:
                drop = self.dropping(key[rows], at % width, ranks[at])
                ranks[at[drop]] = NEVER
                at = at[~drop]
            gone = after[at]
            flat[at] = wholes[at]
            alive[gone], ranks[gone] = False, NEVER
            after[at] = after[gone]
            right = after[at] >= 0
            before[after[at][right]] = at[right]
            offer(at)
            offer(before[at])
        return flat[alive], alive.reshape(len(sizes), width).sum(axis=1)

    def dropping(self, keys: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Which candidates are skipped; see :func:`skips`."""
        x = keys ^ places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ ranks.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)) < self.dropped

    def learn(self, new: list[str]) -> None:
        """Keeps what words are made of."""
        new.sort(key=len)
        kept = {k: [v] for k, v in self.kept.items()}
        sizes = {k: [v] for k, v in self.sizes.items()}
        easy = [len(w) < LONG and self.simple(w) is not None for w in new]
        chosen = [w for w, e in zip(new, easy, strict=True) if e]
        for start in range(0, len(chosen), 20_000):
            own = self.symbols_of(chosen[start : start + 20_000])
            trace: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            numbers, counts = self.in_step(*own, np.zeros(len(own[0]), np.uint64), trace)
            row, place, rank = (np.concatenate([t[k] for t in trace] or [np.zeros(0, np.int64)]) for k in range(3))
            order = np.argsort(row, kind="stable")
            for k, v in {"numbers": numbers, "places": place[order], "ranks": rank[order], "symbols": own[1], "pairs": own[2], "wholes": own[3]}.items():
                kept[k].append(v)
            for k, v in {"numbers": counts, "places": np.bincount(row, minlength=len(counts)), "symbols": own[0]}.items():
                sizes[k].append(v)
        odd = [w for w, e in zip(new, easy, strict=True) if not e]
        for word in odd:
            steps_: list[tuple[int, int]] = []
            numbers = np.frombuffer(self.numbers(self.merged(word, 0, steps_)), "<i4").astype(np.int64)
            merges = np.array(steps_, np.int64).reshape(-1, 2)
            for k, v in {"numbers": numbers, "places": merges[:, 0], "ranks": merges[:, 1]}.items():
                kept[k].append(v)
            for k, v in {"numbers": len(numbers), "places": len(merges), "symbols": 0}.items():
                sizes[k].append(np.array([v]))
        self.known.update(zip(chosen + odd, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.kept = {k: np.concatenate(v) for k, v in kept.items()}
        self.sizes = {k: np.concatenate(v) for k, v in sizes.items()}
        self.starts = {k: np.cumsum(v) - v for k, v in self.sizes.items()}

    def places_of(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Where what is kept of words lies, word by word."""
        return runs(self.starts[kind][ids], self.sizes[kind][ids])

    def skipping(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which occurrences of words skip one of their plain merges or more; the others' pieces are the plain ones."""
        owner = np.repeat(np.arange(len(ids)), self.sizes["places"][ids])
        at = self.places_of("places", ids)
        drop = self.dropping(keys[owner], self.kept["places"][at], self.kept["ranks"][at])
        return np.flatnonzero(np.bincount(owner[drop], minlength=len(ids)))

    def encode_all(self, texts_: list[str]) -> list[np.ndarray]:
        """Piece numbers of texts; a mark in a text itself becomes its bytes, so that decoding gives it back."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        words: list[str] = []
        ends, keys = [], [np.zeros(0, np.uint64)]
        for text in texts_:
            first = len(words)
            for k, part in enumerate(text.split(MARK) if text else ()):
                if k:
                    words.append(LITERAL)
                words += self.split((MARK if not k else "") + part.replace(" ", MARK))
            ends.append(len(words))
            if self.dropped:
                keys.append(self.keys(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed), len(words) - first))
        ids = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(ids < 0)):
            self.learn(list(dict.fromkeys(words[i] for i in missing.tolist())))
            ids[missing] = [self.known[words[i]] for i in missing.tolist()]
        starts, counts, pool = self.starts["numbers"][ids], self.sizes["numbers"][ids], [self.kept["numbers"]]
        if self.dropped and words:
            key, size = np.concatenate(keys), len(pool[0])
            apart = self.skipping(ids, key)
            lengths = self.sizes["symbols"][ids[apart]]
            apart = apart[np.argsort(lengths, kind="stable")]
            odd = apart[: np.count_nonzero(lengths == 0)]
            for start in range(len(odd), len(apart), 20_000):
                part = apart[start : start + 20_000]
                at = self.places_of("symbols", ids[part])
                numbers, counts[part] = self.in_step(self.sizes["symbols"][ids[part]], *(self.kept[k][at] for k in ("symbols", "pairs", "wholes")), key[part])
                starts[part] = size + np.cumsum(counts[part]) - counts[part]
                pool.append(numbers)
                size += len(numbers)
            for i in odd.tolist():
                numbers = np.frombuffer(self.numbers(self.merged(words[i], int(key[i]))), "<i4")
                starts[i], counts[i] = size, len(numbers)
                pool.append(numbers)
                size += len(numbers)
        flat = np.concatenate(pool)[runs(starts, counts)].astype("<i4")
        bounds = np.append(0, np.cumsum(counts))[[0, *ends]].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def keys(self, key: int, n: int) -> np.ndarray:
        """A key for each of a text's n words, by its place."""
        x = np.uint64(key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def decode_bytes(self, numbers: np.ndarray) -> bytes:
        data = self.plain[runs(self.plain_starts[numbers], self.plain_sizes[numbers])].tobytes()
        return data[1:] if data.startswith(b" ") else data

    def decode(self, numbers: np.ndarray) -> str:
        return self.decode_bytes(numbers).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: dict[str, Column] | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` with ``pieces`` (numbers), ``n_pieces`` and ``lossless``, a row for each row of ``docs``.

    ``lossless`` tells whether decoding the pieces gives back the text. Null texts are
    encoded as empty ones, without pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c.alias(k) for k, c in (keep or {"doc_id": F.col("doc_id")}).items()], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(sent.value, dropout, seed)
        for b in steps(batches, "__text", STEP_BYTES):
            own = texts(b, "__text")
            numbers = codec.encode_all(own)
            sizes = [len(n) for n in numbers]
            flat = np.concatenate(numbers) if numbers else np.zeros(0, "<i4")
            pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
            same = [codec.decode_bytes(n) == t.encode("utf-8", "surrogatepass") for n, t in zip(numbers, own, strict=True)]
            yield added(b, "__text", pieces=pieces, n_pieces=pa.array(sizes, pa.int64()), lossless=pa.array(same, pa.bool_()))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("__text").dtypes)
    return rows.mapInArrow(run, f"{schema}, pieces array<int>, n_pieces long, lossless boolean")


def decode(rows: DataFrame, model: bytes, pieces: str = "pieces", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` with ``text``, decoded from piece numbers; null for null."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    own = rows.select(*[c.alias(k) for k, c in (keep or {"doc_id": F.col("doc_id")}).items()], F.col(pieces).alias("__pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(sent.value, 0.0)
        for b in batches:
            yield added(b, "__pieces", text=pa.array([None if x is None else codec.decode(np.array(x, "<i4")) for x in b.column("__pieces").to_pylist()], pa.string()))

    schema = ", ".join(f"`{n}` {t}" for n, t in own.drop("__pieces").dtypes)
    return own.mapInArrow(run, f"{schema}, text string")
