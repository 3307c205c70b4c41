"""Removal of long byte strings that earlier documents hold, by families of suffix arrays.

Suffixes are compared over ``LENGTH`` bytes. Texts are cut into units: runs of suffixes
whose first bytes have the same least gram hash, so that equal suffixes of any documents
lie in units of the same gram. A first exchange tells which grams more than one document
has; only their units go on, to the shard of the gram. A shard takes units batch by batch
in order of documents: each batch's suffixes are sorted, merge-scanned against the sorted
levels that stand for all earlier documents, and what is new becomes a level; levels of
like size merge, so that there are logarithmically many.

Packets of documents are what tasks exchange: what is equal within a packet is settled
there, so a string that a third of all documents share costs a shard one entry a packet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, joined_evenly

LENGTH = 50
GRAM = 16
#: Text of a packet and of a shard, about, in bytes.
PACKET_BYTES, SHARD_BYTES = 2 << 20, 12 << 20
#: Units of a batch of a shard's family, and its suffixes.
BATCH, BATCH_SUFFIXES = 20_000, 400_000
#: Suffixes of a unit; what repeats itself for longer makes several.
MOST_SUFFIXES = 4096
#: Text whose grams are hashed at a time; arrays are several times its size.
SLICE_BYTES = 1 << 20


def least_grams(data: np.ndarray) -> np.ndarray:
    """For each place of which LENGTH bytes follow: the least hash of the grams in them."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[width - span : width - span + n])


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of texts: their text's number, first and last suffix, and gram hash."""
    out = []
    # long texts go in slices that share LENGTH - 1 bytes, so that each suffix lies whole in one
    slices = ((k, at, t[at : at + SLICE_BYTES + LENGTH - 1]) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - LENGTH + 1), SLICE_BYTES))
    for group in _by_bytes(slices):
        lengths = np.array([len(t) for _, _, t in group], np.int64)
        ends = np.cumsum(lengths)
        least = least_grams(np.frombuffer(b"".join(t for _, _, t in group), np.uint8))
        if not len(least):
            continue
        part = np.repeat(np.arange(len(group)), lengths)[: len(least)]
        whole = np.arange(len(least)) + LENGTH <= ends[part]
        heads = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (part[1:] != part[:-1])]) & whole)
        last = np.minimum(np.concatenate([heads[1:], [len(least)]]) - 1, ends[part[heads]] - LENGTH)
        times = (last - heads) // MOST_SUFFIXES + 1
        last = np.repeat(last, times)
        heads = np.repeat(heads, times) + (np.arange(len(last)) - np.repeat(np.cumsum(times) - times, times)) * MOST_SUFFIXES
        last = np.minimum(last, heads + MOST_SUFFIXES - 1)
        own = part[heads]
        base = (ends - lengths)[own] - np.array([at for _, at, _ in group], np.int64)[own]
        out.append((np.array([k for k, _, _ in group], np.int64)[own], heads - base, last - base, least[heads]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _by_bytes(slices: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Slices in groups of about SLICE_BYTES."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for s in slices:
        if group and size + len(s[2]) > SLICE_BYTES:
            yield group
            group, size = [], 0
        group.append(s)
        size += len(s[2])
    if group:
        yield group


class SuffixFamily:
    """Sorted arrays of suffixes of LENGTH bytes, each with the least document that has it."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Adds a batch; returns the least document of each suffix. Documents must not decrease, from batch to batch too."""
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        run = np.cumsum(first) - 1
        own, least = ranked[first], docs[order][first]
        new = np.ones(len(own), bool)
        for keys, known in self.levels:  # merge-scan of two sorted arrays
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            least[hit] = known[at[hit]]
            new &= ~hit
        out = np.empty(len(suffixes), np.int64)
        out[order] = least[run]
        if new.any():
            self.levels.append((own[new], least[new]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            keys = np.concatenate([b, a])
            order = np.argsort(keys, kind="stable")
            self.levels.append((keys[order], np.concatenate([y, x])[order]))
        return out


def suffixes_of(parts: list[bytes] | list[memoryview]) -> np.ndarray:
    """All suffixes of LENGTH bytes of units, in order."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    many = sizes - LENGTH + 1
    at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]).view(f"S{LENGTH}").ravel()


def _five(hashes: np.ndarray) -> bytes:
    """The five low bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


#: What is sent of units, and as what.
KINDS = {"docs": "<i8", "rows": "<i4", "firsts": "<i4", "grams": "<u8", "sizes": "<i4"}


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


LOW = np.uint64((1 << 40) - 1)


def _bytes(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """A packet's rows in order of their ids, ties by text; those without id are left out.

    The order is the same wherever the packet is read, so a row's number in it names the row.
    """
    rows = sorted((i, (t or "").encode("utf-8", "surrogatepass")) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True) if i is not None)
    return np.array([i for i, _ in rows], np.int64), [t for _, t in rows]


def _copied(ids: np.ndarray, texts: list[bytes], copies: dict[int, set[bytes]]) -> np.ndarray:
    """Which rows are whole copies, given the digests of each id's."""
    return np.array([i in copies and hashlib.sha256(t).digest() in copies[i] for i, t in zip(ids.tolist(), texts, strict=True)], bool)


def packed_grams(table: pa.Table, shards: int) -> Iterator[tuple]:
    """Of a packet, for each shard: the grams that its documents have, once, and whether two documents of it have them."""
    ids, texts = _bytes(table)
    doc, _, _, gram = units(texts)
    pairs = np.unique(np.stack([gram & LOW, ids[doc].astype(np.uint64)]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
    some, n = np.unique(pairs[0], return_counts=True)
    shard = some % np.uint64(shards)
    for s in np.unique(shard):
        own = shard == s
        yield int(s), _five(some[own]), np.packbits(n[own] > 1).tobytes()


def shared_grams(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Of a shard, for each packet: its grams that two documents or more have, anywhere."""
    packets = table["packet"].to_pylist()
    lists = [_from_five(x) for x in table["grams"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(g)).astype(bool) for m, g in zip(table["twice"].to_pylist(), lists, strict=True)]
    every = np.concatenate(lists)
    some, at, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = n > 1
    shared[at[np.concatenate(twice)]] = True
    start = 0
    for p, own in zip(packets, lists, strict=True):
        kept = own[shared[at[start : start + len(own)]]]
        start += len(own)
        if len(kept):
            yield p, _five(kept)


def _copies(replies: pa.Table) -> dict[int, set[bytes]]:
    """Ids whose texts are whole copies of smaller documents' texts, with the texts' digests."""
    out: dict[int, set[bytes]] = {}
    if replies.num_rows:
        for i, digest in zip(replies["doc_id"].to_pylist(), replies["digest"].to_pylist(), strict=True):
            if digest is not None:
                out.setdefault(i, set()).add(digest)
    return out


def packed_units(table: pa.Table, shared: np.ndarray, copies: dict[int, set[bytes]], shards: int) -> tuple[dict[int, list], list[tuple[int, int, int]]]:
    """Of a packet: for each shard its units of shared grams, once each; and suffixes (row, first, last) settled here.

    Units go as (document, row, first suffix, gram, bytes). Whole copies are left out. Rows
    come in order of documents, so a unit stands for the least.
    """
    ids, texts = _bytes(table)
    doc, first, last, gram = units(texts)
    keep = np.isin(gram & LOW, shared)
    if copies and len(doc):
        keep &= ~_copied(ids, texts, copies)[doc]
    out: dict[int, list] = {}
    settled: list[tuple[int, int, int]] = []
    seen: dict[bytes, int] = {}
    for d, a, b, g in zip(doc[keep].tolist(), first[keep].tolist(), last[keep].tolist(), gram[keep].tolist(), strict=True):
        part = texts[d][a : b + LENGTH]
        i = int(ids[d])
        if (least := seen.setdefault(part, i)) < i:
            settled.append((d, a, b))
        elif least == i:
            out.setdefault((g & int(LOW)) % shards, []).append((i, d, a, g, part))
    return out, settled


def settle(docs: np.ndarray, packets: np.ndarray, rows: np.ndarray, firsts: np.ndarray, grams: np.ndarray, sizes: np.ndarray, data: bytes) -> np.ndarray:
    """Of a shard's units, whose bytes follow each other in ``data``: rows (packet, row, first, last) of suffixes that smaller documents have."""
    if not len(docs):
        return np.zeros((0, 4), np.int64)
    ends = np.cumsum(sizes)
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    same = np.frombuffer(b"".join(digest(view[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)), "<u8").reshape(-1, 2)
    order = np.lexsort((firsts, docs, same[:, 1], same[:, 0]))
    new = np.concatenate([[True], (same[order[1:]] != same[order[:-1]]).any(axis=1)])
    least = docs[order][new][np.cumsum(new) - 1]
    later = order[docs[order] > least]
    out = [np.stack([packets[later], rows[later], firsts[later], firsts[later] + sizes[later] - LENGTH], axis=1)]
    some, n = np.unique(grams[order[new]], return_counts=True)
    heads = order[docs[order] == least]
    heads = heads[n[np.searchsorted(some, grams[heads])] > 1]  # a gram with one unit has no other suffixes to meet
    heads = heads[np.lexsort((firsts[heads], docs[heads]))]
    family, start = SuffixFamily(), 0
    while start < len(heads):
        many = np.cumsum(sizes[heads[start : start + BATCH]] - LENGTH + 1)
        batch = heads[start : start + max(1, int(np.searchsorted(many, BATCH_SUFFIXES, "right")))]
        start += len(batch)
        many = sizes[batch] - LENGTH + 1
        own = np.repeat(docs[batch], many)
        earlier = family.add(suffixes_of([view[e - n : e] for e, n in zip(ends[batch].tolist(), sizes[batch].tolist(), strict=True)]), own) < own
        edge = np.cumsum(many) - many
        head, tail = np.zeros(len(own) + 1, bool), np.zeros(len(own) + 1, bool)
        head[edge] = tail[edge] = True  # runs end with their unit
        begin = np.flatnonzero(earlier & (head[:-1] | ~np.concatenate([[False], earlier[:-1]])))
        end = np.flatnonzero(earlier & (np.concatenate([tail[1:-1], [True]]) | ~np.concatenate([earlier[1:], [False]])))
        k = np.repeat(np.arange(len(batch)), many)[begin]
        base = firsts[batch][k] - edge[k]
        out.append(np.stack([packets[batch][k], rows[batch][k], base + begin, base + end], axis=1))
    return np.concatenate(out)


def cut_spans(text: bytes, ranges: list[tuple[int, int]]) -> tuple[list[list[int]], bytes]:
    """Maximal removed runs [begin, end) of suffixes' ranges, and the bytes that are left."""
    spans: list[list[int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + LENGTH)
        else:
            spans.append([a, b + LENGTH])
    left, at = [], 0
    for a, b in spans:
        left.append(text[at:a])
        at = b
    return spans, b"".join([*left, text[at:]])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``spans`` (begin, end in bytes).

    Removed is each byte that a string of LENGTH bytes covers which also starts in a document
    of a smaller id, judged on the input. Ids are whole numbers (or text of such; other text
    is an error). Texts of fewer bytes lose nothing; null texts are empty. Rows that repeat
    an id are not smaller than each other, and each loses what its own text shares with
    smaller ids; rows without an id neither lose bytes nor make others lose them. No rows:
    no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    packets, shards = max(8, -(-total // PACKET_BYTES)), max(8, -(-total // SHARD_BYTES))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(packets)).cast("int")
    ids = rows.where((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull()).select(key.alias("packet"), "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    least = ids.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("times")).where("least < most")
    copies = joined_evenly(ids, least, ["digest"], F.col("times") * HOT > n, ["doc_id"]).where("doc_id > least").select("packet", F.lit(None).cast("binary").alias("grams"), "doc_id", "digest")
    rows = rows.select(key.alias("packet"), "doc_id", "text").repartition("packet")

    def grams(table: pa.Table) -> pa.Table:
        packet = table["packet"][0].as_py()
        found = list(packed_grams(table, shards))
        return pa.table({"packet": pa.array([packet] * len(found), pa.int32()), "shard": pa.array([f[0] for f in found], pa.int32()), "grams": pa.array([f[1] for f in found], pa.binary()), "twice": pa.array([f[2] for f in found], pa.binary())})

    def share(table: pa.Table) -> pa.Table:
        found = list(shared_grams(table))
        return pa.table({"packet": pa.array([f[0] for f in found], pa.int32()), "grams": pa.array([f[1] for f in found], pa.binary())})

    shared = rows.groupBy("packet").applyInArrow(grams, "packet int, shard int, grams binary, twice binary").groupBy("shard").applyInArrow(share, "packet int, grams binary")
    no_copy = (F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"))
    replies = shared.select("*", *no_copy).unionByName(copies)

    def entries(left: pa.Table, right: pa.Table) -> pa.Table:
        own = [_from_five(x) for x in right["grams"].to_pylist() if x is not None] if right.num_rows else []
        columns: dict[str, list] = {k: [] for k in ("shard", "packet", *KINDS, "data")}

        def put(shard: int, data: bytes, **arrays: np.ndarray) -> None:
            for k, v in {"shard": shard, "packet": packet, "data": data, **{k: v.astype(KINDS[k]).tobytes() for k, v in arrays.items()}}.items():
                columns[k].append(v)

        if left.num_rows:
            packet = left["packet"][0].as_py()
            parts, settled = packed_units(left, np.concatenate(own) if own else np.zeros(0, np.uint64), _copies(right), shards)
            if settled:
                row, first, last = np.array(settled, np.int64).T
                put(-1 - packet, b"", docs=row, rows=row, firsts=first, grams=np.zeros(0), sizes=last - first + LENGTH)
            for s, list_ in parts.items():
                i, row, first, gram = (np.array([e[k] for e in list_], np.uint64 if k == 3 else np.int64) for k in range(4))
                put(s, pa.compress(b"".join(e[4] for e in list_), "zstd", asbytes=True), docs=i, rows=row, firsts=first, grams=gram, sizes=np.array([len(e[4]) for e in list_]))
        return pa.table({k: pa.array(v, pa.int32() if k in ("shard", "packet") else pa.binary()) for k, v in columns.items()})

    def verdicts(table: pa.Table) -> pa.Table:
        lists = {k: [np.frombuffer(x, t) for x in table[k].to_pylist()] for k, t in KINDS.items()}
        packets = np.repeat(np.array(table["packet"].to_pylist(), np.int64), [len(x) for x in lists["docs"]])
        docs_, rows_, firsts, grams_, sizes = (np.concatenate(lists[k]).astype(np.uint64 if k == "grams" else np.int64) for k in KINDS)
        if table["shard"][0].as_py() < 0:  # what a packet has settled
            found = np.stack([packets, rows_, firsts, firsts + sizes - LENGTH], axis=1)
        else:
            data = b"".join(pa.decompress(x, int(n.sum()), "zstd", asbytes=True) for x, n in zip(table["data"].to_pylist(), lists["sizes"], strict=True))
            found = settle(docs_, packets, rows_, firsts, grams_, sizes, data)
        found = found[np.argsort(found[:, 0], kind="stable")]
        some, at = np.unique(found[:, 0], return_index=True)
        parts = np.split(found[:, 1:], at[1:]) if len(some) else []
        return pa.table({"packet": pa.array(some, pa.int32()), "ranges": pa.array([np.ascontiguousarray(x, "<i4").tobytes() for x in parts], pa.binary())})

    ranges = rows.groupBy("packet").cogroup(replies.groupBy("packet")).applyInArrow(entries, ", ".join(["shard int, packet int", *(f"{k} binary" for k in KINDS), "data binary"]))
    ranges = ranges.groupBy("shard").applyInArrow(verdicts, "packet int, ranges binary")
    ranges = ranges.select("*", *no_copy).unionByName(copies.withColumnRenamed("grams", "ranges"))

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, int]]] = {}
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        if left.num_rows:
            ids, data = _bytes(left)
            for x in right["ranges"].to_pylist() if right.num_rows else ():
                if x is not None:
                    for row, a, b in np.frombuffer(x, "<i4").reshape(-1, 3).tolist():
                        by.setdefault(row, []).append((a, b))
            for row in np.flatnonzero(_copied(ids, data, _copies(right))).tolist():
                by[row] = [(0, len(data[row]) - LENGTH)]
            alone = [(t or "").encode("utf-8", "surrogatepass") for i, t in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True) if i is None]
            for row, (i, t) in enumerate(zip([*ids.tolist(), *[None] * len(alone)], [*data, *alone], strict=True)):
                spans, kept = cut_spans(t, by.get(row, []))
                for k, v in {"doc_id": i, "n_bytes": len(t), "n_removed": len(t) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": spans}.items():
                    out[k].append(v)
        kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64()))}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return rows.groupBy("packet").cogroup(ranges.groupBy("packet")).applyInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
