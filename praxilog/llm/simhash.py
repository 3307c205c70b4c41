"""SimHash near-duplicates: fingerprints, exact tiled comparison, connected groups.

Fingerprints are packed into tiles by the population counts of their four quarters. Two
fingerprints within the radius differ by no more than the radius in those counts, summed,
so only tiles whose counts are that near meet; numpy compares each such pair of tiles by
exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, added, joined_evenly, steps, texts, written
from .components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that a tile holds, about.
TILE = 2048
#: Rows of a tile that are compared with another whole tile at a time.
STRIP = 256
#: Tiles of a cell that another tile meets at one place; a pair of cells with more tiles meets at several.
GROUP = 8


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text as a signed 64-bit integer; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id`` (of any type), ``digest`` of the text, and ``fp`` (long). Null texts count as empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            yield added(b, "text", fp=pa.array([fingerprint(t, shingle, seed) for t in texts(b, "text")], pa.int64()))

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, fp long")


def joined(parents: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] with b[i] in an array of least parents, in place."""
    while len(a):
        x, y = parents[a], parents[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parents, np.maximum(x, y), np.minimum(x, y))
        while (parents[parents] != parents).any():
            parents[:] = parents[parents]


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> np.ndarray:
    """Links that join all of two tiles' fingerprints that are linked: rows (fingerprint, another), fewer than fingerprints."""
    nodes = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    parents = np.arange(len(nodes))
    for start in range(0, len(left), STRIP):
        near = np.bitwise_count(left[start : start + STRIP, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        joined(parents, i + start, j + shift)
    own = np.flatnonzero(parents != np.arange(len(nodes)))
    return np.stack([nodes[own], nodes[parents[own]]], axis=1)


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``u``, ``v`` between the distinct fingerprints ``fp``, enough to join all within the radius."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    cell = sum((c * 17**q for q, c in enumerate(counts)), F.lit(0)).cast("int")
    rows = fps.select("fp", cell.alias("cell"))
    many = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")))  # at most 17**4 cells
    rows = rows.join(many, "cell")
    tiles = rows.groupBy("cell", "tiles", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile")).agg(F.collect_list("fp").alias("fps"))
    tiles = written(tiles, "tiles")
    cells = F.broadcast(tiles.groupBy("cell").agg(F.max("tiles").alias("there")))
    steps_ = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    quarter = lambda q: (F.col("cell") / F.lit(17**q)).cast("int") % 17
    moves = F.filter(
        F.array(*[F.when(F.lit(True) if not any(d) else _inside(quarter, d), F.struct((F.col("cell") + sum(x * 17**q for q, x in enumerate(d))).cast("int").alias("to"), F.lit(not any(d)).alias("own"))) for d in steps_]),
        lambda x: x.isNotNull(),
    )
    left = tiles.select("tile", "fps", F.explode(moves).alias("m")).select(F.col("tile").alias("a"), F.col("fps").alias("left"), F.col("m.to").alias("cell"), F.col("m.own").alias("own"))
    group = lambda c: F.floor(c / F.lit(GROUP)).cast("int")
    left = left.join(cells, "cell").select("*", F.explode(F.sequence(F.when(F.col("own"), group(F.col("a"))).otherwise(0), group(F.col("there") - 1))).alias("group"))
    right = tiles.select("cell", F.col("tile").alias("b"), group(F.col("tile")).alias("group"), F.col("fps").alias("right"))
    pairs = left.join(right, ["cell", "group"]).where("not own or a <= b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            same = batch.column("same").to_pylist()
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values.to_numpy().view(np.uint64) for c in ("left", "right")]
                links = tile_links(*sides, same[k], radius)
                if len(links):
                    found.append(links)
            links = np.concatenate(found).view(np.int64) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    return pairs.select("left", "right", (F.col("own") & (F.col("a") == F.col("b"))).alias("same")).mapInArrow(run, "u long, v long")


def _inside(quarter, move: tuple[int, ...]):
    """Whether the quarters' counts stay from 0 to 16 after a move."""
    out = F.lit(True)
    for q, x in enumerate(move):
        if x:
            out = out & (quarter(q) + x).between(0, 16)
    return out


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """:func:`near_duplicates` with the texts' ``digest``."""
    rows = written(fingerprints(docs, text, doc_id), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    total, kinds = fps.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = connected_components(near_fingerprints(fps, radius), "u", "v").select(F.col("node").alias("fp"), "component")
    rooted = written(fps.join(parts, "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root")), "rooted-fingerprints")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    found = joined_evenly(rooted, least, ["root"], F.col("many") * HOT > kinds, ["fp"]).select("fp", "n", "component_id")
    return joined_evenly(rows, found, ["fp"], F.col("n") * HOT > total, ["doc_id"]).drop("n")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp``, ``component_id``.

    Documents of the same component are linked by fingerprints that differ in at most
    ``radius`` bits; the component's id is its least ``doc_id``. Texts without words have
    fingerprint 0 and link like any other. Ids are of any orderable type. Rows that repeat
    an id are documents of that id, each with its own text's fingerprint and component. A
    component whose ids are all null has a null id. No rows: no rows.
    """
    return grouped(docs, text, doc_id, radius).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, and rows without an id.

    Rows that repeat an id are judged each by its own text; those of a kept id that are in
    the same component stay together.
    """
    gone = grouped(docs, text, doc_id, radius).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest")).distinct()
    return docs.join(gone, (docs[doc_id] == gone["__gone"]) & (F.xxhash64(docs[text]) == gone["__digest"]), "left_anti")
