"""What depends on what, as tables: levels, ancestry digests, and what a changed file spoils.

``nodes`` have ``id`` and ``checksum`` (null where nothing can be checked) and ``edges`` have
``child`` and ``parent``. Graphs are peeled in rounds of joins, one for each level, so that
neither nodes nor edges come to one task; the number of rounds is the longest chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

BLOCK = 1 << 20


def file_checksums(nodes: DataFrame, path: str = "path") -> DataFrame:
    """``nodes`` with ``found``, the SHA-256 of their files, read in tasks a block at a time; null without a path or a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch[path]:
                own = None
                if name is not None:
                    try:
                        with open(name, "rb") as f:
                            own = hashlib.sha256()
                            while block := f.read(BLOCK):
                                own.update(block)
                    except (FileNotFoundError, IsADirectoryError):
                        own = None
                found.append(own and own.hexdigest())
            yield batch.assign(found=found)

    return nodes.repartition(F.xxhash64("id")).mapInPandas(run, nodes.schema.simpleString()[len("struct<") : -1] + ",found:string")


def levels(nodes: DataFrame, edges: DataFrame, digests: tuple[str, ...] = ()) -> DataFrame:
    """Each node's ``level``: 0 without parents, else one more than its highest parent's; null on a cycle or below one.

    Parents that are not among the nodes count as nodes without a checksum. For each column of
    ``digests`` there is ``<column>_ancestry``: the SHA-256 of the id, that column and the
    parents' ancestries in order, which changes if anything that a node rests on does.
    """
    edges = edges.select("child", "parent").distinct()
    every = edges.select(F.col("parent").alias("id")).union(edges.select("child")).distinct()
    left = cut(nodes.select("id", *digests).unionByName(every.join(nodes, "id", "left_anti"), allowMissingColumns=True))
    edges, out, level = cut(edges), None, 0
    inherited = left.limit(0).select("id", *[F.array().cast("array<string>").alias(f"{d}_above") for d in digests])
    while True:
        ready = left.join(edges.select(F.col("child").alias("id")), "id", "left_anti").join(inherited, "id", "left")
        text = lambda d: F.concat_ws("|", "id", F.coalesce(d, F.lit("")), F.array_join(F.sort_array(F.coalesce(f"{d}_above", F.array().cast("array<string>"))), ","))
        ready = cut(ready.select("id", F.lit(level).alias("level"), *[F.sha2(text(d), 256).alias(f"{d}_ancestry") for d in digests]))
        if not ready.limit(1).count():
            break
        out = ready if out is None else out.union(ready)
        # what a node inherits is kept until all of its parents are known
        passed = edges.join(ready.withColumnRenamed("id", "parent"), "parent")
        parts = passed.select(F.col("child").alias("id"), *[F.array(f"{d}_ancestry").alias(f"{d}_above") for d in digests])
        inherited = inherited.unionByName(parts).groupBy("id").agg(F.first("id").alias("same"), *[F.flatten(F.collect_list(f"{d}_above")).alias(f"{d}_above") for d in digests]).drop("same")
        edges = cut(edges.join(ready.select(F.col("id").alias("parent")), "parent", "left_anti"))
        left = cut(left.join(ready, "id", "left_anti"))
        inherited = cut(inherited.join(left.select("id"), "id", "left_semi"))
        level += 1
    rest = left.select("id", F.lit(None).cast("int").alias("level"), *[F.lit(None).cast("string").alias(f"{d}_ancestry") for d in digests])
    return rest if out is None else out.union(rest)


def unsound(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that can't be trusted, with their ``level`` and the ``reason``; none for a sound graph.

    ``nodes`` have ``found`` too, what their checksum is now. Reasons: ``missing`` or
    ``changed`` for a node's own content, ``ancestor`` where only something that it rests on
    is missing or changed, ``cycle`` where no order exists, ``unknown`` for a parent that is not a node.
    """
    nodes = cut(nodes.select("id", "checksum", "found"))
    checked = nodes.withColumn("found", F.when(F.col("checksum").isNotNull(), F.coalesce("found", F.lit("missing"))))
    all_levels = levels(checked, edges, ("checksum", "found"))
    rows = all_levels.join(nodes.withColumn("node", F.lit(True)), "id", "left")
    own = F.when(F.col("node").isNull(), "unknown").when(F.col("checksum").isNotNull() & F.col("found").isNull(), "missing").when(F.col("checksum") != F.col("found"), "changed")
    reason = F.coalesce(own, F.when(F.col("level").isNull(), "cycle"), F.when(F.col("checksum_ancestry") != F.col("found_ancestry"), "ancestor"))
    return rows.select("id", "level", reason.alias("reason")).where("reason is not null")
