"""Connected components of a graph given as a DataFrame of edges, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, cut, joined_evenly

#: Edges that a task takes in a round. Where one task takes all that are left, its rounds need no shuffle.
TASK_EDGES = 1 << 17


def _packed(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` edges in as few partitions as their number asks for, so that the rounds of a small graph write no empty files."""
    return edges.coalesce(-(-n // TASK_EDGES))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _least(links: DataFrame, total: int) -> DataFrame:
    """``links`` (``u``, ``v``) with ``m``, the least ``v`` of each ``u``; a ``u`` of many links is no one task's."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return joined_evenly(links, least, ["u"], F.col("n") * HOT > total, ["v"]).drop("n")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each node of the edges with the least node that it reaches: columns ``node``, ``component``.

    Large-star and small-star rounds take turns until the edges stay the same; every
    round groups with map-side minima, joins them back, and is checkpointed. Nodes with
    over a HOT'th of the links are broadcast with their minima, and edges are in as many
    partitions as TASK_EDGES asks for. Nodes of any orderable
    type; null nodes are ignored. No edges: no rows.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = _packed(edges, mark[0])
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
        both = _least(edges.select(ways).select("e.u", "e.v"), 2 * mark[0])
        # each node sends its larger neighbours to the least of its neighbourhood
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # and its smaller neighbours and itself
        small = _least(large, mark[0]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return nodes.union(roots.join(nodes.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
