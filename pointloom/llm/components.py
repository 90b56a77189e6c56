"""Connected components in DataFrame operations alone (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """The least of each node u and its neighbours v; saved, so that its join is of two plain sides and can be split at a hub."""
    return checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the least node of its component.

    Large-star joins each node's larger neighbours to its least one, small-star its
    smaller ones; the two alternate until the edges stay as they are.  Least
    neighbours are aggregated before any shuffle, so a hub with a third of all edges
    costs one row per task; joining them back is a plain equi-join, which adaptive
    execution splits at a hub.  Loops and null nodes are left out; a loop's node is
    kept as a component of its own.  An empty table gives an empty result.
    """
    e = edges.select("u", "v").where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    e = checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = _both_ways(e)
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where("u <> v").distinct())
        m = _least(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("r"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("r", "node").alias("root"))
