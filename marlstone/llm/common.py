"""Shared helpers: table loading, joins with hot keys and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.stages import drop_stage, settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_split(left: DataFrame, right: DataFrame, keys: list[str], weight: str, most: int = 4096) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``weight`` about how
    many rows of ``left`` bear it. Keys with more than a ``most``-th of that weight, of which
    there are fewer than ``most``, are joined by broadcast, so that no hot key is dealt to one
    task; all others are shuffled. ``right`` is read several times: give a stage table."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * most > total
    hot = F.broadcast(right.filter(is_hot))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(~is_hot).hint("merge"), keys)
    return left.join(hot, keys).unionByName(cold)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; the result has ``node`` and ``component``,
    one row for each node that has an edge to another. Alternating large-star and small-star
    rounds with plain joins and partially aggregated minima, so a hub with millions of edges
    is never gathered into a group; its rows, two ids each, pass through one task of a join.
    Self-loops and repeated edges are allowed; no edges gives no rows."""
    if "component" in edges.columns:
        raise ValueError("edges must have columns a and b only")
    cur = settled(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select("lo", "hi"))
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if not mark[0] or seen == tuple(mark):
            break
        seen = tuple(mark)
        # large star: every neighbour above a node is hung on the smallest of its neighbourhood
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.filter("v > u").join(low, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo").distinct()
        )
        # small star: the smaller neighbours of a node are hung on the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct()
        )
        nxt = settled(small)
        drop_stage(cur)
        cur = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("lo").alias("node")).distinct()
    return (
        cur.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        .union(roots.select("node", F.col("node").alias("component")))
    )
