"""Steps through nested results as Column expressions: what a path query over a result tree
asks for, written as DataFrame operations. Deep levels are rows of the flat match table
(``node_id``, ``parent_id``), so descent at any depth is a join (:func:`descendants`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def child(value: Column, *names: str) -> Column:
    for name in names:
        value = value[name]
    return value


def element(items: Column, index: int) -> Column:
    """One element; a negative index counts from the end; null outside."""
    return F.get(items, F.lit(index) if index >= 0 else F.size(items) + index)


def members(items: Column) -> Column:
    """All values of a map as an array."""
    return F.map_values(items)


def union(items: Column, indexes: list[int]) -> Column:
    return F.filter(F.array(*[element(items, i) for i in indexes]), lambda x: x.isNotNull())


def span(items: Column, start: int = 0, end: int | None = None, step: int = 1) -> Column:
    """Every ``step``-th element from ``start`` up to, not including, ``end``."""
    n = F.size(items)
    begin = F.least(n, F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start))
    stop = n if end is None else F.least(n, F.greatest(F.lit(0), F.lit(end) if end >= 0 else n + end))
    cut = F.slice(items, begin + 1, F.greatest(stop - begin, F.lit(0)))
    return F.filter(cut, lambda x, i: i % step == 0)


def where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(items, test)


def descendants(nodes: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Nodes at most ``depth`` levels under ``roots`` (``doc_id``, ``node_id``), with their root.
    The catalogue bounds the depth, so this is a fixed number of joins."""
    level = roots.select("doc_id", F.col("node_id").alias("root_id"), F.col("node_id").alias("at"))
    out = None
    for _ in range(depth):
        level = level.join(nodes.select("doc_id", F.col("parent_id").alias("at"), "node_id"), ["doc_id", "at"]).select(
            "doc_id", "root_id", F.col("node_id").alias("at")
        )
        out = level if out is None else out.union(level)
    return out.join(nodes.withColumnRenamed("node_id", "at"), ["doc_id", "at"]).withColumnRenamed("at", "node_id")
