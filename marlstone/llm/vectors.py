"""Vectors as whole numbers, and loops over the lengths that a table holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and holds no null, NaN or infinite number."""
    v = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter(v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)))


def scaled(column: pa.Array, factor: int, most: int) -> np.ndarray:
    """Rows of floor(factor * x) in 64 bits; beyond ``most`` either way they are ``most``."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(x * factor), -most, most).astype(np.int64).reshape(len(column), -1)


def by_length(vectors: DataFrame, vec_col: str, work: Callable[[DataFrame, int], DataFrame | None], schema: str) -> DataFrame:
    """Union of ``work(rows, length)`` over the lengths of vectors in the table; lengths are few."""
    sized = vectors.withColumn("_d", F.size(vec_col))
    parts = [work(sized.filter(F.col("_d") == d).drop("_d"), d) for (d,) in sorted(map(tuple, sized.select("_d").distinct().collect()))]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)


def column_sums(rows: DataFrame, numbers: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each place, of the whole numbers that ``numbers`` makes of a batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, 0
        for batch in batches:
            x = numbers(batch)
            count, total = count + len(x), total + x.sum(0)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), count)), pa.array(total)], ["at", "n", "s"])

    got = rows.mapInArrow(partial, "at long, n long, s long").groupBy("at").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).collect()
    got = sorted(tuple(r) for r in got)
    return (int(got[0][1]) if got else 0), [int(r[2]) for r in got]
