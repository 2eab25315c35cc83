"""Embedding whitening: principal components of centred whole-number vectors, by MLlib's SVD.

The rows of the distributed matrix are centred by exact sums; their right singular vectors are the
components, and a singular value s gives the eigenvalue s * s / n of the covariance with divisor
n. The total variance does not come from the decomposition but from the exact deviations."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table
from marlstone.llm.vectors import by_length, column_sums, scaled, usable
from marlstone.operators.stages import settled

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Components beyond this, as whole numbers, count as this, so that sums fit in 64 bits.
MOST = 1 << 40
#: Up to this length the whole Gram matrix is decomposed, to double precision; longer vectors leave
#: the leading components to MLlib's iteration.
WHOLE = 2048
#: Components whose singular value is below this share of the first are rounding errors.
LEAST = 1e-6

SCHEMA = "_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return scaled(batch.column("_v"), SCALE, MOST) + SHIFT


def exact_squares(y: np.ndarray) -> list[int]:
    """Sum of squares of each row of whole numbers, without overflow: halves of 26 bits where they fit."""
    if np.abs(y).max(initial=0) >= 1 << 52 or y.shape[1] > 1024:
        return [sum(int(v) ** 2 for v in row) for row in y]
    high, low = y >> 26, y & ((1 << 26) - 1)
    parts = [(a * b).sum(1).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(a << 52) + (b << 27) + c for a, b, c in zip(*parts, strict=True)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors`` and component: id (long), ``component`` (1 for the largest
    variance), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds null or non-finite numbers are dropped; the others are all
    fitted, repeated rows and null ids too. Vectors of each length are fitted on their own. There
    are as many components as directions with variance, ``most`` at the utmost: none for empty
    vectors, a single row or equal rows, which then have no row in the result. Of components of equal variance any basis may come.
    ``deviation`` is null where it exceeds 64 bits. Components beyond 2**30 count as that. An empty
    table gives no rows; other columns are ignored, whatever their names."""
    base = usable(vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")), "_v")

    def fitted(rows: DataFrame, length: int) -> DataFrame | None:
        n, sums = column_sums(rows, _numbers) if length else (0, [])
        if n < 2:
            return None
        # x * n - S may need more than 64 bits: both are taken relative to a whole number near the mean
        near = np.array([s // n for s in sums])
        rest = np.array([s - n * int(m) for s, m in zip(sums, near, strict=True)])

        def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = (_numbers(batch) - near) - rest / n
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], ["x"])

        vector = rows.mapInArrow(centred, "x array<double>").select(array_to_vector("x").alias("x"))
        matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vector, "x"))
        found = matrix.computeSVD(length if length <= WHOLE else most, computeU=False, rCond=LEAST)
        s = found.s.toArray()[:most]
        if not len(s) or not s[0] > 0:
            return None
        project, value = found.V.toArray()[:, : len(s)] / (s / np.sqrt(n)), s * s / n

        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = _numbers(batch) - near
                far = np.abs(y).max(initial=0) >= (1 << 62) // n
                exact = exact_squares(y * n - rest) if not far else [sum((int(v) * n - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]
                white = (y - rest / n) @ project
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(map(Decimal, exact), pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64()))], ["_id", "d", "w"]
                )

        done = settled(rows.mapInArrow(projected, "_id long, d decimal(38,0), w array<double>"))
        pairs = [(i, j) for i in range(len(s)) for j in range(i + 1)]
        stats = done.agg(F.sum(F.col("d").cast("double")), *[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
        trace = stats[0] / float(n) ** 3
        error = max(abs(c - (i == j)) for c, (i, j) in zip(stats[1:], pairs, strict=True))
        explained = F.element_at(F.lit([float(v / trace) for v in value]), F.col("at") + 1)
        return done.select("_id", F.col("d").try_cast("long").alias("deviation"), F.posexplode("w").alias("at", "whitened")).select(
            "_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            explained.alias("explained"), F.lit(float(error)).alias("identity_error"),
        )

    return by_length(base, "_v", fitted, SCHEMA).withColumnRenamed("_id", id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
