"""Vector code compression: a codebook per part of the vector, searched by kd-trees.

Each round broadcasts one kd-tree per part (at most 64 entries, so of bounded size). A part walks
its tree by branch and bound: a node is visited where the distance to its box does not exceed the
best so far, equal bounds too, so that an entry of lower index that is just as near is found.
Tasks add up whole numbers by entry, Spark sums those, and the driver sees one row an entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import join_split, table
from marlstone.llm.vectors import by_length, scaled, usable
from marlstone.operators.stages import settled

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this, as whole numbers, count as this; squared distances then fit in 64 bits.
MOST = 1 << 26
#: Entries of a leaf.
LEAF = 8


class Tree:
    """kd-tree over whole-number entries; boxes are tight around the entries below."""

    def __init__(self, entries: np.ndarray, members: np.ndarray | None = None):
        members = np.arange(len(entries)) if members is None else members
        points = entries[members]
        self.low, self.high, self.below = points.min(0), points.max(0), ()
        if len(members) > LEAF and len(points[0]) and (self.low < self.high).any():
            axis = int((self.high - self.low).argmax())
            by = members[np.argsort(points[:, axis], kind="stable")]
            self.below = (Tree(entries, by[: len(by) // 2]), Tree(entries, by[len(by) // 2 :]))
        else:
            self.members = np.sort(members)
            self.points = entries[self.members]

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to the box."""
        out = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (out * out).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equal ones, and its squared distance."""
        index, best = np.full(len(x), len(x) + ENTRIES), np.full(len(x), np.iinfo(np.int64).max)
        self._visit(x, np.arange(len(x)), index, best)
        return index, best

    def _visit(self, x: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        if not self.below:
            mine = x[rows]
            near = np.stack([((mine - p) ** 2).sum(1) for p in self.points], 1)
            at = near.argmin(1)
            near, at = near[np.arange(len(rows)), at], self.members[at]
            better = (near < best[rows]) | ((near == best[rows]) & (at < index[rows]))
            index[rows[better]], best[rows[better]] = at[better], near[better]
            return
        left, right = (child.bound(x[rows]) for child in self.below)
        first = left <= right
        for child, own, bound in ((0, first, left), (1, ~first, right), (1, first, right), (0, ~first, left)):
            mine = rows[own]
            self.below[child]._visit(x, mine[bound[own] <= best[mine]], index, best)


def _parts(column: pa.Array) -> np.ndarray:
    """rows x parts x width whole numbers; lengths are filled up by zeros to a multiple of the parts."""
    x = scaled(column, SCALE, MOST)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS))).reshape(len(x), PARTS, -1)


def _fit(rows: DataFrame) -> list[np.ndarray]:
    """Codebook of each part, from rows ``_id``, ``_v`` of one length."""
    context = rows.sparkSession.sparkContext
    firsts = rows.select("_id", "_v").orderBy(F.col("_id").asc_nulls_last(), "_v").limit(ENTRIES).toArrow()
    start = _parts(firsts.column("_v").combine_chunks())
    books, width = [start[:, p].copy() for p in range(PARTS)], start.shape[2]
    for _ in range(ROUNDS):
        trees = context.broadcast([Tree(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
            for batch in batches:
                x = _parts(batch.column(0))
                for p, tree in enumerate(trees.value):
                    at, _ = tree.nearest(x[:, p])
                    count[p] += np.bincount(at, minlength=ENTRIES)
                    np.add.at(total[p], at, x[:, p])
            p, e = np.nonzero(count)
            added = pa.array(list(total[p, e]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), added], ["part", "entry", "n", "s"])

        exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(width)]
        got = rows.select("_v").mapInArrow(sums, "part int, entry int, n long, s array<long>").groupBy("part", "entry").agg(F.sum("n"), *exact)
        for part, entry, n, *total in got.collect():
            books[part][entry] = [int(t) // n for t in total]
        trees.unpersist()
    return books


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Codes of the usable rows of ``vectors``, and by length of vector the codebook of each part.

    Codes are rows of id (long), ``code`` (one byte a part as two hex digits), ``error`` (squared
    distance to the entries), ``label_error`` (its sum over the label) and ``length``.

    Rows whose vector is null or holds null or non-finite numbers are dropped. A codebook starts as
    the parts of the 64 rows of smallest id, nulls last, rows of one id in the order of their
    vectors; of fewer rows it has fewer entries. Repeated rows are rows like others. Vectors of each
    length have codebooks of their own, and zeros fill up a length that 16 does not divide; an empty
    vector has zeros as its code and no error. Components beyond 2**18 either way count as that.
    Rows without a label are one group; ``label_error`` is null where it exceeds 64 bits. An empty
    table gives no rows and no codebooks; other columns are ignored, whatever their names."""
    label = F.col(label_col).cast("string")
    base = usable(vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v"), label.alias("_label")), "_v")
    schema, books = "_id long, _label string, code string, error long", {}

    def coded(rows: DataFrame, length: int) -> DataFrame:
        books[length] = _fit(rows)
        trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books[length]])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, code, error = _parts(batch.column("_v")), np.empty((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
                for p, tree in enumerate(trees.value):
                    code[:, p], near = tree.nearest(x[:, p])
                    error += near
                made = [pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), *made], ["_id", "_label", "code", "error"])

        return rows.mapInArrow(encode, schema).withColumn("length", F.lit(length))

    rows = settled(by_length(base, "_v", coded, f"{schema}, length int"))
    keyed = rows.withColumns({"_none": F.col("_label").isNull(), "_label": F.coalesce("_label", F.lit(""))})
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    labels = settled(keyed.groupBy("_none", "_label").agg(total, F.count("*").alias("_w")))
    out = join_split(keyed, labels, ["_none", "_label"], "_w")
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", "length"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in order, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for book in books for c in book.reshape(-1)).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    value = F.lit(None).cast("string")
    for length, book in books.items():
        value = F.when(F.col("length") == length, digest(book)).otherwise(value)
    return codes.select("vec_id", "code", "error", "label_error", value.alias("codebooks_sha256"))


def _sql_round(book: str, name: str) -> str:
    """Assignment of every part to the entries of ``book``, and the entries that follow from it."""
    return f"""
{name}_a AS (
  SELECT v.vec_id, v.p, min(list_sum(list_transform(list_zip(v.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.k) AS best
  FROM parts v JOIN {book} b USING (p) GROUP BY v.vec_id, v.p),
{name}_s AS (
  SELECT p, best % 64 AS k, i, floor(sum(x) / count(*))::BIGINT AS x FROM (
    SELECT a.p, a.best, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM {name}_a a JOIN parts v USING (vec_id, p)) GROUP BY ALL),
{name} AS (
  SELECT b.p, b.k, coalesce(n.e, b.e) AS e
  FROM {book} b LEFT JOIN (SELECT p, k, list(x ORDER BY i) AS e FROM {name}_s GROUP BY p, k) n USING (p, k))"""


ORACLE = {
    "op11_vector_codes": f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, p, list_slice(e, p * (len(e) // 16) + 1, (p + 1) * (len(e) // 16)) AS e FROM v, range(16) r(p)),
b0 AS (
  SELECT p, k, parts.e FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v) f JOIN parts USING (vec_id) WHERE k < 64),
{_sql_round("b0", "b1")},
{_sql_round("b1", "b2")},
{_sql_round("b2", "b3")},
c AS (
  SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM b3_a GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN v USING (vec_id), h"""
}
