"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells.

A vector is compared with the home members of every cell in which a linked vector could live:
if y's home is cell b and x's home is cell a, then y is nearer to centre b, so with
|x - y| <= sqrt(2 - 2 * cosine) the margin x.(c_a - c_b) is at most sqrt(2 - 2 * cosine) |c_a - c_b|.
Thus no link is lost, whatever the centres. A pair of cells is compared once: vectors visit cells
with a number not below their own. Copies of a vector are one row from the start; a cell is cut
into blocks of bounded size, so one crowded cell is many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import connected_components, table
from marlstone.operators.stages import settled
from marlstone.llm.minhash import runs
from marlstone.llm.words import mixed

#: The centres are fitted on at most about so many vectors, and so many numbers.
TRAIN_VECTORS = 20_000
TRAIN_NUMBERS = 2_000_000
ROUNDS = 8
#: Home members and compared vectors of one task.
HOME_ROWS = 4096
OTHER_ROWS = 16384
#: Single precision decides products further than this from the threshold, double the others.
SAFE = 1e-4


def unit(packed: list[bytes], width: int) -> np.ndarray:
    """Unit vectors in double precision from packed numbers of ``width`` bytes."""
    x = np.frombuffer(b"".join(packed), f"<f{width}").reshape(len(packed), -1).astype("<f8")
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centres; seeded, ties to the first centre, empty cells keep their centre."""
    rng = np.random.default_rng(3)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        home = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centres)
    return centres


class Cells:
    def __init__(self, centres: np.ndarray, cosine: float):
        self.centres, self.step = centres, np.sqrt(max(0.0, 2 - 2 * cosine))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each row, and row x cell whether it is to be compared with the cell's
        home members: a linked vector may live there, and the cell is not below the home."""
        near = x @ self.centres.T
        home = near.argmax(1)
        visits = np.empty(near.shape, bool)
        square = (self.centres**2).sum(1)
        for at in range(0, len(x), 1024):
            part = slice(at, at + 1024)
            mine = home[part]
            # distances of centres from the gram matrix, for the homes at hand alone
            apart = np.sqrt(np.maximum(0, square[mine, None] + square[None, :] - 2 * self.centres[mine] @ self.centres.T))
            visits[part] = near[part][np.arange(len(mine)), mine][:, None] - near[part] <= self.step * apart + 1e-6
        return home, visits & (np.arange(near.shape[1])[None, :] >= home[:, None])


def _pairs(home: np.ndarray, other: np.ndarray, home_ids, other_ids, cosine: float) -> np.ndarray:
    """other x home matrix of links, without a row's link to itself."""
    h32, o32 = home.astype(np.float32), other.astype(np.float32)
    out = np.empty((len(other), len(home)), bool)
    for a in range(0, len(other), 512):
        dot = o32[a : a + 512] @ h32.T
        out[a : a + 512] = dot >= cosine
        i, j = np.nonzero(np.abs(dot - np.float32(cosine)) < SAFE)
        out[a + i, j] = np.einsum("ij,ij->i", other[a + i], home[j]) >= cosine
    same = np.searchsorted(home_ids, other_ids)
    same[same == len(home_ids)] = 0
    hit = np.flatnonzero(home_ids[same] == other_ids)
    out[hit, same[hit]] = False
    return out


def _local_edges(linked: np.ndarray, home_ids: np.ndarray, other_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of a two-sided block with the smallest id that its links reach inside the block."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    part, far = linked[np.ix_(rows, cols)], np.iinfo(np.int64).max
    o, h = other_ids[rows].copy(), home_ids[cols].copy()
    while True:
        before = (o.copy(), h.copy())
        for a in range(0, len(rows), 256):
            o[a : a + 256] = np.minimum(o[a : a + 256], np.where(part[a : a + 256], h[None, :], far).min(1))
        for a in range(0, len(rows), 256):
            h = np.minimum(h, np.where(part[a : a + 256], o[a : a + 256, None], far).min(0))
        if (o == before[0]).all() and (h == before[1]).all():
            break
    ids, low = np.concatenate((other_ids[rows], home_ids[cols])), np.concatenate((o, h))
    return ids[ids != low], low[ids != low]


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: id (long), ``n_links``, ``component_id``, ``kept``.

    Rows are linked when their cosine in double precision is at least ``cosine`` (above 0).
    Vectors that are null, empty, zero or hold a null, NaN or infinite number are linked with
    nothing; vectors of different lengths are not linked. Equal vectors are linked and count one
    by one in ``n_links``. The smallest id reachable by links names the component and stays: all rows
    with it, where an id repeats. Rows that share an id are linked by their own vectors alone. A
    null id counts in ``n_links`` of others, names no component and is never kept; its component is
    null where no other id is reachable. An empty table gives no rows; other columns are ignored.

    The number of cells grows with the square root of the number of vectors. Their centres are
    fitted on a bounded sample and do not change results. Numbers travel as they are stored, in
    four bytes where the column holds floats."""
    width = 4 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else 8

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(f"<f{width}")
                    x = (x + x.dtype.type(0)).tobytes() if np.isfinite(x).all() and x.any() else None
                got.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["_id", "_v"])

    base = vectors.select(F.col(id_col).cast("long").alias("_id"), vec_col).mapInArrow(clean, "_id long, _v binary")
    reps = settled(
        base.filter("_v IS NOT NULL").groupBy("_v").agg(F.min("_id").alias("_low"), F.count("*").alias("_mult"))
        .withColumns({"_d": (F.length("_v") / width).cast("int"), "_rep": F.monotonically_increasing_id()})
    )  # distinct vectors have numbers of their own from here on, whatever their ids
    models = {}
    for d, n in sorted(tuple(r) for r in reps.groupBy("_d").count().collect()):
        share = min(1.0, min(TRAIN_VECTORS, max(1000, TRAIN_NUMBERS // d)) / n)
        at = F.shiftrightunsigned(F.xxhash64("_v"), 11) / float(1 << 53)
        sample = reps.filter((F.col("_d") == d) & (at <= share)).select("_v").toArrow().sort_by("_v")
        x = unit(sample.column("_v").to_pylist(), width) if sample.num_rows else np.eye(1, d)
        models[d] = Cells(spherical_kmeans(x, int(np.ceil(np.sqrt(n) / 16))), cosine)

    def assigned(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(length, rows of that length, home cells, cells to be compared with)."""
        dims = batch.column("_d").to_numpy()
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            home, near = models[d].assign(unit(batch.column("_v").take(pa.array(rows)).to_pylist(), width))
            yield d, rows, home, near

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, home, near in assigned(batch):
                k = near.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, d, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.bincount(home, minlength=k)), pa.array(near.sum(0))],
                    ["d", "cell", "homes", "others"],
                )

    sizes = (
        reps.select("_v", "_d").mapInArrow(count, "d int, cell int, homes long, others long")
        .groupBy("d", "cell").agg(F.sum("homes"), F.sum("others")).collect()
    )
    blocks = {(r[0], r[1]): (-(-r[2] // HOME_ROWS) or 1, -(-r[3] // OTHER_ROWS) or 1) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_rep").to_numpy()
            lot = mixed(ids.astype(np.uint64))
            for d, rows, home, near in assigned(batch):
                for cell in range(near.shape[1]):
                    n_home, n_other = blocks.get((d, cell), (1, 1))
                    here, visits = home == cell, near[:, cell]
                    for role, members, own, parts in (
                        (0, rows[visits & ~here], n_other, n_home), (1, rows[visits & here], n_other, n_home), (2, rows[here], n_home, n_other),
                    ):
                        block = (lot[members] % np.uint64(own)).astype(np.int32)
                        at = np.repeat(members, parts)
                        mine, facing = np.repeat(block, parts), np.tile(np.arange(parts, dtype=np.int32), len(members))
                        for a in range(0, len(at), 4096):
                            cut = slice(a, a + 4096)
                            take, n = pa.array(at[cut]), len(at[cut])
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(n, (int(d) << 32) + cell)), pa.array((mine if role == 2 else facing)[cut]),
                                    pa.array((facing if role == 2 else mine)[cut]), pa.array(np.full(n, role, np.int32)),
                                    batch.column("_rep").take(take), batch.column("_mult").take(take), batch.column("_v").take(take),
                                ],
                                ["cell", "hb", "ob", "role", "id", "mult", "v"],
                            )

    dealt = (
        reps.select("_rep", "_mult", "_v", "_d")
        .mapInArrow(deal, "cell long, hb int, ob int, role int, id long, mult long, v binary")
        .repartition("cell", "hb", "ob").sortWithinPartitions("cell", "hb", "ob", "role", "id")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of home members (role 2), and of visitors from other cells (role 0); those of
        visitors that live in the cell (role 1) are met from the other side."""
        for (_, _, _, role, ids, mult, v), bounds in runs(batches, 3):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                cut, foreign = a + int((role[a:b] < 2).sum()), int((role[a:b] == 0).sum())
                if a < cut < b:
                    x = unit(list(v[a:b]), width)
                    linked = _pairs(x[cut - a :], x[: cut - a], ids[cut:b], ids[a:cut], cosine)
                    o, h = np.nonzero(linked)
                    home_links = np.bincount(h, mult[a:cut][o], b - cut).astype(np.int64)
                    links = np.bincount(o, mult[cut:b][h], cut - a)[:foreign].astype(np.int64)
                    at, to = np.flatnonzero(links), np.flatnonzero(home_links)
                    hi, lo = _local_edges(linked, ids[cut:b], ids[a:cut])
                    names = np.concatenate((ids[a:cut][at], ids[cut:b][to], hi))
                    counts = np.concatenate((links[at], home_links[to], np.zeros(len(hi), np.int64)))
                    ends = np.concatenate((ids[a:cut][at], ids[cut:b][to], lo))
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts), pa.array(ends)], ["a", "n", "b"])

    found = settled(dealt.mapInArrow(compare, "a long, n long, b long"))
    degree = found.groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_n"))
    parts = connected_components(found.select("a", "b")).withColumnRenamed("node", "_rep")
    lowest = reps.select("_rep", "_low").join(parts, "_rep").groupBy("component").agg(F.min("_low").alias("_least"))
    named = parts.join(lowest, "component").select("_rep", "_least")
    classes = reps.select("_v", "_rep", "_low", "_mult").join(degree, "_rep", "left").join(named, "_rep", "left").select(
        "_v", (F.coalesce("_n", F.lit(0)) + F.col("_mult") - 1).alias("n_links"), F.coalesce("_least", "_low").alias("component_id")
    )
    return base.join(classes, "_v", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component_id", "_id"), F.lit(False)).alias("kept"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id"""
}
