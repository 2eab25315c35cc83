"""MinHash near-dedup by an inverted join over signature coordinates.

Documents with the same shingles are one row from the start. Each of the others is posted under
its coordinate-value pairs. To agree in at least ``least`` of K coordinates, two documents must
share one of their K - least + 1 rarest pairs (prefix filter), so only those are merged and the
long common lists are skipped; a pair of documents is retained when their signatures agree often
enough. Retained pairs join documents into clusters, and inside a cluster links are confirmed on
full shingle sets. In long lists and large clusters, blocks meet a few pivots first."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import connected_components, join_split, table
from marlstone.operators.stages import settled
from marlstone.llm.words import shingle_set

COORDINATES = 64
#: Agreeing coordinates of a retained pair: at a similarity of 0.8 fewer agree for 4.2 pairs in a million.
LEAST = 36
#: Rows of a block of a posting list or cluster, and shingles of a block of a cluster.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 300_000
#: Members of a large group that all others of it are compared with first.
PIVOTS = 4
#: (nodes, payloads, bounds of blocks) -> edges
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]

_seeded = np.random.Generator(np.random.PCG64(7))
_A = _seeded.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _seeded.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of the set under each of COORDINATES hash functions."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        for k in range(COORDINATES):
            low = ((part * _A[k] + _B[k]) >> np.uint64(32)).min()
            out[k] = min(out[k], low)
    return out


def digest(shingles: np.ndarray) -> bytes:
    """128 bits of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``_id``, ``n_shingles``, ``_set`` (digest of the set, null where it is empty), ``_sig``."""
    schema = T.StructType(
        [T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()),
         T.StructField("_set", T.BinaryType()), T.StructField("_sig", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                s = shingle_set(text.as_py() or b"", width)
                n.append(len(s))
                key.append(digest(s) if len(s) else None)
                sig.append(signature(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))],
                ["_id", "n_shingles", "_set", "_sig"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of sorted rows with the bounds of the runs that agree in the first ``keys``
    columns; a run that a batch breaks off is carried into the next."""

    def column(c: pa.Array) -> np.ndarray:
        if pa.types.is_list(c.type):
            return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        return np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)

    held: list[np.ndarray] | None = None
    for batch in batches:
        if batch.num_rows:
            cols = [column(c) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
            bounds = np.concatenate(([0], np.flatnonzero(new) + 1))
            held = [c[bounds[-1] :] for c in cols]
            if len(bounds) > 1:
                yield cols, bounds
    if held is not None:
        yield held, np.array([0, len(held[0])])


def roots(linked: np.ndarray) -> np.ndarray:
    """Index of the first member of each row's component of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(1, initial=n)
        nxt = np.minimum(label, low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def _edges(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id that is not the smallest of its component in the block, with that smallest id."""
    order = np.argsort(ids, kind="stable")
    label = roots(linked[np.ix_(order, order)])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return ids[order[moved]], ids[order[label[moved]]]


def _batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in found]).astype(np.int64) if found else np.empty(0, np.int64) for k in (0, 1))
    pairs = np.unique(np.stack((a, b), 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def compared(dealt: DataFrame, compare: Compare) -> DataFrame:
    """Edges (a, b) that ``compare`` finds inside each (``group``, ``block``, ``facing``)."""
    keys = ["group", "block", "facing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, ids, payload), bounds in runs(batches, 3):
            yield _batch(compare(ids, payload, bounds))

    rows = dealt.select(*keys, "node", "payload").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a long, b long")


def block_components(rows: DataFrame, load: Callable[[DataFrame], DataFrame], compare: Compare, keep_payload: bool = False) -> DataFrame:
    """Components (``node``, ``component``) of the links between nodes of a group which :func:`compare` links, in linear work where
    the nodes of a large group are mostly linked.

    ``rows`` (a stage table) has ``group``, ``blocks`` (how many blocks the group is cut into),
    ``node`` and what ``load`` needs to add a ``payload``. First the nodes of a block meet each
    other and a few pivots of their group, which go to all of its blocks. Nodes that are then
    in the largest class of their group need no comparison among themselves; only the others
    are compared with everything, block against block, so no link is lost. With
    ``keep_payload``, payloads are written when first loaded and not loaded again for that."""
    keep = [c for c in rows.columns if c not in ("group", "blocks")]
    big = rows.filter("blocks > 1")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    pivots = big.groupBy("group", "blocks", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(PIVOTS)).alias("i")).agg(
        F.min(F.struct(F.xxhash64("node", F.lit(1)).alias("lot"), *keep)).alias("p")
    )
    here = rows.select("group", own.alias("block"), F.lit(0).alias("facing"), F.lit(False).alias("guest"), *keep)
    guests = pivots.select("group", every("blocks").alias("block"), F.lit(0).alias("facing"), F.lit(True).alias("guest"), *[F.col("p")[c].alias(c) for c in keep])
    loaded = load(here.union(guests))
    if keep_payload:
        loaded = settled(loaded)
    edges = settled(compared(loaded, compare))
    labels = connected_components(edges)
    if big.isEmpty():
        return labels
    label = F.coalesce("component", "node").alias("label")
    placed = settled(big.join(labels, "node", "left").select("group", "blocks", *keep, label))
    classes = placed.groupBy("group", "label").count()
    main = settled(
        classes.groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
        .filter("n > most").withColumn("parts", F.ceil((F.col("n") - F.col("most")) / BLOCK_ROWS))
    )
    if main.isEmpty():
        return labels
    todo = join_split(placed, main, ["group"], "n")
    loose = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")
    facing = todo.select("group", own.alias("block"), every("parts").alias("facing"), *keep).union(
        todo.filter("label <> main").select("group", every("blocks").alias("block"), loose.alias("facing"), *keep)
    )
    payloads = loaded.filter("NOT guest").select("node", "payload")
    found = compared(facing.join(payloads, "node") if keep_payload else load(facing.withColumn("guest", F.lit(False))), compare)
    return connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))


def candidate_clusters(sigs: DataFrame, least: int) -> DataFrame:
    """Components of nodes whose signatures agree in at least ``least`` coordinates;
    ``sigs`` has long ``node`` and ``_sig``, one row for each set."""
    posts = sigs.select("node", F.posexplode("_sig").alias("_i", "_v")).select(
        "node", (F.col("_i").cast("long") * F.lit(1 << 32) + F.col("_v")).alias("_post")
    )
    shared = posts.groupBy("_post").agg(F.count("*").alias("_df")).filter("_df > 1")
    prefix = settled(
        posts.join(shared, "_post")
        .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_df", "_post"))).alias("_list"))
        # what is not shared comes first among the rarest
        .withColumn("_take", F.lit(1 - least) + F.size("_list"))
        .filter("_take > 0")
        .select("node", F.explode(F.expr("slice(_list, 1, _take)")).alias("_l"))
        .select("node", F.col("_l._post").alias("group"))
    )
    lists = settled(prefix.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = settled(join_split(prefix, lists, ["group"], "n").select("group", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"), "node"))

    def compare(ids: np.ndarray, sig: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 2:
                agree = np.zeros((b - a, b - a), np.int16)
                for c in range(COORDINATES):
                    agree += sig[a:b, c, None] == sig[None, a:b, c]
                found.append(_edges(ids[a:b], agree >= least))
        two = bounds[:-1][np.diff(bounds) == 2]
        if len(two):
            two = two[(sig[two] == sig[two + 1]).sum(1) >= least]
            found.append((np.maximum(ids[two], ids[two + 1]), np.minimum(ids[two], ids[two + 1])))
        return found

    return block_components(rows, lambda dealt: dealt.join(sigs.select("node", F.col("_sig").alias("payload")), "node"), compare)


def linked_in_blocks(sets: list[np.ndarray], percent: int, chunk: int = 4096) -> np.ndarray:
    """Which pairs of sets meet 100 * intersection >= percent * union, by products of 0/1
    matrices over the shingles that at least two of the sets share."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))
    col = np.cumsum(first) - 1
    many = np.bincount(col) > 1
    keep = many[col]
    row, col = row[keep], (np.cumsum(many) - 1)[col[keep]]
    inter = np.zeros((n, n), np.float32)
    bounds = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + chunk, chunk))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            part = np.zeros((n, chunk), np.float32)
            part[row[a:b], col[a:b] % chunk] = 1
            inter += part @ part.T
    inter = np.rint(inter).astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    return (100 * inter >= percent * union) & (inter > 0)


def confirmed_components(docs: DataFrame, clusters: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Components of nodes whose full sets meet the threshold, within clusters (``node``,
    ``component``, ``n_shingles``, ``_set`` and ``_rep``, the id of a document with that set)."""
    sizes = settled(clusters.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("_s")))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("_s") / BLOCK_SHINGLES))
    members = settled(
        join_split(clusters, sizes, ["component"], "n")
        .select(F.col("component").alias("group"), F.least(blocks, F.col("n")).alias("blocks"), "node", "_set", "_rep")
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py() or b"", width) for t in batch.column("_text").cast(pa.large_binary())]
            # other texts of the same id belong to other nodes
            own = pa.array([len(s) > 0 and digest(s) == k for s, k in zip(found, batch.column("_set").to_pylist(), strict=True)], pa.bool_())
            payload = pa.array([s.tobytes() for s in found], pa.binary())
            cols = [*batch.columns[:5], payload]
            yield pa.RecordBatch.from_arrays(cols, ["group", "block", "facing", "guest", "node", "payload"]).filter(own)

    def load(dealt: DataFrame) -> DataFrame:
        # members grow with the input, so this is a sort-merge join at every size
        texts = docs.select(F.col(id_col).alias("_rep"), F.col(text_col).alias("_text")).join(dealt.hint("merge"), "_rep")
        rows = texts.select("group", "block", "facing", "guest", "node", "_set", "_text")
        return rows.mapInArrow(sets, "group long, block int, facing int, guest boolean, node long, payload binary")

    def compare(ids: np.ndarray, shingles: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                sets = [np.frombuffer(x, np.uint64) for x in shingles[a:b]]
                found.append(_edges(ids[a:b], linked_in_blocks(sets, percent)))
        return found

    return block_components(members, load, compare, keep_payload=True)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, least: int = LEAST
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    A document's set holds its distinct shingles of ``width`` words (ASCII letters lower-cased);
    all its words are one shingle where there are fewer. Two documents are linked when
    100 * intersection >= ``percent`` * union. Texts that are null, empty or blank have an empty
    set and are linked with nothing. The smallest id reachable by links names the component and
    stays. Rows that repeat an id are that document, by the shingles of each of their texts. Rows
    without an id are linked with nothing and have neither component nor decision. Whole texts
    count, however long; an empty table gives no rows; other columns are ignored. Ids are of any
    orderable type, a struct of columns too.

    Distinct sets, numbered, are what is posted, compared and confirmed; links between them are
    links between their smallest ids, to which come those between texts of one id."""
    sk = settled(sketches(docs, id_col, text_col, width))
    held = sk.filter("_set IS NOT NULL AND _id IS NOT NULL")
    reps = settled(
        held.groupBy("_set").agg(
            F.min("_id").alias("_rep"), F.any_value("_sig").alias("_sig"), F.any_value("n_shingles").alias("n_shingles"), F.count("*").alias("_copies")
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    clusters = candidate_clusters(reps.select("node", "_sig"), least)
    clusters = settled(clusters.join(reps.drop("_sig", "_copies"), "node"))
    found = confirmed_components(docs, clusters, id_col, text_col, width, percent)
    many = held.groupBy("_id").agg(F.min("_set").alias("_x"), F.max("_set").alias("_y")).filter("_x <> _y").select("_id")
    own = settled(held.join(many, "_id", "left_semi").select("_id", "_set").distinct().join(reps.select("_set", "_rep"), "_set"))
    if own.isEmpty():
        # a component's smallest id, looked up by its own number
        named = found.join(reps.select("node", "_set", "_rep"), "node")
        least = settled(named.groupBy("component").agg(F.min("_rep").alias("component_id"), F.count("*").alias("n")))
        classes = join_split(named.select("component", "_set"), least, ["component"], "n").select("_set", "component_id")
    else:
        number = lambda end: reps.select(F.col("node").alias(end), F.col("_rep").alias(f"_{end}"))
        links = found.join(number("node"), "node").join(number("component"), "component").select(F.col("_node").alias("a"), F.col("_component").alias("b"))
        parts = connected_components(links.union(own.select(F.col("_id").alias("a"), F.col("_rep").alias("b"))))
        classes = reps.select("_set", F.col("_rep").alias("node")).join(parts, "node").select("_set", F.col("component").alias("component_id"))
    classes = settled(
        reps.select("_set", "_rep", "_copies").join(classes, "_set", "left").select("_set", "_copies", F.coalesce("component_id", "_rep").alias("component_id"))
    )
    # all copies of a text meet one row, so sets of many copies are joined by broadcast; the empty set is not joined
    linked = join_split(held.select("_id", "n_shingles", "_set"), classes, ["_set"], "_copies").select("_id", "n_shingles", "component_id")
    alone = sk.filter("_set IS NULL OR _id IS NULL").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    out = linked.unionByName(alone).withColumnRenamed("_id", id_col)
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=4, percent=80)
