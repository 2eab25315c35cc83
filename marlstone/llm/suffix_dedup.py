"""Suffix-array dedup: bytes of 100-byte strings that also start earlier are removed.

Every suffix that starts a whole window of 100 bytes is dealt to the bucket of its window's anchor:
the place in the window whose 16 bytes have the least hash. Equal windows have one anchor at one
distance, so they meet; neighbouring windows mostly share an anchor and travel as one segment of
text. A first pass moves anchor hashes alone and finds those that occur twice; only their segments
are shuffled. Inside a bucket, :mod:`suffix_sort` sorts the suffixes (multikey quicksort to a
shallow depth, blind tries below), and of equal windows all but the first mark their bytes.

Hot keys: copies of a segment are folded inside each map task, copies of a whole text are found by
hash and take no part, and anchors that occur more than ``HOT`` times are not sorted in one task:
their distinct segments are cut into single windows, which are grouped by content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.common import join_split, table
from marlstone.llm.minhash import runs
from marlstone.llm.suffix_sort import WIDTH, sorted_windows
from marlstone.llm.words import mixed
from marlstone.operators.stages import drop_stage, settled

#: Bytes that are hashed to choose an anchor; places in a window where they may stand.
GRAM = 16
PLACES = WIDTH - GRAM + 1
#: Bytes hashed at a time; anchors of a piece are told apart by 22 bits of their place.
PIECE = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
#: Windows sorted at a time.
SORTED = 200_000
#: Occurrences beyond which an anchor's windows are grouped by content over many tasks.
HOT = 65_536


def _cut(pieces: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """Segments of texts (number, place of the first byte, bytes): text, start, windows, place of
    the anchor in the segment, hash."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    ends = np.cumsum([len(p[2]) for p in pieces])
    starts = ends - [len(p[2]) for p in pieces]
    words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8")[:, 0]
    h = mixed(words[:-8] + mixed(words[8:]))
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= PLACES:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(data) - WIDTH + 1
    low = np.minimum(low[:n], low[PLACES - span : PLACES - span + n])
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, ends - WIDTH + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    anchor = (low[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    piece = np.searchsorted(starts, at[first], "right") - 1
    number, base = np.array([p[0] for p in pieces])[piece], np.array([p[1] for p in pieces])[piece]
    return [number, base + at[first] - starts[piece], np.diff(np.append(first, len(at))), anchor[first] - at[first], h[anchor[first]].view(np.int64)]


def segments(texts: list[bytes]) -> list[np.ndarray]:
    """Arrays with the number of the text, the start, the number of windows, the place of the anchor
    and its hash, for the segments of ``texts``. Texts shorter than a window have none."""
    out, pieces, size = [np.empty((0, 5), np.int64)], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - WIDTH + 1, PIECE):
            pieces.append((i, at, text[at : at + PIECE + WIDTH - 1]))
            size += len(pieces[-1][2])
            if size >= PIECE:
                out.append(np.stack(_cut(pieces), 1))
                pieces, size = [], 0
    if pieces:
        out.append(np.stack(_cut(pieces), 1))
    return list(np.concatenate(out).T)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n, count): each hash of a batch once with its occurrences there, for the first text;
    with count 0 for the other texts that have it, since a repeat is certain there."""
    for batch in batches:
        ids = batch.column("n").to_numpy()
        number, _, _, _, h = segments(batch.column("text").to_pylist())
        if len(h):
            order = np.lexsort((ids[number], h))
            h, n = h[order], ids[number][order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            count = np.zeros(len(h), np.int64)
            count[new] = np.diff(np.append(np.flatnonzero(new), len(h)))
            keep = new | np.concatenate(([True], n[1:] != n[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(n[keep]), pa.array(count[keep])], ["h", "n", "c"])


def _spans(n, m, start, end, seg=None) -> pa.RecordBatch:
    seg = pa.nulls(len(n), pa.binary()) if seg is None else pa.array(seg, pa.binary())
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (n, m, start, end)], seg], ["n", "m", "start", "end", "seg"])


#: Rows of :func:`_emit`: a segment (``seg``) or a span to be removed (``h`` and ``seg`` null).
PARTS = "h long, seg binary, place int, n long, m long, start long, end long, hot boolean"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of candidate anchors, the first of equal ones in the batch; spans of the others
    and of whole texts that an earlier document has too."""
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
        texts = [zstandard.decompress(z) for z in batch.column("z").to_pylist()]
        copy = [int(m[i]) not in f for i, f in enumerate(batch.column("firsts").to_pylist())]
        number, start, count, place, h = segments([b"" if c else t for c, t in zip(copy, texts, strict=True)])
        spread = mixed(np.arange(len(n), dtype=np.uint64)).view(np.int64)

        def among(name: str) -> np.ndarray:
            lists = batch.column(name)  # a clash of these keys only lets a segment in that meets nothing
            return np.isin(h ^ spread[number], lists.flatten().to_numpy() ^ np.repeat(spread, lists.value_lengths().to_numpy()))

        mine, hot = np.flatnonzero(among("hashes")), among("often")
        mine = mine[np.lexsort((start[mine], m[number[mine]], n[number[mine]]))]
        seen, rows, spans = {}, [], []
        for k, i, a, b in zip(mine.tolist(), number[mine].tolist(), start[mine].tolist(), (start + count)[mine].tolist(), strict=True):
            at = (int(n[i]), int(m[i]), a, b + WIDTH - 1)
            seg = texts[i][a : at[3]]
            if seg not in seen:
                seen[seg] = at
                rows.append((h[k], seg, place[k], *at, hot[k]))
            elif seen[seg] != at:
                spans.append(at)
        spans += [(int(n[i]), int(m[i]), 0, len(texts[i])) for i, c in enumerate(copy) if c and len(texts[i]) >= WIDTH]
        rows += [(None, None, None, *s, False) for s in _joined(spans)]
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int64(), pa.binary(), pa.int32(), *[pa.int64()] * 4, pa.bool_()]
        names = ["h", "seg", "place", "n", "m", "start", "end", "hot"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _joined(spans: list[tuple]) -> list[tuple]:
    """Spans (n, m, start, end) with those of a text that touch made one."""
    out = []
    for n, m, a, b in sorted(spans):
        if out and out[-1][:2] == (n, m) and a <= out[-1][3]:
            out[-1] = (n, m, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((n, m, a, b))
    return out


def repeats(h: np.ndarray, segs: list[bytes], place: np.ndarray, order: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For distinct segments of whole buckets: arrays (segment, first, last window) of the windows
    that an earlier segment has too. ``order`` holds the keys of precedence: n, m, start."""
    n, m, start = order
    _, size = np.unique(h, return_counts=True)
    bucket = np.repeat(np.arange(len(size)), size)
    use = np.flatnonzero(size[bucket] > 1)
    if not len(use):
        return
    lens = np.array([len(segs[i]) for i in use])
    data = np.frombuffer(b"".join(segs[i] for i in use), np.uint8)
    count = lens - WIDTH + 1
    seg = np.repeat(use, count)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(lens) - lens, count) + off
    code = bucket[seg] * WIDTH + (place[seg] - off)  # windows of a bucket whose anchors stand alike
    by = np.argsort(code, kind="stable")
    seg, off, at, code = seg[by], off[by], at[by], code[by]
    edges = np.append(np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))), len(code))
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + SORTED, "right")) - 1)
        part = slice(edges[a], edges[b])
        s, o = seg[part], off[part]
        perm, equal = sorted_windows(data, at[part], code[part])
        s, o = s[perm], o[perm]
        label = np.cumsum(~equal)
        first = np.lexsort((start[s] + o, m[s], n[s], label))
        later = first[np.concatenate(([False], label[first][1:] == label[first][:-1]))]
        if len(later):
            yield s[later], o[later], o[later]
        a = b


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to be removed, from rows sorted by anchor, segment and place in the corpus; with ``seg``
    the first of each segment of a hot anchor, whose windows are still to be compared."""

    def spans_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.filter(pc.is_null(batch.column("h")))
            if spans.num_rows:
                ready.append(_spans(*[spans.column(c) for c in ("n", "m", "start", "end")]))
            yield batch.filter(pc.is_valid(batch.column("h")))

    ready: list[pa.RecordBatch] = []
    for (h, seg, place, n, m, start, end, hot), bounds in runs(spans_only(batches), 1):
        yield from ready
        ready.clear()
        new = np.ones(bounds[-1], bool)  # rows given twice stand side by side
        new[1:] = np.any([c[1 : bounds[-1]] != c[: bounds[-1] - 1] for c in (seg, n, m, start)], axis=0)
        h, seg, place, n, m, start, end, hot = (c[: bounds[-1]][new] for c in (h, seg, place, n, m, start, end, hot))
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (seg[1:] == seg[:-1])))
        if again.any():
            yield _spans(n[again], m[again], start[again], end[again])
        far = hot.astype(bool) & ~again
        if far.any():
            yield _spans(n[far], m[far], start[far], end[far], seg[far])
        near = ~(far | again)
        h, seg, place, n, m, start = (c[near] for c in (h, seg, place, n, m, start))
        low, high = np.full(len(h), 1 << 30), np.full(len(h), -1)
        for s, a, b in repeats(h, seg, place, (n, m, start)):
            np.minimum.at(low, s, a)
            np.maximum.at(high, s, b)
        hit = np.flatnonzero(high >= 0)
        yield _spans(n[hit], m[hit], start[hit] + low[hit], start[hit] + high[hit] + WIDTH)
    yield from ready


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of each segment as a row."""
    for batch in batches:
        for seg, n, m, start in zip(*[batch.column(c).to_pylist() for c in ("seg", "n", "m", "start")], strict=True):
            k = len(seg) - WIDTH + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([seg[i : i + WIDTH] for i in range(k)], pa.binary()), pa.array([n] * k, pa.int64()),
                    pa.array([m] * k, pa.int64()), pa.array(range(start, start + k), pa.int64()),
                ],
                ["window", "n", "m", "start"],
            )


def _hot_spans(segs: DataFrame) -> DataFrame:
    """Spans of the windows of distinct segments of hot anchors, without gathering a bucket: windows
    are grouped by content with partial aggregation."""
    windows = settled(segs.select("seg", "n", "m", "start").mapInArrow(_windows, "window binary, n long, m long, start long"))
    first = windows.groupBy("window").agg(F.min(F.struct("n", "m", "start")).alias("f"), F.count("*").alias("w"))
    rest = join_split(windows, settled(first.filter("w > 1")), ["window"], "w").filter(F.struct("n", "m", "start") != F.col("f"))
    return rest.select("n", "m", "start", (F.col("start") + WIDTH).alias("end"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for m, z, found in zip(*[batch.column(c).to_pylist() for c in ("m", "z", "found")], strict=True):
            text = zstandard.decompress(z)
            spans = [(a, b) for *_, a, b in _joined([(0, 0, f["start"], f["end"]) for f in found or () if f["m"] == m])]
            ends = [0, *[b for _, b in spans]]
            kept = b"".join(text[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(text)], strict=True))
            out.append((len(text), [{"start": a, "end": b} for a, b in spans], kept))
        cols = list(zip(*out, strict=True)) or [[]] * 3
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", "n_bytes", "spans", "kept"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = pa.array([squeeze.compress(t) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("m"), z], ["id", "n", "m", "z"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id (long), ``n_bytes``, ``spans`` (removed runs of bytes, from and up
    to, in order, never touching) and ``kept`` (the other bytes; they need not be whole characters).

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document with a
    smaller id, or further ahead in the same one. Null text is empty; texts under 100 bytes lose
    nothing. A null id counts as the largest long. Rows that share an id are parts of one document,
    in the order of a hash of their texts; rows equal in id and text are one part, and each gets its
    result. An empty table gives no rows; other columns are ignored, whatever their names.

    The result does not depend on ``hot``, beyond which occurrences of an anchor count as hot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("n"),
        F.xxhash64(text).alias("m"), text.alias("text"),
    )
    packed = rows.mapInArrow(_packed, "id long, n long, m long, z binary")
    # anchors that occur twice, by document; those of a batch's repeats go straight there
    deal = F.when(F.col("c") == 0, F.col("n")).otherwise(F.col("h"))
    light = rows.select("n", "text").mapInArrow(_anchors, "h long, n long, c long").withColumn("g", deal)
    total = F.sum("c").over(Window.partitionBy("g"))
    known = settled(light.withColumn("t", total).filter("c = 0 OR t > 1").select("h", "n", F.when(F.col("c") > 0, F.col("t")).alias("t")))
    firsts = (
        rows.select(F.md5("text").alias("t"), "n", "m").groupBy("t").agg(F.min(F.struct("n", "m")).alias("f"))
        .groupBy("f.n").agg(F.collect_list("f.m").alias("firsts"))
    )
    often = settled(known.filter(F.col("t") > hot).select("h").distinct())

    is_hot = not often.isEmpty()
    flagged = known.join(often.withColumn("hot", F.lit(True)), "h", "left") if is_hot else known.withColumn("hot", F.lit(False))
    side = flagged.groupBy("n").agg(F.collect_set("h").alias("hashes"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("often"))
    met = packed.join(side, "n", "left").join(firsts, "n", "left")
    # an id whose texts all stand earlier elsewhere has no row among the firsts
    lists = [F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("firsts", "hashes", "often")]
    parts = met.select("n", "m", "z", *lists).mapInArrow(_emit, PARTS)
    bucket = F.when(F.col("h").isNull(), F.xxhash64("n", "start")).when(F.col("hot"), F.xxhash64("seg")).otherwise(F.col("h"))
    dealt = parts.repartition(bucket).sortWithinPartitions("h", "seg", "n", "m", "start")
    spans = settled(dealt.mapInArrow(_resolve, "n long, m long, start long, end long, seg binary"))
    if is_hot:
        spans = spans.filter("seg IS NULL").drop("seg").unionByName(_hot_spans(spans.filter("seg IS NOT NULL")))
    drop_stage(known)
    found = spans.groupBy("n").agg(F.collect_set(F.struct("m", "start", "end")).alias("found"))
    done = packed.join(found, "n", "left").select("id", "m", "z", "found")
    out = done.mapInArrow(_finish, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
