"""Packing: bounded-space online packing of token streams into windows.

Each task keeps a fixed number of open windows, places a document's rest where it fits best
and, when it fits nowhere, tops up the fullest window and emits it. What is open at the end
of a task is merged with that of a fixed number of other tasks."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import PRETOKEN, PieceCodec, default_vocabulary, pack, token_bytes
from marlstone.llm.common import table
from marlstone.operators.stages import settled

END_ID = 1
WINDOW = 2048
OPEN_WINDOWS = 16
#: A gap below this is padded rather than filled with a shred of a document.
LEAST_CUT = 16
#: Tasks whose open windows are merged together: a fixed number, so a merge stays small.
MERGED_TASKS = 16
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FastCodec(PieceCodec):
    """The ids of a byte-level BPE file by a compiled encoder of the same merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        plain = {b: i for i, b in token_bytes(spec).items() if i not in set(self.added.values())}
        self.encoding = tiktoken.Encoding("file", pat_str=PRETOKEN.pattern, mergeable_ranks=plain, special_tokens={})

    def split(self, text: str) -> bytes:
        return pack(self.encoding.encode_ordinary(text))


_loaded: dict[str, FastCodec] = {}


def codec(path: str) -> FastCodec:
    if path not in _loaded:
        _loaded[path] = FastCodec(path)
    return _loaded[path]


class Window:
    """Pieces (document, start, packed ids, document's tokens) of a sequence in the making."""

    def __init__(self):
        self.used, self.pieces = 0, []

    def add(self, doc, start: int, ids: bytes, of: int) -> None:
        self.pieces.append((doc, start, ids, of))
        self.used += len(ids) // 4

    def rows(self, sequence: int | None, with_ids: bool) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, of in self.pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), of, sequence, offset, ids if with_ids else None
            offset += len(ids) // 4


def place(open_windows: list[Window], doc, start: int, ids: bytes, of: int, window: int, most: int) -> Iterator[Window]:
    """Put a piece shorter than a window into the open windows; yields windows that are done."""
    while ids:
        n = len(ids) // 4
        fitting = [w for w in open_windows if window - w.used >= n]
        if fitting:
            best = max(fitting, key=lambda w: w.used)
            best.add(doc, start, ids, of)
            if best.used == window:
                open_windows.remove(best)
                yield best
            return
        if len(open_windows) < most:
            open_windows.append(Window())
            continue
        fullest = max(open_windows, key=lambda w: w.used)
        gap = window - fullest.used
        if gap >= LEAST_CUT:
            fullest.add(doc, start, ids[: 4 * gap], of)
            start, ids = start + gap, ids[4 * gap :]
        open_windows.remove(fullest)
        yield fullest


def merged(pieces: list[tuple], window: int) -> Iterator[Window]:
    """Pieces one after another into full windows; the tail becomes windows of powers of two,
    which need no padding."""
    left = sum(len(p[2]) for p in pieces) // 4
    size = min(window, left)
    cur = Window()

    def target() -> int:
        return window if left >= window else 1 << (left.bit_length() - 1)

    if not left:
        return
    size = target()
    for doc, start, ids, of in pieces:
        while ids:
            take = min(size - cur.used, len(ids) // 4)
            cur.add(doc, start, ids[: 4 * take], of)
            start, ids = start + take, ids[4 * take :]
            if cur.used == size:
                yield cur
                left -= size
                cur = Window()
                if left:
                    size = target()


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, on demand, ``ids`` (little-endian unsigned 32-bit).

    A document is its ids followed by id 1; every id lies in exactly one piece. Full windows
    are cut from a long document at once; the rest is placed best-fit among ``open_windows``
    windows. One map over the documents, written once to the shared folder, since both its
    finished and its open windows are read; only open windows (at most ``open_windows`` a
    task) are shuffled, in groups of ``MERGED_TASKS`` tasks.

    Null text counts as empty: such a document is one piece of one token. Rows that repeat an
    id, and rows without one, are packed as documents of their own. An empty table gives no
    rows; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {PIECE}, ids binary, task int"
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    end = pack([END_ID])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, bpe, held, rows, count = TaskContext.get(), codec(path), [], [], 0
        task, id_type = ctx.partitionId() if ctx else 0, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [id_type, *[pa.int64()] * 6, pa.binary()]
            out = [pa.array(c, t) for c, t in zip(cols, types, strict=True)] + [pa.array([task] * len(rows), pa.int32())]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, [*names, "task"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py()) + end
                n, start, done = len(ids) // 4, 0, []
                while n - start >= window:
                    full = Window()
                    full.add(doc, start, ids[4 * start : 4 * (start + window)], n)
                    done.append(full)
                    start += window
                done += place(held, doc, start, ids[4 * start :], n, window, open_windows)
                for w in done:
                    rows.extend(w.rows((task << 32) + count, with_ids))
                    count += 1
                if len(rows) >= 5000:
                    yield flush()
        for w in held:
            rows.extend(w.rows(None, True))
        if rows:
            yield flush()

    def merge(key: tuple, left: pa.Table) -> pa.Table:
        left = left.sort_by([("task", "ascending"), ("order", "ascending")])
        pieces = list(zip(*(left[c].to_pylist() for c in (id_col, "start", "ids", "doc_tokens")), strict=True))
        rows = [r for i, w in enumerate(merged(pieces, window)) for r in w.rows((1 << 62) + (key[0].as_py() << 32) + i, with_ids)]
        types = [left.schema.field(id_col).type, *[pa.int64()] * 6, pa.binary()]
        cols = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    first = settled(docs.select(id_col, text_col).mapInArrow(run, schema))
    finished = first.filter("sequence_id IS NOT NULL").drop("task")
    rest = (
        first.filter("sequence_id IS NULL")
        .withColumns({"group": F.floor(F.col("task") / MERGED_TASKS), "order": F.xxhash64(id_col, "start", "doc_tokens", "ids_crc32")})
        .groupBy("group").applyInArrow(merge, f"`{id_col}` {kind}, {PIECE}, ids binary")
    )
    out = finished.unionByName(rest)
    return out if with_ids else out.drop("ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())
