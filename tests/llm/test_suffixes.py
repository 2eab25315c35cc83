"""Suffix-array dedup against brute force over all windows of 100 bytes."""

import hashlib
import random

import numpy as np
import pytest

from marlstone.llm.suffix_dedup import op13_suffix_dedup, segments, suffix_dedup
from marlstone.llm.suffix_sort import WIDTH, sorted_windows

DOCS = "doc_id long, text string, n string, m string, spans string, _text string"


def brute(rows):
    """(id, text) -> spans: windows in order of id and place, each that was seen before marks its bytes."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        b = (text or "").encode()
        marked = bytearray(len(b))
        for p in range(len(b) - WIDTH + 1):
            w = b[p : p + WIDTH]
            if w in seen:
                marked[p : p + WIDTH] = b"\1" * WIDTH
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(marked) + b"\0", np.uint8).astype(int)))
        out[i, text] = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    return out


def rows_of(df, **kw):
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup(df, **kw).collect()]


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnoß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, base = prose(40), prose(120)
    rows = [(i, prose(rng.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, f"{prose(8)} {shared} {prose(8)}") for i in range(30)]  # one passage in many contexts
    for i in range(40):  # near copies: one place changed
        at = rng.randrange(len(base))
        rows.append((200 + i, base[:at] + rng.choice("xyz") + base[at + 1 :]))
    rows += [(300 + i, base) for i in range(10)] + [(320 + i, shared[:50] * 5) for i in range(3)]
    rows += [(400, "a" * 700), (401, "a" * 99), (402, "ab" * 300), (403, "a" * 100), (404, ""), (405, None), (406, "é" * 120), (407, prose(50) + prose(30) * 2)]
    return rows


@pytest.mark.parametrize("hot", [65_536, 3])
def test_equal_to_brute_force(spark, hot):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(5)
    got = rows_of(df, hot=hot)
    assert sorted(r[0] for r in got) == sorted(r[0] for r in rows)
    texts = dict(rows)
    for i, n, spans, kept in got:
        b = (texts[i] or "").encode()
        assert n == len(b) and spans == want[i, texts[i] or ""], i
        cut = bytearray(b)
        for a, z in reversed(spans):
            del cut[a:z]
        assert kept == bytes(cut), i


def test_ids_that_repeat_and_null_ids(spark):
    long, other = "some words that are long enough " * 3 + "for a window of the sort, " * 4, "nothing like it " * 9
    rows = [(5, long), (5, long), (5, other), (None, long), (7, other + long), (9, None), (9, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)
    got = {}
    for i, n, spans, _ in rows_of(df):
        got.setdefault((i, n), []).append(spans)
    n_long, n_other = len(long), len(other)
    assert got[5, n_long][0] == got[5, n_long][1] and (n_long, n_other) != (0, 0)
    assert got[None, n_long] == [[(0, n_long)]] and got[9, 0] == [[], []]
    assert got[7, n_long + n_other] == [[(0, n_long + n_other)]]
    assert rows_of(spark.createDataFrame([], DOCS)) == []
    assert rows_of(spark.createDataFrame([(None, None, *"abcd")], DOCS)) == [(None, 0, [], b"")]


def test_very_long_text(spark):
    """Pieces of a long text are cut where anchors may stand on both sides."""
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    df = spark.createDataFrame([(1, a), (2, "x" * 30 + a[1_000_000:1_100_000] + "y" * 30)], "doc_id long, text string")
    got = {r[0]: r for r in rows_of(df)}
    assert got[1][2] == [] and got[2][2] == [(30, 100_030)]


def test_windows_are_sorted_and_equal_ones_found():
    rng = np.random.default_rng(2)
    data = np.concatenate([np.tile(rng.integers(0, 3, 150), 4), rng.integers(0, 2, 600), np.zeros(300)]).astype(np.uint8)
    at = rng.permutation(len(data) - WIDTH + 1)
    for group in (np.zeros(len(at), np.int64), np.sort(at % 3)):
        perm, equal = sorted_windows(data, at, group)
        got = [data[at[p] : at[p] + WIDTH].tobytes() for p in perm]
        for k in range(1, len(at)):
            if group[k] == group[k - 1]:
                assert got[k - 1] <= got[k] and equal[k] == (got[k] == got[k - 1])
            else:
                assert not equal[k]
        assert (group[perm] == group).all()


def test_equal_windows_share_an_anchor():
    base = bytes(np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8))
    texts = [base, b"zz" + base[1000:1500] + b"zz", base[1100:1200], base[:99]]
    number, start, count, place, h = segments(texts)
    where = {}
    for i, s, c, p, a in zip(number, start, count, place, h, strict=True):
        for o in range(c):
            where.setdefault(texts[i][s + o : s + o + WIDTH], set()).add((int(a), int(p - o)))
    assert all(len(v) == 1 for v in where.values())
    assert sum(count) == sum(max(0, len(t) - WIDTH + 1) for t in texts)


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    for r in op13_suffix_dedup(spark, sf).collect():
        text = dict(rows)[r.doc_id] or ""
        spans = want[r.doc_id, text]
        b = bytearray(text.encode())
        for a, z in reversed(spans):
            del b[a:z]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text.encode()), len(text.encode()) - len(b), len(spans))
        assert r.kept_sha256 == hashlib.sha256(bytes(b)).hexdigest()
