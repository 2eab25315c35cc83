"""Blocks and nearest values by windows, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import lines as L

WORDS = ("start here", "the end", "words", "", "start", "held", "end of it", "a start")


def matches(line, labels):
    return next((x for x in labels if line.lower().startswith(x) or " " + x in line.lower()), None)


def blocks(lines, start, end, frame, must):
    out, n = [], len(lines)
    for i, line in enumerate(lines):
        m = matches(line, [x for x in start if x != L.BLOCK_START])
        whole = m is None and L.BLOCK_START in start and i == 0
        if m is None and not whole:
            continue
        stop = next((j for j in range(i + 1, min(n, i + frame + 1)) if matches(lines[j], [x for x in end if x != L.BLOCK_END])), None)
        if stop is None and L.BLOCK_END not in end:
            continue
        head = line if whole else line[line.lower().index(m) + len(m) :].strip(" .,")
        body = ([(i, head)] if head else []) + [(j, lines[j]) for j in range(i + 1, min(n, i + frame + 1) if stop is None else stop)]
        if not must or any(x in t for _, t in body for x in must):
            out += [(i, stop, j, t) for j, t in body]
    return sorted(out, key=repr)


@pytest.mark.parametrize("end", [("end",), ("end", L.BLOCK_END), (L.BLOCK_END,)])
@pytest.mark.parametrize("must", [(), ("held",)])
def test_blocks(spark, end, must):
    rng = random.Random(3)
    docs = [[rng.choice(WORDS) for _ in range(k)] for k in (0, 1, 2, 5, 30, 60)]
    rows = [(d, i, t) for d, lines in enumerate(docs) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, text string").repartition(3)
    for start, frame in ((("start",), 7), (("start", L.BLOCK_START), 100)):
        got = L.between_blocks(df, start, end, frame, must).collect()
        for d, lines in enumerate(docs):
            mine = sorted(((r.start_line, r.end_line, r["at"], r.line) for r in got if r.doc_id == d), key=repr)
            assert mine == blocks(lines, start, end, frame, must), (d, start)


def test_nearest_value(spark):
    rng = random.Random(5)
    anchors = [(rng.randrange(4), rng.randrange(30)) for _ in range(40)] + [(9, 1)]
    values = [(rng.randrange(4), rng.randrange(30), rng.randrange(3), f"v{k}") for k in range(40)]
    a = spark.createDataFrame(anchors, "doc_id int, line_no int").repartition(3)
    v = spark.createDataFrame(values, "doc_id int, value_line int, value_ord int, value string").repartition(3)
    got = {(r.doc_id, r.line_no): (r.gap, r.value_line, r.value) for r in L.nearest(a, v).collect()}
    want = {}
    for d, n in anchors:
        best = min(((abs(x - n), x, o, t) for e, x, o, t in values if e == d), default=None)
        if best:
            want[d, n] = (best[0], best[1], best[3])
    assert got == want and len(L.nearest(a, v.limit(0)).collect()) == 0
    plan = L.nearest(a, v)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_nearest_needs_no_values_on_both_sides(spark):
    a = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(5).alias("line_no"))
    v = spark.createDataFrame([(1, 9, 0, "x")], "doc_id int, value_line int, value_ord int, value string")
    assert [tuple(r) for r in L.nearest(a, v).collect()] == [(1, 5, 4, 9, "x")]
