"""Vector codes and whitening against brute force in exact numbers, and their edge cases."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from marlstone.llm.vector_codes import Tree, compress_vectors, digest, op11_vector_codes
from marlstone.llm.whitening import exact_squares, op12_whitening, whiten

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, _v string, _id string, code string, w string, length string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, *"abcde") for i, v, label in rows], VECTORS)


def table_rows(spark):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]


def brute_codes(rows):
    rows = sorted((i, np.floor(256 * np.array(v, float)).astype(np.int64).reshape(16, -1), label) for i, v, label in rows)
    x = np.array([r[1] for r in rows])
    books = x[:64].transpose(1, 0, 2).copy()
    assign = lambda: ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    for _ in range(2):
        at = assign().argmin(2)
        for p in range(16):
            for e in range(books.shape[1]):
                mine = x[at[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    d = assign()
    error = d.min(2).sum(1)
    total = {}
    for r, e in zip(rows, error):
        total[r[2]] = total.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return {r[0]: ("".join(f"{c:02x}" for c in at), int(e), total[r[2]], sha) for r, at, e in zip(rows, d.argmin(2), error)}


def test_tree_gives_the_lowest_of_the_nearest():
    rng = np.random.default_rng(1)
    for width in (1, 2, 4):
        entries = rng.integers(-3, 4, (64, width))
        x = rng.integers(-5, 6, (3000, width))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        at, near = Tree(entries).nearest(x)
        assert (at == d.argmin(1)).all() and (near == d.min(1)).all()


def test_codes_equal_brute_force(spark):
    rows = table_rows(spark)
    want = brute_codes(rows)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in op11_vector_codes(spark, SF).collect()}
    assert got == want


def test_code_edges(spark):
    rng = np.random.default_rng(2)
    base = [(i, rng.integers(-2, 3, 16).astype(float).tolist(), None if i % 5 else i % 3) for i in range(200)]  # many ties
    bad = [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [float("inf")] * 16, None), (903, [None] * 16, 2)]
    want = brute_codes(base)
    codes, books = compress_vectors(frame(spark, base + bad).repartition(7))
    got = {r.vec_id: (r.code, r.error, r.label_error, digest(books[16])) for r in codes.collect()}
    assert got == want
    twice, _ = compress_vectors(frame(spark, base[:70] + base[:70]))
    out = twice.collect()
    assert len(out) == 140 and len({(r.vec_id, r.code, r.error, r.label_error) for r in out}) == 70
    codes, books = compress_vectors(frame(spark, [(None, [1.0] * 3, None), (1, [], 1), (2, [3e38] * 16, 2), (3, [-3e38] * 16, 2), (4, [0.5] * 3, 1)]))
    out = {r.vec_id: r for r in codes.collect()}
    assert sorted(books) == [0, 3, 16] and len(out) == 5 and out[1].code == "00" * 16 and out[1].error == 0
    assert all(r.error == 0 for r in out.values()) and out[4].code[:2] == "00" and out[None].code[:2] == "01"
    assert compress_vectors(frame(spark, []))[0].collect() == []
    assert compress_vectors(frame(spark, bad))[0].collect() == []


def brute_whitening(rows):
    x = np.array([np.floor(1024 * np.array(v, float)).astype(np.int64) + 100_000 for _, v, _ in rows]).astype(object)
    n, s = len(x), x.sum(0)
    y = n * x - s
    deviation = [int(d) for d in (y * y).sum(1)]
    c = y.astype(float) / n
    e, vecs = np.linalg.eigh(c.T @ c / n)
    e, vecs = e[::-1], vecs[:, ::-1]
    trace = float(Fraction(sum(deviation), n**3))
    return n, deviation, c @ vecs / np.sqrt(np.maximum(e, 1e-30)), e / trace


def test_whitening_equals_eigenvectors(spark):
    rows = table_rows(spark)
    n, deviation, white, explained = brute_whitening(rows)
    place = {r[0]: k for k, r in enumerate(rows)}
    out = op12_whitening(spark, SF).collect()
    assert len(out) == 8 * n and {r.component for r in out} == set(range(1, 9))
    got = np.zeros((n, 8))
    for r in out:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[place[r.vec_id]] and r.identity_error < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    sign = np.sign((got * white[:, :8]).sum(0))
    assert np.abs(got * sign - white[:, :8]).max() < 1e-7


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    flat = [(i, [float(i % 7), float(i % 5), 2.0, float(i % 7)], None) for i in range(60)]  # two directions
    bad = [(900, None, 1), (901, [float("nan")] * 4, 1), (902, [float("inf")] * 4, None), (903, [None] * 4, 2)]
    out = whiten(frame(spark, flat + bad)).collect()
    assert len(out) == 120 and all(r.n == 60 and r.identity_error < 1e-9 for r in out)
    assert abs(sum({r.component: r.explained for r in out}.values()) - 1) < 1e-9
    assert whiten(frame(spark, [])).collect() == whiten(frame(spark, bad)).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0], 1)])).collect() == whiten(frame(spark, [(1, [], 1), (2, [], 1), (3, [1.0], 0), (4, [1.0], 0)])).collect() == []
    twice = [(None, rng.normal(size=20).tolist(), 1) for _ in range(30)]
    out = whiten(frame(spark, twice + twice + [(5, [3e38, 1.0], None), (6, [1.0, -3e38], None), (7, [0.0, 0.0], None)])).collect()
    assert sum(r.n == 60 for r in out) == 480 and {r.vec_id for r in out if r.n == 3} == {5, 6, 7}
    assert all(r.identity_error < 1e-4 for r in out) and [r.deviation for r in out if r.n == 3 and r.vec_id == 5] == [None] * 2


@pytest.mark.parametrize("most", [10, 1 << 40, 1 << 55])
def test_squares_are_exact(most):
    y = np.random.default_rng(4).integers(-most, most, (50, 64))
    assert exact_squares(y) == [sum(int(v) ** 2 for v in row) for row in y]
