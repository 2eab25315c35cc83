"""Large groups in many blocks, repeated ids, thresholds and clashing columns, against brute force."""

import numpy as np
import pytest

from marlstone.llm import embeddings as E
from marlstone.llm import language_id as I
from marlstone.llm import minhash as M
from marlstone.llm import quality as Q
from marlstone.llm.line_dedup import line_dedup
from tests.llm.test_results import closure, near_brute

WORDS = [f"w{i}" for i in range(400)]


def family(rng, n, size, edits):
    base = [WORDS[i] for i in rng.integers(0, 400, size)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.integers(0, size, edits[k % len(edits)]):
            text[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(text))
    return out


def test_near_dedup_in_many_blocks(spark, monkeypatch):
    """One large family with close and far members: pivots settle most, the rest meet in blocks."""
    rng = np.random.default_rng(3)
    texts = list(enumerate(family(rng, 150, 160, (0, 1, 3, 5, 7, 9)) + family(rng, 40, 60, (1, 2)) + family(rng, 3, 900, (4,))))
    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(M, "PIVOTS", 2)
    sizes, want = near_brute(texts, 4, 80)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = M.near_dedup(docs, width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert 1 < len(set(want.values())) < len(texts)


def test_near_dedup_of_repeated_ids(spark):
    rng = np.random.default_rng(5)
    a, b = (" ".join(WORDS[i] for i in rng.integers(0, 400, 60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a), (None, a), (4, b), (4, b)]
    got = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False)
    ]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, None)] * 2


def test_near_dedup_of_many_copies(spark):
    """A third of the rows are copies of one text and some are blank; the other sets stand alone."""
    rows = [(i, "one text of many copies 0") for i in range(2500)] + [(i, "  ") for i in range(2500, 3000)]
    rows += [(i, " ".join(f"u{i}_{k}" for k in range(6))) for i in range(3000, 7500)] + [(None, "one text of many copies 0"), (None, None)]
    got = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert all((r.component_id, r.kept) == (None, None) for r in got if r.doc_id is None)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: 0 if i < 2500 else i for i in range(7500)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_line_dedup_around_the_threshold(spark):
    rows, k = [], 0
    for sites in (8, 9, 10, 11, 12, 30):
        for s in range(sites):
            rows.append((k, f"line on {sites} sites\nown line {k}\n\n line on {sites} sites ", f"s{s}"))
            k += 1
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    first, removed = {}, {r.doc_id: r.n_removed for r in got}
    for d, text, _ in rows:
        line = text.split("\n")[0]
        many = int(line.split()[2]) >= 10
        want = 0 if not many else 2 if line in first else 1
        first.setdefault(line, d)
        assert removed[d] == want, (d, line)
    assert {r.doc_id: r.text for r in got}[first["line on 10 sites"]] == f"line on 10 sites\nown line {first['line on 10 sites']}\n"


def test_line_dedup_carries_clashing_columns(spark):
    names = ["_id", "_key", "_out", "row", "doc", "site", "lines", "gone", "h1", "h2", "first", "n", "pos", "n_lines"]
    rows = [(d, f"same\nown {d}", f"s{d}", *[f"{c}{d}" for c in names]) for d in range(12)] + [(None, "same", "s1", *names)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))).collect()
    for r in got:
        assert [r[c] for c in names[:-1]] == [f"{c}{r.doc_id}" if r.doc_id is not None else c for c in names[:-1]]
    # a row without an id comes first
    assert sorted(r.text for r in got) == sorted(["same"] + [f"own {d}" for d in range(12)])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_in_many_blocks(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.1, 0.2, 0.3, 0.4) for _ in range(5)])
    x = np.concatenate((x, x[:20])).astype(np.float32 if kind == "float" else float).astype(float)
    monkeypatch.setattr(E, "HOME_ROWS", 64)
    monkeypatch.setattr(E, "OTHER_ROWS", 96)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    linked[np.arange(20), np.arange(1500, 1520)] = linked[np.arange(1500, 1520), np.arange(20)] = True
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {r.vec_id: r for r in E.embedding_dedup(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == linked.sum(1).tolist()
    want = closure(range(len(x)), zip(*map(np.ndarray.tolist, np.nonzero(linked))))
    assert {i: r.component_id for i, r in got.items()} == want


def test_decoding_of_codewords():
    """The nearest codeword by loss, bit by bit."""
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 9):
        code = I.codewords(n)
        assert len({tuple(w) for w in code.tolist()}) == n
        bits = code.shape[1]
        model = I.Model([f"l{i}" for i in range(n)], code, rng.normal(size=(I.DIMS, bits)), rng.normal(size=bits), rng.uniform(0.1, 1, bits))
        x = rng.random((20, I.DIMS))
        best, score, lead = model.decode(x)
        for i in range(20):
            margin = [sum(x[i, d] * model.weights[d, b] for d in range(I.DIMS)) + model.bias[b] for b in range(bits)]
            loss = [sum(model.trust[b] * np.log1p(np.exp(-margin[b] * word[b])) if margin[b] * word[b] > -500 else -model.trust[b] * margin[b] * word[b] for b in range(bits)) for word in code]
            share = np.exp(min(loss) - np.array(loss))
            share /= share.sum()
            assert best[i] == int(np.argmin(loss))
            assert abs(score[i] - share.max()) < 1e-9 and abs(lead[i] - (np.sort(share)[-1] - np.sort(share)[-2])) < 1e-9


def test_rare_languages_are_not_learned(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(40)] + [(100 + i, "der hund und die katze", "de") for i in range(40)] + [(999, "zz", "zz")]
    model = I.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", most_languages=2)
    assert model.languages == ["de", "en"]


SF = "/root/testdata/sf0.1"


def test_quality_posteriors_and_unseen_labels(spark):
    """Posteriors worked out again from the evidence; ranks of labels that were not fitted."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").filter("quality IS NOT NULL")
    seen, unseen = labels.filter("doc_id % 3 <> 0"), {r.doc_id: r.quality for r in labels.filter("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in Q.score_quality(docs, seen).collect()}
    good, bad = ([got[d].score for d, q in unseen.items() if q == k and d in got] for k in (1, 0))
    above = np.mean([(g > np.array(bad)).mean() + (g == np.array(bad)).mean() / 2 for g in good])
    print("unseen labels:", len(unseen), "AUC", round(float(above), 4))
    assert above > 0.9
    groups = {r.doc_id: (r.source or "", r.lang or "") for r in docs.select("doc_id", "source", "lang").collect()}
    n, s, hn, hs = {}, {}, {}, {}
    for d, (h, p) in groups.items():
        e = got[d].p_doc
        n[h, p], s[h, p], hn[h], hs[h] = n.get((h, p), 0) + 1, s.get((h, p), 0) + e, hn.get(h, 0) + 1, hs.get(h, 0) + e
    rows, rate = sum(hn.values()), sum(hs.values()) / sum(hn.values())
    k = Q.prior_strength(rows, len(hn), rate, sum(hs[h] ** 2 / hn[h] for h in hn) / rows - rate**2)
    host = {h: (hs[h] + k * rate) / (hn[h] + k) for h in hn}
    spread = sum(n[g] * (s[g] / n[g] - host[g[0]]) ** 2 for g in n) / rows
    below = Q.prior_strength(rows, len(n) - len(hn) + 1, rate, spread)
    odds = lambda p: np.log(p / (1 - p))
    for d, g in groups.items():
        r = got[d]
        path = min(0.999, max(0.001, (s[g] - r.p_doc + below * host[g[0]]) / (n[g] - 1 + below)))
        score = 1 / (1 + np.exp(-(odds(r.p_doc) + odds(path) - odds(rate))))
        assert abs(r.p_host - host[g[0]]) < 1e-9 and abs(r.p_path - path) < 1e-9 and abs(r.score - score) < 1e-9 and r.kept == (score >= Q.LEAST_SCORE)
