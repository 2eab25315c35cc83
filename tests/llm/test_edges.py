"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every
dealt operator and every stage of the pipeline."""

import pytest

import corpus_pipeline
from marlstone.llm.bpe import bpe_encode, default_vocabulary
from marlstone.llm.embeddings import embedding_dedup
from marlstone.llm.exact_dedup import exact_dedup
from marlstone.llm.html_text import extract_text
from marlstone.llm.language_id import identify, train
from marlstone.llm.licences import scan_licences
from marlstone.llm.line_dedup import line_dedup
from marlstone.llm.minhash import near_dedup
from marlstone.llm.packing import pack_documents
from marlstone.llm.quality import score_quality

#: Extra columns bear names that operators use for their own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, kept string, node string, text_sha256 string"
EXTRA = ("x", None, "y", "z", None)
LINE = "Some line that all of the sites of this table share"
LONG = "langer Satz mit Wörtern " * 40_000


def rows():
    body = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood tonight"
    out = [(i, f"{body} number {i}\n{LINE}\n", "en", f"s{i % 12}", 10) for i in range(24)]
    out += [(30, None, "en", "s1", None), (31, "", None, None, 0), (32, " \n\t", "en", None, 3), (33, LONG, "de", "s2", 5), (34, LONG, "de", None, 5)]
    out += [(35, "12345 !!", None, "s3", 1), (36, "x", None, "s3", 1), (36, "x", None, "s3", 1), (37, "MIT", "en", "s3", 1)]
    out += [(38, f"{body} number 1\n{LINE}\n", "en", "s9", 10)]
    return [r + EXTRA for r in out]


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(24)] + [(30, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "language": lambda s, d: identify(d, train(d, "doc_id", "text", "lang")),
    "packing": lambda s, d: pack_documents(d, default_vocabulary()),
    "exact": lambda s, d: exact_dedup(d),
    "bpe": lambda s, d: bpe_encode(d, default_vocabulary()),
    "minhash": lambda s, d: near_dedup(d),
    "lines": lambda s, d: line_dedup(d),
    "quality": lambda s, d: score_quality(d, labels(s)),
    "licences": lambda s, d: scan_licences(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_null_columns(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).collect() == []
    nulls = spark.createDataFrame([(1, *[None] * 9), (2, *[None] * 9)], DOCS)
    out = OPERATORS[name](spark, nulls).collect()
    assert name == "licences" or sorted({r.doc_id for r in out}) == [1, 2]


@pytest.mark.parametrize("name", [k for k in OPERATORS if k != "licences"])
def test_every_row_gets_its_result(spark, name):
    docs = spark.createDataFrame(rows(), DOCS).repartition(5)
    got = [r.doc_id for r in OPERATORS[name](spark, docs).collect()]
    if name == "packing":
        assert set(got) == {r[0] for r in rows()}
    else:
        assert sorted(got) == sorted(r[0] for r in rows())


def test_language_edges(spark):
    out = {r.doc_id: r for r in OPERATORS["language"](spark, spark.createDataFrame(rows(), DOCS)).collect()}
    assert [out[i].lang_pred for i in (30, 31, 32, 35)] == ["und"] * 4
    assert all(out[i].score == 0 for i in (30, 31, 32, 35))
    assert out[33].lang_pred == out[34].lang_pred == "de" and out[5].lang_pred == "en"


def test_exact_dedup_edges(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    out = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert out[31].keep_id == 30 and out[30].group_size == 2 and out[34].keep_id == 33 and out[36].group_size == 2
    # texts that share a hash stay apart
    from pyspark.sql import functions as F

    clash = exact_dedup(docs, hash_fn=lambda c: F.substring(F.md5(c), 1, 1)).collect()
    assert sorted(map(tuple, clash)) == sorted(map(tuple, exact_dedup(docs).collect()))


def test_near_dedup_edges(spark):
    out = {r.doc_id: r for r in near_dedup(spark.createDataFrame(rows(), DOCS)).collect()}
    assert out[30].n_shingles == out[31].n_shingles == out[32].n_shingles == 0
    assert [out[i].component_id for i in (30, 31, 32)] == [30, 31, 32]
    assert out[34].component_id == 33 and out[38].component_id == out[1].component_id == 0 or out[38].component_id == 1


def test_line_dedup_keeps_the_first_and_the_columns(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = line_dedup(docs)
    assert set(docs.columns) <= set(got.columns)
    out = {r.doc_id: r for r in got.collect()}
    assert LINE in out[0].text and all(LINE not in out[i].text for i in range(1, 24))
    assert out[0].n_removed == 0 and out[5].n_removed == 1
    assert out[30].text is None and out[32].text == " \n\t" and out[33].text == LONG


def test_licence_families(spark):
    docs = spark.createDataFrame(
        [(1, "Intro.\nReleased under the MIT License.\nEnd"), (2, "You need a fishing licence to fish here."), (3, None), (4, ""),
         (5, "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."),
         (5, "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."),
         (6, "the word " * 50_000 + "licence"), (None, "All rights reserved."), (7, "Released\nunder the\nMIT License."), (8, "a b\n\nMIT license")],
        "doc_id long, text string",
    )
    out = sorted(((r.doc_id or 0, r.para, r.family) for r in scan_licences(docs).collect()))
    assert out == [(0, 0, "Proprietary"), (1, 1, "MIT"), (5, 0, "Apache-2.0"), (5, 1, "Apache-2.0"), (7, 0, "MIT"), (8, 2, "MIT")]


VECTORS = "vec_id long, embedding array<float>, label int, _v string, kept string"


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        [1.0, 0.0], [1.0, 0.0], [2.0, 0.1], [0.0, 1.0], [0.0, 0.0], None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0, 0.0], [-1.0, 0.0], [1e-30, 0.0], [3e38, 0.0],
    ]
    rows = [(i, v, None, "a", "b") for i, v in enumerate(vectors)]
    out = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, VECTORS)).collect()}
    linked = {0, 1, 2, 12, 13}
    for i, r in out.items():
        want = (4, 0) if i in linked else (0, i)
        assert (r.n_links, r.component_id, r.kept) == (*want, want[1] == i), i
    assert embedding_dedup(spark.createDataFrame([], VECTORS)).collect() == []


def test_repeated_and_null_ids_of_vectors(spark):
    """By row against all products: ids that repeat with other vectors, and rows without an id."""
    import numpy as np

    rng = np.random.default_rng(8)
    ids = [1, 1, 1, 2, 3, None, None, 7, 7, None, 4]
    x = [[1, 0], [0.99, 0.01], [0, 1], [0.98, 0.02], [-1, 0], [0.01, 1], [-1, -1], [-1, 0], [1, 0], [1, -1], [3, 3]]
    ids += [int(i) for i in rng.integers(100, 120, 40)]
    x += (rng.normal(size=(40, 2)) @ [[1, 0.2], [0, 0.1]]).tolist()
    unit = np.array(x, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    far = 1 << 40
    low = np.array([far if i is None else i for i in ids])
    while True:
        nxt = np.minimum(low, np.where(linked, low[None, :], far).min(1))
        if (nxt == low).all():
            break
        low = nxt
    want = sorted((str(i), int(n), str(None if c == far else int(c)), i is not None and i == c) for i, n, c in zip(ids, linked.sum(1), low))
    rows = [(i, [float(a) for a in v], None, "a", "b") for i, v in zip(ids, x)]
    got = embedding_dedup(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want


def test_cells_lose_no_link(spark):
    """Many crowded cells and blocks against all products in double precision."""
    import numpy as np

    from marlstone.llm import embeddings as E

    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5) for _ in range(4)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.embedding_dedup(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == linked.sum(1).tolist()
    label = np.arange(len(x))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(x)).min(1))
        if (low == label).all():
            break
        label = low
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


PAGES = "page_id long, url string, html string, _id string, text string, _host string"


def test_page_edges(spark):
    assert extract_text(spark.createDataFrame([], PAGES)).collect() == []
    long = "<p>" + "wort und satz " * 60_000 + "</p>"
    rows = [
        (1, None, None), (2, "http://a/", ""), (3, "http://a/", "<p>broken <b>mark"), (4, "http://a/", "<<<>&#x0;&bogus;"), (5, "bad url", long),
        (6, "http://a/", "plain"), (6, "http://a/", "plain"), (7, "http://a/", "<nav>only menu</nav>"), (8, "http://a/", "<script>x"),
    ]
    got = [(r.page_id, r.text) for r in extract_text(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)).collect()]
    assert sorted(i for i, _ in got) == [r[0] for r in rows]
    out = dict(got)
    assert out[1] == out[2] == out[7] == out[8] == "" and out[3] == "broken mark" and out[6] == "plain"
    assert out[5] == " ".join(["wort und satz"] * 60_000)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_edges(spark, tmp_path, k):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    empty = stage(spark, spark.createDataFrame([], DOCS), str(tmp_path))
    assert empty.collect() == []
    docs = spark.createDataFrame(rows(), DOCS)
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows()}
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and got
    if name == "language_id":
        assert not {30, 31, 32, 35} & {r.doc_id for r in got}
    nulls = spark.createDataFrame([(1, *[None] * 9)], DOCS)
    assert {r.doc_id for r in stage(spark, nulls, str(tmp_path)).collect()} <= {1}


def test_a_word_of_letters_is_remembered_once():
    """It is one pretoken: its ids are worked out without the pattern and kept in one cache, not in two."""
    import numpy as np
    from tokenizers import Tokenizer

    from marlstone.llm import bpe

    path = bpe.default_vocabulary()
    codec, text = bpe.ByteBpe(path), "Unverbriefte words xqzvplk stay whole don't x9 été"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert not {" words", " xqzvplk", "Unverbriefte"} & set(codec.pretokens)


def test_texts_of_a_slice_share_their_pieces():
    """A piece is worked out once for all texts of a slice, however long it is; odd texts are encoded alone."""
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from marlstone.llm import bpe

    path, long = bpe.default_vocabulary(), "xqz" * 40
    codec, library, seen = bpe.ByteBpe(path), Tokenizer.from_file(path), []
    texts = [f"{long} été, naïve. {long} \u00aa", None, "", " ", f"one  two {long}", "line\nend of it's", " x", "y ", "a <|endoftext|> b", "東京 x９ \u0250z"] + [f"{long} and {long}"] * 5
    work = codec.pretokens.work
    codec.pretokens.work = lambda piece: seen.append(piece) or work(piece)
    for size in (1, 300, 8 << 20):
        bpe.SLICE_BYTES, was = size, bpe.SLICE_BYTES
        try:
            got = list(codec.encode_all(pa.array(texts)))
        finally:
            bpe.SLICE_BYTES = was
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [codec.decode(g) for g in got] == [t or "" for t in texts]
    seen.clear()
    list(codec.encode_all(pa.array(texts[-5:])))
    assert sorted(seen) == [" " + long, long]
