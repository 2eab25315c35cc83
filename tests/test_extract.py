"""Catalogue extraction, links, results, path steps, sources and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import paths as P
from marlstone.operators import extract as E
from marlstone.operators import links as K
from marlstone.operators import results as R
from marlstone.plans.catalogue import Label, flatten
from marlstone.plans.licence_catalogue import GROUPS

LICENCE = """Licence Serial No: 28/39/28/0123
The Environment Agency hereby grant a licence to
Green Valley Farms Limited
of The Mill, Lower Lane
(hereinafter referred to as "The Licence Holder")
2. POINT OF ABSTRACTION
2.1 At National Grid Reference SU 123 456 on the bank
For Purpose 4.1
3. MEANS OF ABSTRACTION
3.1 A pump with a capacity of 20 litres per second
4. PURPOSE OF ABSTRACTION
4.1 Spray irrigation on the fields
5. PERIOD OF ABSTRACTION
5.1 All year
6. MAXIMUM QUANTITY OF WATER TO BE ABSTRACTED
6.1 20 cubic metres per hour
475 cubic metres per day
33,182 cubic metres per year
6.2 The aggregate quantity of water authorised under this licence and licence number 28/39/28/0456
shall not exceed 1,000 cubic metres per day
7. MEANS OF MEASUREMENT
"""


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(1, LICENCE), (2, "nothing of the kind\nhere"), (3, None), (4, ""), (5, LICENCE.replace("0123", "0999"))]
    return E.extract(E.documents_as_lines(spark.createDataFrame(rows, "doc_id long, text string")), GROUPS).persist()


def test_licence_catalogue(facts):
    rows = facts.collect()
    assert {r.doc_id for r in rows} == {1, 5}
    got = {}
    for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: (r.line_no, r.node_id)):
        got.setdefault((r.group, r.name), []).append([x.text for x in r.texts])
    assert got["Company", ""] == [["Green Valley Farms Limited"]]
    assert got["LicenceNumber", ""] == [["28/39/28/0123"]]
    assert got["MeansOfAbstraction", "PerSecondUnitsMeans"] == [["litres"]]
    assert got["AbstractionLimits", "AbstractionLimitPoint"][0][:2] == ["20 cubic metres per hour", "475 cubic metres per day"]
    assert got["AbstractionLimits", "PerHourValue"] == [["20"]] and got["AbstractionLimits", "PerYearValue"] == [["33182"]]
    assert got["AbstractionLimits", "PerDayValue"] == [["475"], ["1000"]]
    assert got["AbstractionLimits", "PerDayUnits"] == [["cubic metres"], ["cubic metres"]]
    assert got["AbstractionLimits", "LinkedLicenceNumber"] == [["28/39/28/0456"]]
    assert got["Purpose", "TextWithoutPoints"] == [["Spray irrigation on the fields"]]
    assert got["Points", "PurposeLink"] == [["4.1"]]
    assert {r.match_type for r in rows if r.group == "Company"} == {"near_next_line"}


def test_every_node_hangs_on_a_parent(facts):
    rows = facts.collect()
    ids = {(r.doc_id, r.node_id) for r in rows}
    assert len(ids) == len(rows)
    assert all(r.parent_id is None or (r.doc_id, r.parent_id) in ids for r in rows)


def test_tree_and_json(facts):
    made = {r.doc_id: json.loads(r.json) for r in R.result_json(R.tree(facts, 3)).collect()}
    groups = [x["group"] for x in made[1]["results"]]
    assert sorted(set(groups)) == sorted(g for g, _ in GROUPS)
    limits = next(x for x in made[1]["results"] if x["group"] == "AbstractionLimits")
    assert [len(p["sub_results"]) for p in limits["sub_results"]] == [1, 1]
    script = R.result_json(R.tree(facts, 3), "data").first().json
    assert script.startswith("var data = {") and script.endswith("};")


def test_summary_totals_and_descendants(facts):
    rows = R.summary(facts)
    one = rows.filter("doc_id = 1").first()
    assert one.number == "28/39/28/0123" and one.holder == "Green Valley Farms Limited" and one.is_scan is False
    total = R.totals(rows).first()
    assert (total.documents, total.with_number, total.with_holder) == (2, 2, 2)
    roots = facts.filter("parent_id IS NULL AND group = 'AbstractionLimits' AND doc_id = 1")
    below = P.descendants(facts, roots, 3)
    assert below.count() == facts.filter("doc_id = 1 AND group = 'AbstractionLimits' AND parent_id IS NOT NULL").count()


def small(spark, text, *labels):
    docs = E.documents_as_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    return [[x.text for x in r.texts] for r in E.extract(docs, [("g", labels)]).orderBy("line_no", "node_id").collect()]


@pytest.mark.parametrize(
    ("label", "want"),
    [
        (Label(texts=("Total",), position="before", format="number"), [["7"]]),
        (Label(texts=("Total",), position="after", format="number"), [["3"]]),
        (Label(texts=("Total",), position="prefer_before", format="number"), [["3"]]),
        (Label(texts=("Total",), position="prefer_after", format="number"), [["2"]]),
        (Label(texts=("Total",), ends=("end",), position="between"), [["7 up", "8"]]),
        (Label(texts=("Total",), ends=("end",), position="between", must_contain=("nowhere",)), []),
        (Label(texts=("of",), format="text", multiple="every_label"), [["x y"], ["z"]]),
        (Label(texts=("of",), format="text", multiple="joined"), [["x y", "z"]]),
        (Label(texts=("of",), format="single_word"), [["x"]]),
        (Label(texts=("of", "z"), match_all=True), [["x y"]]),
        (Label(texts=("missing",)), []),
    ],
)
def test_places_and_multiplicity(spark, label, want):
    assert small(spark, "2 a\n3 b\nTotal\n7 up\n8\nend\nout of x y\nof z", label) == want


def test_catalogues_are_checked():
    with pytest.raises(ValueError):
        flatten([("g", [Label(position="nowhere")])])
    with pytest.raises(ValueError):
        flatten([("g", [Label(texts=("a",), position="between")])])


def test_closure_ends_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0), (1, 3, 1), (4, 4, 0)], "source long, target long, ord int")
    roots = spark.createDataFrame([(1,), (4,)], "doc_id long")
    got = sorted((r.root, r.doc_id, r.depth, r.parent) for r in K.closure(roots, edges).collect())
    assert got == [(1, 2, 1, 1), (1, 3, 1, 1)]
    assert K.closure(roots, edges.limit(0)).collect() == []


def test_ranks_of_names(spark):
    names = [(f"n{i * 37 % 5000:05d}", None) for i in range(5000)]
    got = K.graph_nodes(spark.createDataFrame(names, "doc_id string, number string")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.doc_id)] == list(range(1, 5001))


def test_path_steps(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>")
    one = df.select(
        P.element(F.col("a"), -1).alias("last"), P.span(F.col("a"), 1, None, 2).alias("odd"), P.span(F.col("a"), -2).alias("tail"),
        P.union(F.col("a"), [0, 3, 9]).alias("some"), P.where(F.col("a"), lambda x: x > 3).alias("big"),
    ).first()
    assert (one.last, one.odd, one.tail, one.some, one.big) == (5, [2, 4], [4, 5], [1, 4], [4, 5])


def test_file_stream_archives_and_repeats_safely(spark, tmp_path):
    from marlstone.streaming.documents import document_stream, process

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.b.txt").write_text("one\ntwo")
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def work(docs):
        return docs.select("doc_id", F.size(F.split("text", "\n")).alias("n"))

    process(document_stream(spark, str(source)), work, out, log).awaitTermination()
    (source / "c.txt").write_text("three")
    process(document_stream(spark, str(source)), work, out, log).awaitTermination()
    got = sorted((r.doc_id, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("a-b", 2), ("c", 1)]


def test_limits_pivot(spark):
    rows = [(1, 1, "day", "value", "475"), (1, 1, "day", "units", "litres"), (1, 2, "year", "value", "9")]
    got = R.limits_pivot(spark.createDataFrame(rows, "doc_id int, block int, period string, kind string, value string"), ["day", "year"]).orderBy("block").collect()
    assert [tuple(r) for r in got] == [(1, 1, "475", "litres", None, None), (1, 2, None, None, "9", None)]


def test_year_inside_a_licence_number_is_no_date(spark):
    from marlstone.functions import extractors as X

    texts = ["under licence number 28/39/00/1985", "28/39/00/1985 since 1990", "on 01/05/1985", "the aggregate of 28/39/00/1985", None]
    lines = spark.createDataFrame([([(t, i) for i, t in enumerate(texts)],)], f"lines {X.LINES}")
    assert [x.line_no for x in lines.select(X.dates_or_purposes(F.col("lines")).alias("x")).first().x] == [1, 2, 3]
    # the linked number of customer 5,956 ends with 1985
    docs = E.documents_as_lines(spark.createDataFrame([(1, LICENCE.replace("28/39/28/0456", "28/39/00/1985"))], "doc_id long, text string"))
    assert not [r for r in E.extract(docs, GROUPS, wanted=["AbstractionLimits"]).collect() if r["name"] == "PointPurpose"]
