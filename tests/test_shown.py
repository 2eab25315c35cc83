"""How values are shown: index rows, confidences and linked results, on small fixtures."""

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import results as R
from marlstone.sources import lines as S


def test_index_rows_wrap_before_they_escape(spark):
    rows = spark.createDataFrame([(1, "x" * 28 + "a&b<c>"), (2, None), (3, "y" * 30), (4, "")], "doc_id int, name string")
    got = {r.doc_id: r.html for r in R.index_rows(rows).collect()}
    assert got == {
        1: "<tr><td>1</td><td>" + "x" * 28 + "a&amp;\nb&lt;c&gt;</td></tr>", 2: "<tr><td>2</td><td>--</td></tr>",
        3: "<tr><td>3</td><td>" + "y" * 30 + "</td></tr>", 4: "<tr><td>4</td><td></td></tr>",
    }
    assert R.index_rows(rows.limit(0)).collect() == []


def test_confidence_of_a_line(spark):
    words = "array<struct<text:string,conf:double>>"
    rows = [(1, [("a", 90.0), ("b", None), ("c", 80.5)], True), (2, [("a", None)], True), (3, [], True), (4, [("a", 50.0)], False), (5, None, True)]
    df = spark.createDataFrame(rows, f"id int, words {words}, ocr boolean")
    mean = S.word_confidence(F.col("words"))
    got = {r.id: (r.m, r.p) for r in df.select("id", mean.alias("m"), T.percent(mean, F.col("ocr")).alias("p")).collect()}
    assert got == {1: (85.25, "85.2%"), 2: (None, ""), 3: (None, ""), 4: (50.0, ""), 5: (None, "")}


def test_linked_results_go_by_number(spark):
    linked = "array<struct<number:string,result:int>>"
    df = spark.createDataFrame([(["a", "b", "a", None], [("b", 1), ("a", 2), ("a", 3)]), ([], []), (["z"], [])], f"numbers array<string>, linked {linked}")
    got = [[(x.number, x.result.result if x.result else None) for x in r.m] for r in df.select(R.positional(F.col("numbers"), F.col("linked")).alias("m")).collect()]
    assert got == [[("a", 2), ("b", 1), ("a", 2), (None, None)], [], [("z", None)]]
