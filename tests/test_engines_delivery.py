"""Engines by cost and delivery by document on small fixtures."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import engines as N
from marlstone.operators.engines import Engine, by_cost, cached, extract_by_cost
from marlstone.operators.extract import gather_lines
from marlstone.plans.catalogue import Label
from marlstone.streaming.documents import deliver, document_stream, latest

GROUPS = [("A", [Label(texts=("Total",), format="number")]), ("B", [Label(texts=("Holder",), position="before", format="company")])]
LINES = "doc_id long, line_no int, text string"


def values(found):
    return sorted((r.doc_id, r.group, r.service, r.texts[0].text) for r in found.collect())


def test_costlier_engines_read_what_is_lacking(spark):
    native = spark.createDataFrame([(1, 0, "Total 5"), (1, 1, "Holder"), (1, 2, "K Limited"), (2, 0, "Total 6"), (3, 0, "Holder"), (4, 0, "none")], LINES)
    ocr = [(2, 0, "Holder"), (2, 1, "Two Limited"), (2, 2, "Total 66"), (3, 0, "Three Limited"), (1, 0, "Total 99")]
    asked = []

    def reading(name, rows):
        def read(wanted):
            asked.append((name, sorted(r.doc_id for r in wanted.collect())))
            return gather_lines(spark.createDataFrame(rows, LINES).join(wanted, "doc_id", "left_semi"))

        return read

    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    engines = [Engine("dear", 5, reading("dear", [(3, 0, "Total 7"), (4, 0, "Total 8")])), Engine("ocr", 1, reading("ocr", ocr)), cached("text", 0, native, False)]
    found = extract_by_cost(docs, engines, GROUPS)
    assert values(found) == [
        (1, "A", "text", "5"), (1, "B", "text", "K Limited"), (2, "A", "text", "6"), (2, "B", "ocr", "Two Limited"),
        (3, "A", "dear", "7"), (3, "B", "ocr", "Three Limited"), (4, "A", "dear", "8"),
    ]
    assert asked == [("ocr", [2, 3, 4]), ("dear", [3, 4])]
    assert {r.service: r.is_ocr for r in found.collect()} == {"text": False, "ocr": True, "dear": True}
    asked.clear()
    # the loop ends once nothing is lacking; without the cheapest engine's lines a label of theirs is not seen
    assert len(values(extract_by_cost(docs.filter("doc_id < 3"), engines, GROUPS))) == 4 and asked == [("ocr", [2])]
    alone = extract_by_cost(docs.filter("doc_id = 3"), engines, GROUPS, on_top=False)
    assert values(alone) == [(3, "A", "dear", "7")]


def test_engines_without_documents_and_with_one_name(spark):
    native = spark.createDataFrame([], LINES)
    assert extract_by_cost(spark.createDataFrame([], "doc_id long"), [cached("x", 1, native)], GROUPS).collect() == []
    assert extract_by_cost(spark.createDataFrame([(1,), (1,)], "doc_id long"), [cached("x", 1, native)], GROUPS).collect() == []
    with pytest.raises(ValueError):
        by_cost([cached("x", 1, native), cached("x", 2, native)])
    assert [e.name for e in by_cost([cached("b", 1, native), cached("a", 1, native), cached("c", 0, native)])] == ["c", "b", "a"]


def test_a_document_that_comes_again_has_one_result(spark, tmp_path):
    source, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()

    def work(docs):
        return docs.select("doc_id", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")

    def arrive(**files):
        for name, text in files.items():
            part = tmp_path / f"{name}.part"
            part.write_text(text)
            part.rename(source / f"{len(list(source.iterdir()))}-{name}.txt")
        docs = document_stream(spark, str(source)).withColumn("doc_id", F.element_at(F.split("doc_id", "-"), -1))
        deliver(docs, work, out, log).awaitTermination()
        return sorted((r.doc_id, r.word) for r in latest(spark, out).collect())

    assert arrive(a="one two", b="three") == [("a", "one"), ("a", "two"), ("b", "three")]
    assert arrive(a="four", c="five") == [("a", "four"), ("b", "three"), ("c", "five")]
    assert arrive(b=" ") == [("a", "four"), ("c", "five")]
    # results of a batch that was killed before its documents were written are not read
    spark.createDataFrame([("a", "half")], "doc_id string, word string").write.parquet(f"{out}/results/batch=3")
    assert sorted((r.doc_id, r.word) for r in latest(spark, out).collect()) == [("a", "four"), ("c", "five")]
    assert arrive(a="six") == [("a", "six"), ("c", "five")]


def test_every_round_is_dealt_to_all_cores(spark, monkeypatch):
    """However few bytes the lines of an engine are."""
    tasks, was = [], N.extract
    monkeypatch.setattr(N, "extract", lambda lines, *a: tasks.append(lines.rdd.getNumPartitions()) or was(lines, *a))
    docs = spark.range(400).withColumnRenamed("id", "doc_id")
    rows = docs.selectExpr("doc_id", "0 AS line_no", "concat('Total ', doc_id) AS text")
    found = N.extract_by_cost(
        docs, [N.cached("cheap", 1, rows.filter("doc_id % 2 = 0")), N.cached("dear", 2, rows)], [("Total", [Label(name="Total", texts=("Total",), format="number")])]
    )
    assert {(r.doc_id, r.texts[0].text, r.service) for r in found.collect()} == {(k, str(k), "dear" if k % 2 else "cheap") for k in range(400)}
    assert len(tasks) == 2 and min(tasks) >= spark.sparkContext.defaultParallelism
