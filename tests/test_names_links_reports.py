"""Lists of first names, licence maps in parts, closures in buckets, and what reports read."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import extract as E
from marlstone.operators import links as K
from marlstone.operators import results as R
from marlstone.operators import stages
from marlstone.operators.persons import persons
from marlstone.plans.catalogue import Label
from marlstone.sources import lines as S

HOLDER = [("Holder", [Label(name="Holder", texts=("Licensed to",), position="before", format="company")])]
HOLDERS = ("Anna Brook", "Kaz Anna Brook", "Mary Jane Hill", "Mary Hill", "Hill Mary Jane X", "(Anna) Brook", "nobody here", "anna", "")


def held(spark, names, schema="name string"):
    docs = spark.createDataFrame([(i, f"Licensed to\n{t}\nof the lane") for i, t in enumerate(HOLDERS)], "doc_id int, text string")
    names = spark.createDataFrame([(n,) for n in names], schema) if schema else names
    return {r.doc_id: r.texts[0].text for r in E.extract(E.documents_as_lines(docs), HOLDER, names).collect()}


def test_names_of_a_table_equal_names_in_the_plan(spark):
    names = ["anna", "mary jane"]
    want = {0: "Anna Brook", 1: "Kaz Anna Brook", 2: "Mary Jane Hill", 4: "Hill Mary Jane X"}
    assert held(spark, names, None) == want
    assert held(spark, [" Anna ", "mary jane", "MARY JANE", None, ""]) == want
    assert held(spark, []) == {}


def test_the_plan_does_not_grow_with_the_names(spark):
    docs = E.documents_as_lines(spark.createDataFrame([(1, "Licensed to\nAnna Brook")], "doc_id int, text string"))

    def size(n):
        names = spark.range(n).select(F.concat(F.lit("anna"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("name"))
        out = E.extract(docs, HOLDER, names)
        assert [r.texts[0].text for r in out.collect()] == ["Anna Brook"]
        return len(out._jdf.queryExecution().analyzed().toString())

    assert abs(size(100_000) - size(10)) < 200


def test_persons_follow_corrections(spark):
    docs = spark.createDataFrame([(1, [("Ana Brook", 0)]), (2, None), (3, [])], "doc_id int, lines array<struct<text:string,line_no:int>>")
    names = spark.createDataFrame([("anna",)], "name string")
    spelling = spark.sql("SELECT 1 AS doc_id, struct(array('ana') AS odd, CAST(NULL AS array<string>) AS joined, map('ana', 'anna') AS better) AS spelling")
    assert persons(docs, names).collect() == []
    assert [(r.doc_id, r.persons) for r in persons(docs, names, spelling).collect()] == [(1, ["anna"])]


def test_a_map_is_read_in_parts_and_the_last_row_wins(spark, tmp_path):
    rows = [(f"f/{i}.pdf", f"28/{i % 700}") for i in range(6000)]
    (tmp_path / "a.csv").write_text("Filename,LicenceNumber\r\n" + "".join(f"{f},{n}\r\n" for f, n in rows) + "\r\n")
    (tmp_path / "b.csv").write_text('Filename,LicenceNumber\n"q.pdf,28/5,more\nnone\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = S.read_licence_map(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {r.licence_number: r.filename for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {n: f.split("/")[1] for f, n in rows} | {"28/5": '"q.pdf'}


def brute_closure(roots, edges):
    out = set()
    for root in roots:
        seen, level, depth = {root}, [root], 0
        while level:
            depth += 1
            found = {}
            for s, t, o in edges:
                if s in level and t not in seen:
                    found[t] = min(found.get(t, (o, s)), (o, s))
            seen |= set(found)
            out |= {(root, t, depth, s) for t, (o, s) in found.items()}
            level = list(found)
    return out


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_closure_equals_brute_force(spark, broadcast):
    edges = [(i, (i * 7 + k * k) % 40, k) for i in range(40) for k in range(3) if i % 5] + [(1, 1, 0), (2, 3, 0), (2, 3, 1)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = spark.createDataFrame(edges, "source long, target long, ord int")
        roots = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
        got = K.closure(roots, rows, 40).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == len(set(got)) and {tuple(r[c] for c in ("root", "doc_id", "depth", "parent")) for r in got} == brute_closure(range(0, 40, 3), edges)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stage_")]


def test_what_was_reached_is_not_shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = stages.Buckets(spark.range(50).selectExpr("id AS root", "id AS doc_id"), ["root", "doc_id"])
        seen.append(spark.range(50, 90).selectExpr("id AS root", "id AS doc_id"))
        fresh = spark.range(80, 100).selectExpr("id AS root", "id AS doc_id").groupBy("root", "doc_id").count()
        left = fresh.join(seen.table(), ["root", "doc_id"], "left_anti")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.root for r in left.collect()) == list(range(90, 100))
        assert plan.count("Exchange hashpartitioning") == 1
        assert seen.close().count() == 90
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_chain_too_long_raises_and_trees_are_stored_once(spark):
    edges = spark.range(30).selectExpr("id AS source", "id + 1 AS target", "0 AS ord")
    with pytest.raises(RuntimeError):
        K.closure(spark.range(1).withColumnRenamed("id", "doc_id"), edges, 5)
    assert K.closure(spark.range(1).withColumnRenamed("id", "doc_id"), edges, 30).count() == 30
    trees = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "doc_id long, results array<string>")
    links = spark.createDataFrame([(1, 3, 0), (1, 2, 1), (1, 3, 2), (2, 9, 0)], "source long, target long, ord int")
    got = {r.doc_id: (r.results, r.linked) for r in K.with_references(trees, links).collect()}
    assert got == {1: (["a"], [3, 2]), 2: (["b"], [9]), 3: (["c"], [])}
    reached = K.closure(trees.select("doc_id"), links)
    assert {(r.root, r.doc_id, r.results and r.results[0]) for r in K.linked_results(trees, reached).collect()} == {(1, 3, "c"), (1, 2, "b"), (1, 9, None), (2, 9, None)}


def test_a_local_warehouse_is_not_shared_on_a_cluster():
    assert stages.shared("file:/x/warehouse", "local[4]") == "file:/x/warehouse"
    assert stages.shared("hdfs://n/warehouse", "spark://m:7077") == "hdfs://n/warehouse"
    for path in ("file:/x/warehouse", "/x/warehouse"):
        with pytest.raises(ValueError):
            stages.shared(path, "spark://m:7077")


def test_report_json_and_dump(spark):
    text = spark.createDataFrame([(1, "Licensed to\nMr Brook\nof the lane"), (2, "none")], "doc_id int, text string")
    nodes = E.extract(E.documents_as_lines(text), HOLDER, service="cached")
    (row,) = R.report_json(nodes, 0, F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), "data").collect()
    assert row.json.startswith("var data = ")
    assert json.loads(row.json[len("var data = "):]) == {
        "filename": "1.pdf",
        "matches": [{
            "text": [{"text": "Mr Brook", "lineNumber": 1}], "matchType": "nearNextLineIsCompany", "isOcr": False, "lineNumber": 1, "serviceName": "cached",
            "labelGroupName": "Holder", "matchedLabel": {"text": ["Licensed to"], "name": "Holder"},
        }],
    }
    lines = spark.createDataFrame([(1, 1, None), (1, 0, "a"), (2, 10, "z"), (2, 9, "y")], "doc_id int, line_no int, text string")
    assert {r.doc_id: r.dump for r in R.text_dump(lines).collect()} == {1: "0 a\r\n1 ", 2: "9 y\r\n10 z"}


def test_firsts_and_unmatched(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 5, "n")], "k string, t int, v string")
    assert {r.k: (r.v, r.t) for r in R.firsts(rows, ["k"], ["t"], ["v", "t"]).collect()} == {"a": ("y", 1), None: ("n", 5)}
    assert {r.k: r.v for r in R.firsts(rows, ["k"], ["t"], ["v"], last=True).collect()} == {"a": "x", None: "n"}
    assert [r.k for r in R.unmatched(rows, rows.filter("k = 'a'"), ["k"]).collect()] == [None]
