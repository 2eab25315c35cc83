"""What extraction reads and how its work is dealt, so that its time and memory follow the input."""

from pyspark.sql import functions as F

from marlstone.operators import extract as E
from marlstone.operators.persons import persons
from marlstone.operators.stages import dealt
from marlstone.plans import lexicon_queries as X
from marlstone.plans import line_queries as Q
from marlstone.plans import licence_queries as L
from marlstone.plans import variant_queries as V
from marlstone.plans.catalogue import Label, flatten
from marlstone.plans.licence_catalogue import GROUPS


def _nodes(spark, text, label):
    flat = flatten([("G", [label])])
    docs = E.documents_as_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    labels = F.array(*[F.from_json(F.lit(E.json.dumps(E._label_row(f))), E.LABEL) for f in flat])
    return E.nodes_of(docs.select("doc_id", F.lit(None).cast("string").alias("parent_id"), "lines"), labels, None, False, [label])


def test_places_after_the_first_value_are_not_read(spark):
    label = Label(name="Total", texts=("Total",), position="prefer_before", format="number")
    found = _nodes(spark, "3 old\nTotal 5\n6 new", label)
    assert [r.texts[0].text for r in found.collect()] == ["5"]
    # nor is a value worked out twice, in a filter and again beside it
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter (" in line and "size(CASE" in line]


def test_every_value_keeps_all_places(spark):
    label = Label(name="Total", texts=("Total",), position="prefer_before", format="number", multiple="every_value")
    got = {r.texts[0].text for r in _nodes(spark, "3 old\nTotal 5\n6 new", label).collect()}
    assert got == {"5", "3", "6"}


def test_licences_of_one_small_file_are_many_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert L.licences(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= cores


def test_tasks_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    counts = [dealt(spark.range(n), "id", most=100).rdd.getNumPartitions() for n in (10, 1_000, 10_000)]
    assert counts == [cores, 10, 100]


def test_items_are_dealt_by_their_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "dealt", lambda rows, *keys, most: seen.append((keys, most)) or dealt(rows, *keys, most=most))
    L.label_lines(spark, "/root/testdata/sf0.001")
    assert seen == [(("l_orderkey",), 200_000)]


def test_shaped_licences_are_many_tasks(spark):
    assert V.shaped_licences(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lexicon_pages_are_many_tasks(spark):
    assert X.pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_nodes_settle_with_one_sort(spark):
    plan = L.q_label_positions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Window ") >= 3 and plan.count(" Sort ") == 1


def test_licences_settle_with_few_windows(spark):
    docs = E.documents_as_lines(L.licences(spark, "/root/testdata/sf0.001"))
    plan = E.extract(docs, GROUPS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Window ") <= 14 and plan.count(" Sort ") == 1


def test_expressions_of_a_level_are_built_once(spark):
    makers = (E._hit_columns, E._node_columns)
    before = [make() for make in makers]
    found = _nodes(spark, "Total 5", Label(name="Total", texts=("Total",), format="number"))
    assert [r.texts[0].text for r in found.collect()] == ["5"]
    assert all(make() is old for make, old in zip(makers, before, strict=True))


def test_joined_values_of_named_hits_leave_block_starts_out(spark):
    label = Label(name="Part", texts=(E.BLOCK_START, "Part"), ends=(E.BLOCK_END,), position="between", multiple="joined")
    docs = E.documents_as_lines(spark.createDataFrame([(1, "top\nPart a\nPart b"), (2, "top\nend")], "doc_id long, text string"))
    got = {r.doc_id: [t.text for t in r.texts] for r in E.extract(docs, [("G", [label])]).collect()}
    assert got == {1: ["a", "Part b", "b"], 2: ["top", "end"]}


def test_turns_are_dealt_before_they_become_lines(spark):
    plan = Q.q_collapse_blank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_words_of_a_document_are_distinct_without_a_shuffle(spark):
    docs = E.documents_as_lines(spark.createDataFrame([(1, "Ann Bell\nann (ann) Lee"), (2, ""), (3, "nobody")], "doc_id long, text string"))
    found = persons(docs, spark.createDataFrame([("Ann Bell",), ("lee",), (" ",), (None,)], "name string"))
    assert {r.doc_id: sorted(r.persons) for r in found.collect()} == {1: ["ann bell", "lee"]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert " HashAggregate" not in plan


def test_parts_are_dealt_before_they_become_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "dealt", lambda rows, most: seen.append(most) or dealt(rows, most=most))
    X.q_first_names(spark, "/root/testdata/sf0.001")
    assert seen == [10_000]
