"""Words of a lexicon inside extraction: corrections, garbage, initials, vocabularies; successions."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import extractors as X
from marlstone.functions import text as T
from marlstone.operators import extract as E
from marlstone.operators.spelling import spellings, suggestions
from marlstone.plans.catalogue import Label

WORDS = "green hill farms limited north water licence the of to esq grant a company abstraction fish we".split()


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([(w,) for w in WORDS + ["Limited", None]], "word string").filter("word IS NOT NULL")


def documents(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return E.documents_as_lines(rows)


CORRECTED = {
    "Green Hill Limted": "Green Hill Limited", "Green Hil Lim ited": "Green Hill Limited", "Mr Limted Gren": "Mr Limted Gren",
    "limted": "limted", "JD Limted": "JD Limited", "Hill esq": "Hill esq", "A.B.C. Limted": "A.B.C. Limited", "Green Hills Farm": "Green Hills Farm",
    "we limted": "we limited", "Gren F arms": "Green Farms", "": "", "zzqq vvxx": "zzqq vvxx", "Nroth Farms": "North Farms", "Wa ter wa ter": "Water water",
}


def test_corrections_word_by_word(spark, lexicon):
    docs = documents(spark, CORRECTED)
    got = docs.join(spellings(docs, lexicon), "doc_id", "left")
    line = F.get("lines", F.lit(0))["text"]
    out = got.select("doc_id", T.corrected(line, F.col("spelling")).alias("c"), T.corrected(line, F.col("spelling"), True).alias("d")).collect()
    texts = list(CORRECTED)
    assert {texts[r.doc_id]: r.c for r in out} == CORRECTED
    dropped = {texts[r.doc_id]: r.d for r in out}
    assert dropped["we limted"] == "limited" and dropped["Green Hill Limted"] == "Green Hill Limited"


def test_no_spelling_changes_nothing(spark):
    null = F.lit(None).cast(T.SPELLING)
    row = spark.range(1).select(
        T.corrected(F.lit("Green Limted"), null).alias("c"), T.knows(null)(F.lit("qqq")).alias("k"),
        T.looks_corrupted(F.lit("qq ww ee rr"), T.knows(null)).alias("g"), T.looks_corrupted(F.lit("qqx wwx eex rrx"), T.knows(null)).alias("h"),
    ).first()
    assert (row.c, row.k, row.g, row.h) == ("Green Limted", True, True, False)


def test_garbage_and_initials_need_the_lexicon(spark, lexicon):
    label = [("Holder", [Label(texts=("Granted to",), position="before", format="company")])]
    texts = [
        "Granted to\nwxyz Ltd qzx vbn\nGreen Hill Limited", "Granted to\nwe fish\nGreen Hill Limited", "Granted to\nGreen Hill Limted\nnothing here",
        "no label at all\nGreen Hill Limted", None, "",
    ]

    def found(**more):
        rows = E.extract(documents(spark, texts), label, **more).collect()
        return {r.doc_id: [x.text for x in r.texts] for r in rows}

    assert found() == {0: ["wxyz Ltd"], 1: ["we fish", "Green Hill Limited"]}
    assert found(lexicon=lexicon) == {0: ["Green Hill Limited"], 1: ["Green Hill Limited"]}
    assert found(lexicon=lexicon, is_ocr=True) == {0: ["Green Hill Limited"], 1: ["Green Hill Limited"], 2: ["Green Hill Limited"]}
    # a line that ends with a company suffix is no garbage, whatever its words
    assert found(lexicon=lexicon.limit(0), is_ocr=True) == {0: ["Green Hill Limited"], 1: ["Green Hill Limited"]}
    assert E.extract(documents(spark, []), label, lexicon=lexicon).collect() == []


def test_nested_labels_and_blocks_see_the_lexicon(spark, lexicon):
    inner = Label(name="Unit", texts=("per",), position="same_line", format="units", possibilities=("the company", "north water"))
    block = Label(name="Block", texts=("Start",), ends=("End",), position="between", multiple="first", sub_labels=(inner,))
    text = "Start\nqzx vbn wxk pfm\nper the nrth water licence\nEnd"
    rows = E.extract(documents(spark, [text]), [("G", [block])], lexicon=lexicon).collect()
    got = {r.name: [x.text for x in r.texts] for r in rows}
    assert got == {"Block": ["per the nrth water licence"], "Unit": ["north water"]}
    rows = E.extract(documents(spark, [text]), [("G", [block])]).collect()
    assert {r.name: [x.text for x in r.texts] for r in rows} == {"Block": ["qzx vbn wxk pfm", "per the nrth water licence"]}


def test_vocabulary_keeps_its_order(spark, lexicon):
    docs = documents(spark, ["the nrth water", "green watr", "grean north"])
    entries = F.array(*map(F.lit, ("water", "north", "green")))
    out = docs.join(spellings(docs, lexicon), "doc_id").select("doc_id", X.vocabulary(F.col("lines"), entries, F.col("spelling"))[0]["text"].alias("v"))
    assert {r.doc_id: r.v for r in out.collect()} == {0: "water", 1: "water", 2: "north"}


def test_suggestions_are_one_edit_or_a_swap_away(spark, lexicon):
    words = spark.createDataFrame([("limted",), ("limted,",), ("nroth",), ("wetar",), ("hilll",), ("gree",)], "word string")
    got = {r.word: r.suggestion for r in suggestions(words, lexicon.select(F.lower("word").alias("word"))).collect()}
    assert got == {"limted": "limited", "nroth": "north", "hilll": "hill", "gree": "green"}


def test_a_succession_ends_the_scan(spark):
    first = Label(name="First", texts=("Granted to",), position="before", format="company")
    stop = Label(name="Stop", texts=("Succession",), position="succession", format="company")
    texts = [
        "Succession\nOld Limited\nGranted to\nNew Limited", "Granted to\nNew Limited\nSuccession\nOld Limited",
        "Succession\nGranted to\nNew Limited", "Granted to\nnobody known\nSuccession\nOld Limited", "Succession\nnobody\n",
    ]
    rows = E.extract(documents(spark, texts), [("H", [first, stop])]).collect()
    got = {r.doc_id: (r.name, r.texts[0].text) for r in rows}
    assert got[0] == ("Stop", "Old Limited") and got[1] == ("First", "New Limited")
    assert got[2] == ("Stop", "New Limited") and 4 not in got
