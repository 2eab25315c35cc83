"""Extraction with a lexicon: garbage by unknown words, initials, corrected names and units, over
documents written from ``customer``; and scans that end at a succession, from ``supplier``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.wordlists import UNITS
from marlstone.operators import extract as E
from marlstone.operators import results as R
from marlstone.operators import spelling as S
from marlstone.operators.stages import dealt
from marlstone.plans.catalogue import Label
from marlstone.plans.line_queries import read

#: By customer number modulo 6: the line after the label, and the line after that. ``W`` stands for
#: a word of the lexicon, ``K`` for a word with the number, which the lexicon lacks.
SHAPES = (
    ("W K Limited", "of the lane"), ("qzx Ltd vbq wxk pfm", "W Bolt K Limited"), ("no widget", "W Widget K Limited"),
    ("W Widget K Limted", "of the lane"), ("W Widget Bolt K Lim ited", "of the lane"), ("JD Bolt", "of the lane"),
)
UNIT = ("cubic metres", "cubic metrs", "cub ic metres", "cubic mertes")
WORDS = ("limited", "ltd", "of", "the", "lane", "no", "widget", "bolt", "cubic", "metres", "licensed", "to", "rate")
HOLDER = Label(name="Holder", texts=("Licensed to",), position="before", format="company")
RATE = Label(name="Rate", texts=("Rate",), format="units", possibilities=UNITS)
LATER = Label(name="Granted", texts=("Granted to",), position="before", format="company")
SUCCESSION = Label(name="Succession", texts=("Succession to licence",), position="succession", format="company")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of part names and market segments, and those of the documents' own phrases."""
    parts = read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    segments = read(spark, sf, "customer").select(F.lower("c_mktsegment").alias("word"))
    return parts.union(segments).union(spark.createDataFrame([(w,) for w in WORDS], "word string")).distinct()


def pages(spark: SparkSession, sf: str) -> DataFrame:
    key, word = F.col("c_custkey"), F.initcap("c_mktsegment")

    def line(text: str):
        parts = [word if w == "W" else F.concat(F.lit("K"), key.cast("string")) if w == "K" else F.lit(w) for w in text.split(" ")]
        return F.concat_ws(" ", *parts)

    def chosen(of, texts):
        return F.element_at(F.array(*texts), (key % of + 1).cast("int"))

    lines = [F.lit("Licensed to"), chosen(6, [line(a) for a, _ in SHAPES]), chosen(6, [line(b) for _, b in SHAPES])]
    lines.append(F.concat(F.lit("Rate "), key.cast("string"), F.lit(" "), chosen(4, map(F.lit, UNIT)), F.lit(" a day")))
    rows = dealt(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), most=10_000)
    return rows.select(key.cast("long").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


def _values(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "group", "line_no", "match_type", R.first_text(F.col("texts")).alias("value"))


def q_lexicon_facts(spark, sf):
    """Holders and units of garbled OCR pages."""
    groups = [("Holder", [HOLDER]), ("Rate", [RATE])]
    return _values(E.extract(E.documents_as_lines(pages(spark, sf)), groups, is_ocr=True, service="ocr", lexicon=lexicon(spark, sf)))


def q_lexicon_native(spark, sf):
    """The same pages as native text: garbage and initials by the lexicon, names as they stand."""
    return _values(E.extract(E.documents_as_lines(pages(spark, sf)), [("Holder", [HOLDER])], lexicon=lexicon(spark, sf)))


def q_unknown_words(spark, sf):
    """Words of the pages that the lexicon lacks, with what is suggested for them."""
    lines = E.documents_as_lines(pages(spark, sf)).select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.line_no", "x.text")
    odd, words = S.unknown(S.words_of(lines), lexicon(spark, sf)), lexicon(spark, sf)
    return odd.join(S.suggestions(odd, words), "word", "left").select("word", "n", "suggestion")


def q_succession_stop(spark, sf):
    """Even suppliers have the succession first and a label of higher rank after it, odd ones the
    other way round."""
    key = F.col("s_suppkey")
    holder = lambda t: F.concat(F.lit(f"{t} K"), key.cast("string"), F.lit(" Limited"))
    old, new = (F.concat_ws("\n", F.lit(x.texts[0]), holder(t)) for x, t in ((SUCCESSION, "Old"), (LATER, "New")))
    text = F.when(key % 2 == 0, F.concat_ws("\n", old, new)).otherwise(F.concat_ws("\n", new, old))
    docs = read(spark, sf, "supplier").select(key.alias("doc_id"), text.alias("text"))
    return _values(E.extract(E.documents_as_lines(docs), [("Holder", [LATER, SUCCESSION])]))



#: Letters for the digits of a brand.
DIGITS = ("0123456789", "abcdefghij")


def q_first_names(spark, sf):
    """Parts as documents whose holder is known by a first name alone: brands that end in b, and
    those in c together with a first word of l or s, which are names of two words."""
    part, brand = read(spark, sf, "part"), F.translate(F.regexp_replace("p_brand", "#", ""), *DIGITS)
    word = F.element_at(F.split("p_name", " "), 1)
    name = F.when(brand.endswith("b"), brand).when(brand.endswith("c") & word.rlike("^[ls]"), F.concat_ws(" ", brand, word))
    holder = F.concat_ws(" ", F.when(F.col("p_size") % 2 == 1, "Kaz"), brand, "p_name")
    rows = dealt(part.select("p_partkey", "p_brand", "p_name", "p_size"), most=10_000)
    docs = rows.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Licensed to\n"), holder, F.lit("\nof the lane")).alias("text"))
    found = E.extract(E.documents_as_lines(docs), [("Holder", [HOLDER])], part.select(name.alias("name")))
    return _values(found).select("doc_id", "line_no", "value")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_DOC = "d AS (SELECT c_custkey::BIGINT AS k, c_mktsegment[1] || lower(c_mktsegment[2:]) AS w FROM customer)"
_CLEAN = "WHEN 0 THEN w || ' K' || k || ' Limited' WHEN 1 THEN w || ' Bolt K' || k || ' Limited' WHEN 2 THEN w || ' Widget K' || k || ' Limited'"
ORACLE = {
    "lexicon_facts": f"""WITH {_DOC} SELECT k AS doc_id, 'Holder' AS "group", CASE WHEN k % 6 IN (1, 2) THEN 2 ELSE 1 END AS line_no, 'near_next_line' AS match_type,
CASE k % 6 {_CLEAN} WHEN 4 THEN w || ' Widget Bolt K' || k || ' Limited' WHEN 5 THEN 'JD Bolt' ELSE w || ' Widget K' || k || ' Limited' END AS value FROM d
UNION ALL SELECT k, 'Rate', 3, 'same_line', 'cubic metres' FROM d""",
    "lexicon_native": f"""WITH {_DOC} SELECT k AS doc_id, 'Holder' AS "group", CASE WHEN k % 6 IN (1, 2) THEN 2 ELSE 1 END AS line_no, 'near_next_line' AS match_type,
CASE k % 6 {_CLEAN} WHEN 5 THEN 'JD Bolt' END AS value FROM d WHERE k % 6 NOT IN (3, 4)""",
    "unknown_words": """WITH d AS (SELECT c_custkey AS k FROM customer), w AS (
SELECT 'k' || k AS word, NULL AS suggestion FROM d WHERE k % 6 <> 5
UNION ALL SELECT unnest(['qzx', 'vbq', 'wxk', 'pfm']), NULL FROM d WHERE k % 6 = 1
UNION ALL SELECT 'limted', 'limited' FROM d WHERE k % 6 = 3 UNION ALL SELECT unnest(['lim', 'ited']), NULL FROM d WHERE k % 6 = 4
UNION ALL SELECT 'jd', NULL FROM d WHERE k % 6 = 5 UNION ALL SELECT 'metrs', 'metres' FROM d WHERE k % 4 = 1
UNION ALL SELECT unnest(['cub', 'ic']), NULL FROM d WHERE k % 4 = 2 UNION ALL SELECT 'mertes', 'metres' FROM d WHERE k % 4 = 3
UNION ALL SELECT unnest(['a', 'day']), NULL FROM d)
SELECT word, count(*) AS n, suggestion FROM w GROUP BY word, suggestion""",
    "succession_stop": """SELECT s_suppkey AS doc_id, 'Holder' AS "group", 1 AS line_no, 'near_next_line' AS match_type,
CASE WHEN s_suppkey % 2 = 0 THEN 'Old K' ELSE 'New K' END || s_suppkey || ' Limited' AS value FROM supplier""",
    "first_names": """WITH b AS (SELECT p_partkey AS doc_id, translate(replace(p_brand, '#', ''), '0123456789', 'abcdefghij') AS brand, p_name, p_size FROM part),
n AS (SELECT DISTINCT lower(CASE WHEN brand LIKE '%b' THEN brand WHEN brand LIKE '%c' AND regexp_matches(p_name, '^[ls]') THEN brand || ' ' || split_part(p_name, ' ', 1) END) AS name FROM b),
h AS (SELECT doc_id, CASE WHEN p_size % 2 = 1 THEN 'Kaz ' ELSE '' END || brand || ' ' || p_name AS value FROM b)
SELECT doc_id, 1 AS line_no, value FROM h WHERE EXISTS (FROM n WHERE starts_with(lower(value), name || ' ') OR starts_with(trim(lower(substr(value, strpos(value, ' ')))), name || ' '))""",
}
