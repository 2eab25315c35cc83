"""Licences of several shapes, OCR lines, index rows and linked numbers over documents written from
the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import extract as E
from marlstone.operators import results as R
from marlstone.operators.stages import dealt
from marlstone.plans.licence_catalogue import GROUPS
from marlstone.plans.licence_queries import NUMBER
from marlstone.plans.line_queries import read
from marlstone.sources import lines as S

_OWN, _A, _B = (NUMBER.format(x) for x in ("c_custkey", "floor(c_custkey / 3)", "floor(c_custkey / 5)"))
#: Lines of a licence, each as parts in SQL, by customer number modulo 9.
SHAPES = (
    # number and holder below its label
    (("'Licence Serial No: '", _OWN), ("'The Environment Agency hereby grant a licence to'",), ("'Holder K'", "c_custkey", "' Limited'"), ("'of The Mill, Lower Lane'",)),
    # a holder whose name goes on from the line above
    (("'Serial No. '", _OWN), ("'Green Water'",), ("'Licensee trading as Mill K'", "c_custkey", "' Limited'")),
    # a holder of one word beside the label
    (("'Licence no. '", _OWN), ("'Licensee: Kavex'", "c_custkey")),
    # a garbled label of the number, the holder above its label
    (("'Licence Seriel Nu: '", _OWN), ("'Holder K'", "c_custkey", "' Limited'"), ("'of The Mill, Lower Lane'",), ("'(hereinafter referred to as \"The Licence Holder\")'",)),
    # two linked numbers on a line
    (
        ("'Licence number: '", _OWN), ("'MAXIMUM QUANTITY OF WATER TO BE ABSTRACTED'",), ("'6.1 '", "c_custkey % 50 + 1", "' cubic metres per hour'"),
        ("c_custkey % 50 * 24 + 24", "' cubic metres per day'"),
        ("'6.2 The aggregate quantity of water authorised under this licence and licence number '", _A, "' and '", _B),
        ("'shall not exceed '", "c_custkey % 50 * 36 + 36", "' cubic metres per day'"), ("'7. MEANS OF MEASUREMENT'",),
    ),
    # a succession with both of its texts
    (("'Licence Serial No: '", _OWN), ("'Succession to licence'",), ("'Holder K'", "c_custkey", "' Limited'"), ("'as amended by the order'",)),
    # a succession with one text, a label of the limits broken over two lines
    (
        ("'Licence Serial No: '", _OWN), ("'Succession to licence'",), ("'Holder K'", "c_custkey", "' Limited'"), ("'MAXIMUM QUANTITY OF WATER'",),
        ("'TO BE ABSTRACTED'",), ("'6.1 '", "c_custkey % 50 + 1", "' cubic metres per hour'"), ("'7. MEANS OF MEASUREMENT'",),
    ),
    # an agency that is no holder, then one whose line goes on after its name
    (("'Reference No. '", _OWN), ("'The Authority hereby grant a licence to'",), ("'Anglia agency Limited'",), ("'Real K'", "c_custkey", "' Ltd of Kent'")),
    # nothing that the catalogue knows
    (("'Dear K'", "c_custkey"), ("'thank you for your letter'",)),
)


def shaped_licences(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id`` and ``text``: a document for each customer, in the shape of its number."""
    texts = [F.concat_ws("\n", *[F.concat(*[F.expr(p).cast("string") for p in line]) for line in shape]) for shape in SHAPES]
    chosen = F.element_at(F.array(*texts), (F.col("c_custkey") % len(SHAPES) + 1).cast("int"))
    keys = dealt(read(spark, sf, "customer").select("c_custkey"), most=10_000)
    return keys.select(F.col("c_custkey").cast("long").alias("doc_id"), chosen.alias("text"))


def q_licence_shapes(spark, sf):
    """Holders, numbers, limits and linked numbers of all shapes by the whole catalogue."""
    found = E.extract(E.documents_as_lines(shaped_licences(spark, sf)), GROUPS)
    kept = F.col("group").isin("Company", "LicenceNumber") | F.col("name").isin("DocumentAbstractionLimitsSection", "LinkedLicenceNumber")
    texts = F.array_join(F.transform("texts", lambda x: x["text"]), "|")
    return found.filter(kept).select("doc_id", "group", "name", "line_no", "match_type", "matched_text", texts.alias("texts"))


def scanned_words(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as OCR lines; words whose length three does not divide have a confidence."""
    lines = S.from_documents(read(spark, sf, "documents"))
    size = lambda w: F.length(w)
    words = F.transform(F.split("text", " ", -1), lambda w: F.struct(w.alias("text"), F.when(size(w) % 3 > 0, (size(w) * 37 % 101).cast("double")).alias("conf")))
    return lines.select("doc_id", "line_no", words.alias("words"))


def q_line_confidence(spark, sf):
    """The mean confidence of each line, and as it is shown; odd lines are native text."""
    mean = S.word_confidence(F.col("words"))
    return scanned_words(spark, sf).select("doc_id", "line_no", mean.alias("conf"), T.percent(mean, F.col("line_no") % 2 == 0).alias("shown"))


def scanned_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of orders as OCR lines of two images a document, some of them blank."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    text = F.when(part % 5 == 0, " . ").otherwise(F.concat(F.lit(" ‘"), part.cast("string"), F.lit("’  of"), n.cast("string")))
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (n % 2).alias("image_no"), (n * F.lit(1 << 32) + part).alias("ord"),
        text.alias("text"), (part % 7 * 60).cast("double").alias("x"), F.col("l_quantity").alias("y"),
    )


def q_cloud_order(spark, sf):
    return S.cloud_order(scanned_items(spark, sf)).select("doc_id", "image_no", "ord", "text")


def q_ocr_lines(spark, sf):
    return S.ocr_lines(scanned_items(spark, sf)).select("doc_id", "image_no", "line_no", "text")


def q_index_rows(spark, sf):
    """A row of the index for each supplier; every fourth has no holder."""
    key = F.col("s_suppkey")
    name = F.concat(F.col("s_name"), F.lit(' & Sons "of the long river valley" <'), F.col("s_nationkey").cast("string"), F.lit(">"))
    rows = read(spark, sf, "supplier").select(key.alias("doc_id"), F.when(key % 4 > 0, name).alias("holder"))
    return R.index_rows(rows)


def q_linked_by_number(spark, sf):
    """Part numbers of orders beside the first item of an even line that bears the number."""
    item = F.struct("l_linenumber", "l_partkey")
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    linked = F.transform(
        F.filter("items", lambda x: x["l_linenumber"] % 2 == 0), lambda x: F.struct(x["l_partkey"].alias("number"), x["l_linenumber"].alias("result"))
    )
    made = R.positional(F.transform("items", lambda x: x["l_partkey"]), linked)
    return rows.select("doc_id", F.posexplode(made).alias("ord", "x")).select("doc_id", "ord", "x.number", F.col("x.result.result").alias("line"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_N = "'28/39/' || lpad(({0} // 10000)::VARCHAR, 2, '0') || '/' || lpad(({0} % 10000)::VARCHAR, 4, '0')"
_HOLDER = "'Holder K' || k || ' Limited'"
_LIMITS = """h || ' cubic metres per hour|' || h * 24 || ' cubic metres per day|The aggregate quantity of water authorised under this licence and licence number '
 || a || ' and ' || b || '|shall not exceed ' || h * 36 || ' cubic metres per day'"""
#: By shape: group, name, line, kind of match, label, lines. The number is that of the first line but for a garbled label.
_FOUND = (
    (0, "Company", "", 2, "near_next_line", "hereby grant a licence to", _HOLDER),
    (1, "Company", "", 2, "same_line_2_lines", "Licensee", "'Green Water trading as Mill K' || k || ' Limited'"),
    (2, "Company", "", 1, "same_line_single_word", "Licensee", "'Kavex' || k"),
    (3, "Company", "", 1, "near_previous_line", '(hereinafter referred to as "The Licence Holder")', _HOLDER),
    (4, "AbstractionLimits", "DocumentAbstractionLimitsSection", 1, "between", "MAXIMUM QUANTITY OF WATER TO BE ABSTRACTED", _LIMITS),
    (4, "AbstractionLimits", "LinkedLicenceNumber", 4, "same_line", "licence number ", "a || '|' || b"),
    (5, "Company", "", 2, "near_next_line", "Succession to licence", _HOLDER),
    (7, "Company", "", 3, "near_next_line", "hereby grant a licence to", "'Real K' || k || ' Ltd'"),
    *[
        (shape, "LicenceNumber", "", 0, "same_line", label, "number")
        for shape, label in (
            (0, "licence serial no:"), (1, "serial no."), (2, "licence no."), (4, "Licence number: "), (5, "licence serial no:"), (6, "licence serial no:"),
            (7, "Reference No."),
        )
    ],
)
_ROWS = " UNION ALL ".join(
    f"""SELECT k AS doc_id, '{group}' AS "group", '{name}' AS name, {line} AS line_no, '{kind}' AS match_type, '{label}' AS matched_text, {texts} AS texts FROM v WHERE s = {shape}"""
    for shape, group, name, line, kind, label, texts in _FOUND
)
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM documents)"
_ITEMS = """i AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS image_no, l_linenumber * (1::BIGINT << 32) + l_partkey AS n, l_partkey % 7 * 60 AS x, l_quantity AS y, l_partkey % 5 = 0 AS blank,
 CASE WHEN l_partkey % 5 = 0 THEN ' . ' ELSE ' ‘' || l_partkey || '’  of' || l_linenumber END AS text FROM lineitem)"""
_NAME = """s_name || ' & Sons "of the long river valley" <' || s_nationkey || '>'"""

ORACLE = {
    "licence_shapes": f"""WITH r AS (SELECT c_custkey::BIGINT AS k, c_custkey % {len(SHAPES)} AS s, c_custkey % 50 + 1 AS h, c_custkey // 3 AS t, c_custkey // 5 AS u FROM customer),
v AS (SELECT k, s, h, {_N.format('k')} AS number, {_N.format('t')} AS a, {_N.format('u')} AS b FROM r) {_ROWS}""",
    "line_confidence": f"""WITH {_LINES}, w AS (SELECT doc_id, line_no, list_transform(list_filter(string_split(text, ' '), lambda w: length(w) % 3 > 0), lambda w: (length(w) * 37 % 101)::DOUBLE) AS c FROM l),
m AS (SELECT doc_id, line_no, CASE WHEN len(c) > 0 THEN list_sum(c) / len(c) END AS conf FROM w)
SELECT doc_id, line_no, conf, CASE WHEN line_no % 2 = 0 AND conf IS NOT NULL THEN round_even(conf, 1)::VARCHAR || '%' ELSE '' END AS shown FROM m""",
    "cloud_order": f"""WITH {_ITEMS} SELECT doc_id, image_no, text,
(row_number() OVER (PARTITION BY doc_id, image_no ORDER BY round_even(y / 40, 0), x, n) - 1)::INT AS ord FROM i""",
    "ocr_lines": f"""WITH {_ITEMS} SELECT doc_id, image_no, (row_number() OVER (PARTITION BY doc_id, image_no ORDER BY n) - 1)::INT AS line_no,
replace(replace(replace(trim(text), '‘', '"'), '’', '"'), '  ', ' ') AS text FROM i WHERE NOT blank""",
    "index_rows": f"""WITH n AS (SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 4 > 0 THEN {_NAME} ELSE '--' END AS v FROM supplier),
w AS (SELECT doc_id, v, (length(v) - 1) // 30 AS breaks, regexp_replace(v, '(.{{30}})', '\\1' || chr(10), 'g') AS t FROM n),
f AS (SELECT doc_id, CASE WHEN length(v) % 30 = 0 THEN t[:-2] ELSE t END AS t FROM w)
SELECT doc_id, '<tr><td>' || doc_id || '</td><td>' || replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td></tr>' AS html FROM f""",
    "linked_by_number": """WITH i AS (SELECT l_orderkey AS doc_id, l_partkey AS number, l_linenumber AS n FROM lineitem),
e AS (SELECT doc_id, number, min(n) AS line FROM i WHERE n % 2 = 0 GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, number) - 1)::INT AS ord, number, line FROM i LEFT JOIN e USING (doc_id, number)""",
}
