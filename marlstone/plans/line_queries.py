"""Queries of the line operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import extractors as X
from marlstone.functions import paths as P
from marlstone.functions import text as T
from marlstone.functions import wordlists as L
from marlstone.operators import lines as O
from marlstone.operators import results as R
from marlstone.operators.stages import dealt
from marlstone.sources import lines as S

NOTICES = ("licensed under", "released under", "all rights reserved")


def text_hash(text: str = "text", at: str = "line_no") -> Column:
    """The texts of a group in line order, as one hash."""
    return F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda x: x[text]), "\n")).alias("text_md5")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.from_documents(read(spark, sf, "documents"))


#: One label of one text for each notice.
NOTICE_LABELS = [(x,) for x in NOTICES]


def q_doc_lines(spark, sf):
    return doc_lines(spark, sf)


def q_trim_formatting(spark, sf):
    return doc_lines(spark, sf).select("doc_id", "line_no", T.trim_formatting(F.col("text")).alias("text"))


def q_standardise(spark, sf):
    return doc_lines(spark, sf).select("doc_id", "line_no", T.standardise(F.col("text")).alias("text"))


def q_blank_predicate(spark, sf):
    lines = S.from_documents(read(spark, sf, "pages"), "page_id", "html", ">")
    return lines.groupBy(F.col("doc_id").alias("page_id")).agg(F.count_if(T.is_blank(F.col("text"))).alias("blank_lines"), F.count("*").alias("lines"))


def q_collapse_blank(spark, sf):
    # turns are dealt by what their lines are grouped by, so that lines are not shuffled and a task holds a bounded number
    rows = dealt(read(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text"), "key", most=5_000)
    turns = rows.withColumn("text", F.regexp_replace("text", " ", "\n\n"))
    out = O.trimmed_blocks(S.from_documents(turns, "key"), collapse=True)
    return out.groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("lines"), F.count_if(F.col("text") == "").alias("empty_lines"), text_hash())


def q_label_hits(spark, sf):
    hits = O.label_hits(S.standardised(doc_lines(spark, sf)), NOTICE_LABELS)
    return hits.select("doc_id", "line_no", "label_id", "matched_text")


def q_first_notice_per_label(spark, sf):
    hits = O.fragments(O.first_per_label(O.label_hits(S.standardised(doc_lines(spark, sf)), NOTICE_LABELS)))
    return hits.select("doc_id", "label_id", "line_no", "matched_text", "before", "after")


def q_doc_prefilter(spark, sf):
    return O.documents_with(read(spark, sf, "documents"), "text", NOTICES).select("doc_id")


def q_context_window(spark, sf):
    c = O.context(doc_lines(spark, sf), 3, 3)
    join = lambda x: F.array_join(F.transform(x, lambda v: v["text"]), "|")
    return c.select("doc_id", "line_no", F.md5(join("previous")).alias("previous_md5"), F.md5(join("following")).alias("following_md5"))


def q_between_block(spark, sf):
    lines = S.from_documents(read(spark, sf, "pages"), "page_id", "html", "<").withColumn("text", F.replace("text", F.lit(">"), F.lit(" ")))
    blocks = O.between_blocks(lines, ["article"], ["/article", "footer"], F.lit(1 << 40))
    return blocks.groupBy(F.col("doc_id").alias("page_id"), "start_line").agg(F.count("*").alias("lines"), F.max("end_line").alias("end_line"), text_hash("line", "at"))


def q_block_to_frame_end(spark, sf):
    blocks = O.between_blocks(S.standardised(doc_lines(spark, sf)), ["the"], ["of", O.BLOCK_END], 5)
    return blocks.groupBy("doc_id", "start_line").agg(F.count("*").alias("lines"), F.max("end_line").alias("end_line"), text_hash("line", "at"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as lines, each after its role."""
    text = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("line_no"), text.alias("text"))


def q_split_block(spark, sf):
    parts = O.split_blocks(_turns(spark, sf), ["assistant"])
    return parts.groupBy(F.col("doc_id").alias("conv_id"), "part").agg(F.count("*").alias("lines"), text_hash())


def q_split_void_both(spark, sf):
    parts = O.split_blocks(_turns(spark, sf), ["assistant"])
    counts = parts.groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    return O.void_small_parts(parts, counts, 2).groupBy(F.col("doc_id").alias("conv_id"), "part").agg(F.count("*").alias("lines"), text_hash())


def _number_tokens(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "line_no", F.posexplode(F.split("text", " ", -1)).alias("word_no", "word")).filter(T.is_numeric(F.col("word")))


def q_number_tokens(spark, sf):
    return _number_tokens(doc_lines(spark, sf)).select("doc_id", "line_no", "word_no", T.to_number(F.col("word")).alias("value"))


def q_nearest_value(spark, sf):
    lines = doc_lines(spark, sf)
    anchors = lines.filter(T.label_matches(F.col("text"), F.lit("the"))).select("doc_id", "line_no")
    values = _number_tokens(lines).select("doc_id", F.col("line_no").alias("value_line"), F.col("word_no").alias("value_ord"), T.to_number(F.col("word")).alias("value"))
    return O.nearest(anchors, values)


def q_first_number(spark, sf):
    docs = doc_lines(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("lines"))
    as_lines = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["line_no"].alias("line_no")))
    got = docs.select("doc_id", F.get(F.filter(F.transform(as_lines, lambda x: F.struct(X.first_number(x["text"]).alias("v"), x["line_no"].alias("n"))), lambda x: x["v"].isNotNull()), F.lit(0)).alias("hit"))
    return got.filter("hit IS NOT NULL").select("doc_id", F.col("hit.n").alias("line_no"), F.col("hit.v").cast("double").alias("value"))


def q_year_lines(spark, sf):
    return doc_lines(spark, sf).filter(T.is_date_or_purpose(F.col("text"))).select("doc_id", "line_no")


def q_short_word_share(spark, sf):
    words = F.size(F.split("text", " ", -1))
    return doc_lines(spark, sf).select("doc_id", "line_no", T.short_words(F.col("text")).alias("short_words"), words.alias("words"))


def q_corrupted_lines(spark, sf):
    return doc_lines(spark, sf).filter(T.looks_corrupted(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("corrupted"), text_hash())


def q_removal_rules(spark, sf):
    rules = [("/[0-9]+/", False, False), ("The", False, False), ("Of", True, True)]
    return doc_lines(spark, sf).select("doc_id", "line_no", F.md5(O.remove(F.col("text"), rules)).alias("text_md5"))


def q_vocabulary_units(spark, sf):
    entries = F.array(*[F.lit(x) for x in ("tion of", "on", "the ")])
    hit = X.vocabulary(F.array(F.struct("text", F.col("line_no").alias("line_no"))), entries)
    out = doc_lines(spark, sf).select("doc_id", "line_no", F.get(hit, F.lit(0))["text"].alias("entry"))
    return out.filter("entry IS NOT NULL").groupBy("doc_id", "entry").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


def q_title_prefix_lines(spark, sf):
    text = F.col("c_name")
    rows = read(spark, sf, "customer").withColumn("c_name", F.concat(F.when(F.col("c_custkey") % 3 == 0, "Mr. ").otherwise(""), F.col("c_name"), F.when(F.col("c_custkey") % 5 == 0, " Farms Ltd").otherwise("")))
    return rows.select("c_custkey", T.starts_with_title(text).alias("titled"), T.ends_with_suffix(text).alias("suffixed"), F.coalesce(T.suffix_within(text), F.lit("")).alias("suffix"), T.ends_like_address(text).alias("address"))


def q_reading_order(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    # texts are dealt out before they become words, which have many times their bytes
    docs = docs.repartition(8 * docs.rdd.getNumPartitions(), "doc_id")
    words = (
        S.from_documents(docs).select("doc_id", "line_no", F.posexplode(F.split("text", " ", -1)).alias("w", "text"))
        .withColumns({"page_no": F.lit(1), "word_no": F.col("line_no").cast("long") * (1 << 31) + F.col("w")})
        .withColumns({"top": 1000 - F.col("line_no") * 12.5 - (F.col("w") % 2) * 1.0, "left": F.col("w") * 12.5})
    )
    out = S.reading_order(words, 500, 5, 25.0)
    return out.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("text") == "").alias("blanks"), F.sum(F.length("text")).alias("chars"), text_hash())


def q_round_even(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.round_to(F.col("l_quantity") * 2.5, 5).alias("rounded"))


def q_found_totals(spark, sf):
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return docs.agg(
        F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.contains("text", F.lit("License"))).alias("with_licence"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
    )


def q_period_pivot(spark, sf):
    kinds = ["click", "purchase", "view"]
    ev = read(spark, sf, "events")
    return ev.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.round(F.sum("value"), 4).alias("total"))


def q_first_per_group(spark, sf):
    first = R.firsts(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "ts"])
    return first.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("first_us"))


def q_last_per_group(spark, sf):
    last = R.firsts(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "ts"], last=True)
    return last.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"))


def q_unmatched_groups(spark, sf):
    return R.unmatched(read(spark, sf, "documents"), read(spark, sf, "labels"), ["doc_id"]).select("doc_id", "source")


def q_path_members(spark, sf):
    ev = read(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return ev.select("event_id", F.explode(P.members(F.col("props"))).alias("value"))


def q_path_filter(spark, sf):
    ev = read(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("items"))
    hit = P.where(F.col("items"), lambda x: x["event_type"] == "view")
    return ev.select(
        "user_id", F.size(hit).alias("views"), P.element(F.col("items"), -1)["event_id"].alias("last_id"),
        F.size(P.span(F.col("items"), 1, -1, 2)).alias("every_other"), F.size(P.union(F.col("items"), [0, 2])).alias("picked"),
    )


def q_text_dump(spark, sf):
    return R.text_dump(doc_lines(spark, sf)).select("doc_id", F.md5("dump").alias("dump_md5"))


def q_file_stem(spark, sf):
    url = F.regexp_replace("url", r"[?#].*$", "")
    return read(spark, sf, "pages").select("page_id", T.file_stem(F.concat(F.regexp_replace(url, "/$", ""), F.lit(".v1.html"))).alias("stem"))


def q_number_text(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.number_text(F.col("p_retailprice")).alias("text"), T.number_text(F.col("p_size").cast("double")).alias("size"))


def q_coalesced_lines(spark, sf):
    rows = doc_lines(spark, sf).filter(T.label_matches(F.col("text"), F.lit("the")))
    out = O.coalesced_lines(rows, ["doc_id"])
    return out.select("doc_id", "line_no", F.size("texts").alias("lines"), F.md5(F.array_join("texts", " ")).alias("text_md5"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM documents)"
TRIM = r"regexp_replace({0}, '^[\p{{P}}\p{{S}}\p{{Z}}\s]+|(?:[\p{{S}}\p{{Z}}\s]|[^\P{{P}})])+$', '', 'g')"
STD = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
for _a, _b in T.REWRITES:
    STD = f"replace({STD}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"
S_LINES = f"{LINES}, s AS (SELECT doc_id, line_no, {STD.format('text')} AS text FROM l)"
NUM = r"'^[+-]?(\d[\d,]*(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"
LABEL = "(starts_with(lower(text), '{0}') OR contains(lower(text), ' {0}'))"
HITS = "h AS (" + " UNION ALL ".join(f"SELECT doc_id, line_no, text, {i} AS label_id, '{x}' AS matched_text FROM s WHERE {LABEL.format(x)}" for i, x in enumerate(NOTICES)) + ")"
SUFFIX = "CASE " + " ".join(f"WHEN contains(lower(n), '{s}') THEN '{s}'" for s in L.NAME_SUFFIXES) + " ELSE '' END"
SHORT = ", ".join(f"'{w}'" for w in L.SHORT_WORDS)
TITLED = " OR ".join(f"starts_with(lower({{0}}), '{p}')" for p in L.NAME_PREFIXES)
SUFFIXED = " OR ".join(f"ends_with(lower({{0}}), '{p}')" for p in L.NAME_SUFFIXES)

PARTS = """t AS (SELECT conv_id, turn, role || ': ' || text AS text FROM conversations),
h AS (SELECT *, min(CASE WHEN starts_with(lower(text), 'assistant') OR contains(lower(text), ' assistant') THEN turn END) OVER (PARTITION BY conv_id) AS hit FROM t),
p AS (SELECT conv_id, turn, text, CASE WHEN hit IS NULL OR turn < hit - 1 THEN 1 ELSE 2 END AS part FROM h)"""

ORACLE = {
    "doc_lines": f"WITH {LINES} SELECT doc_id, line_no, text FROM l",
    "trim_formatting": f"WITH {LINES} SELECT doc_id, line_no, {TRIM.format('text')} AS text FROM l",
    "standardise": f"WITH {S_LINES} SELECT doc_id, line_no, text FROM s",
    "blank_predicate": r"""WITH l AS (SELECT page_id, unnest(string_split(html, '>')) AS t FROM pages)
SELECT page_id, count(*) FILTER (regexp_replace(t, '[\p{P}\p{Z}\s]', '', 'g') = '') AS blank_lines, count(*) AS lines FROM l GROUP BY page_id""",
    "collapse_blank": """WITH d AS (SELECT concat(conv_id, ':', turn) AS key, string_split(replace(text, ' ', chr(10) || chr(10)), chr(10)) AS p FROM conversations),
l AS (SELECT key, unnest(p) AS t, unnest(range(len(p))) AS n FROM d),
b AS (SELECT *, min(n) FILTER (trim(t) <> '') OVER (PARTITION BY key) AS a, max(n) FILTER (trim(t) <> '') OVER (PARTITION BY key) AS z FROM l),
c AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY n) AS p FROM b WHERE n BETWEEN a AND z)
SELECT key, count(*) AS lines, count(*) FILTER (t = '') AS empty_lines, md5(string_agg(t, chr(10) ORDER BY n)) AS text_md5 FROM c WHERE NOT (t = '' AND p IS NOT NULL AND p = '') GROUP BY key""",
    "label_hits": f"WITH {S_LINES}, {HITS} SELECT doc_id, line_no, label_id, matched_text FROM h",
    "first_notice_per_label": f"""WITH {S_LINES}, {HITS},
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label_id ORDER BY line_no) AS rn, instr(lower(text), matched_text) AS p FROM h)
SELECT doc_id, label_id, line_no, matched_text, nullif(trim({TRIM.format("substr(text, 1, p - 1)")}), '') AS before,
nullif(trim({TRIM.format("substr(text, p + length(matched_text))")}), '') AS after FROM f WHERE rn = 1""",
    "doc_prefilter": "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower({STD.format('replace(text, chr(10), chr(44))')}), '{x}')" for x in NOTICES),
    "context_window": f"""WITH {LINES}, c AS (SELECT doc_id, line_no,
list(text) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p,
list(text) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS f FROM l)
SELECT doc_id, line_no, md5(coalesce(array_to_string(list_reverse(p), '|'), '')) AS previous_md5, md5(coalesce(array_to_string(f, '|'), '')) AS following_md5 FROM c""",
    "between_block": """WITH l AS (SELECT page_id, unnest(string_split(html, '<')) AS t, unnest(range(len(string_split(html, '<'))))::INT AS n FROM pages),
b AS (SELECT page_id, n, replace(t, '>', ' ') AS t FROM l),
s AS (SELECT page_id, n, t FROM b WHERE starts_with(lower(t), 'article') OR contains(lower(t), ' article')),
r AS (SELECT s.page_id, s.n AS start_line, b.n AS pos, b.t AS line, min(CASE WHEN starts_with(lower(b.t), '/article') OR contains(lower(b.t), ' /article') OR starts_with(lower(b.t), 'footer') OR contains(lower(b.t), ' footer') THEN b.n END) OVER (PARTITION BY s.page_id, s.n) AS end_line
 FROM s JOIN b ON s.page_id = b.page_id AND b.n > s.n),
i AS (SELECT page_id, start_line, pos, end_line, line FROM r WHERE pos < end_line
 UNION ALL SELECT s.page_id, s.n, s.n, (SELECT max(end_line) FROM r WHERE r.page_id = s.page_id AND r.start_line = s.n), trim(""" + TRIM.format("substr(t, instr(lower(t), 'article') + 7)") + """) FROM s
 WHERE trim(""" + TRIM.format("substr(t, instr(lower(t), 'article') + 7)") + """) <> '')
SELECT page_id, start_line, count(*) AS lines, max(end_line) AS end_line, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM i WHERE end_line IS NOT NULL GROUP BY ALL""",
    "block_to_frame_end": f"""WITH {S_LINES}, h AS (SELECT * FROM s WHERE {LABEL.format('the')}),
r AS (SELECT h.doc_id, h.line_no AS start_line, s.line_no AS pos, s.text AS line, min(CASE WHEN starts_with(lower(s.text), 'of') OR contains(lower(s.text), ' of') THEN s.line_no END) OVER (PARTITION BY h.doc_id, h.line_no) AS end_line
 FROM h JOIN s ON s.doc_id = h.doc_id AND s.line_no > h.line_no AND s.line_no <= h.line_no + 5),
e AS (SELECT doc_id, start_line, max(end_line) AS end_line FROM r GROUP BY ALL),
i AS (SELECT doc_id, start_line, end_line, pos, line FROM r WHERE end_line IS NULL OR pos < end_line
 UNION ALL SELECT h.doc_id, h.line_no, e.end_line, h.line_no, trim({TRIM.format("substr(h.text, instr(lower(h.text), 'the') + 3)")}) FROM h LEFT JOIN e ON e.doc_id = h.doc_id AND e.start_line = h.line_no
 WHERE trim({TRIM.format("substr(h.text, instr(lower(h.text), 'the') + 3)")}) <> '')
SELECT doc_id, start_line, count(*) AS lines, max(end_line) AS end_line, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM i GROUP BY ALL""",
    "split_block": f"""WITH {PARTS} SELECT conv_id, part, count(*) AS lines, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM p GROUP BY ALL""",
    "split_void_both": f"""WITH {PARTS}, g AS (SELECT conv_id, part, count(*) AS lines, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM p GROUP BY ALL),
m AS (SELECT conv_id FROM g GROUP BY conv_id HAVING min(lines) >= 2)
SELECT conv_id, part, lines, text_md5 FROM g WHERE conv_id IN (SELECT conv_id FROM m)""",
    "number_tokens": f"""WITH {LINES}, w AS (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' '))))::INT AS word_no FROM l)
SELECT doc_id, line_no, word_no, replace(word, ',', '')::DOUBLE AS value FROM w WHERE regexp_matches(word, {NUM})""",
    "nearest_value": f"""WITH {LINES}, w AS (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS word_no FROM l),
v AS (SELECT doc_id, line_no AS value_line, word_no, replace(word, ',', '')::DOUBLE AS value FROM w WHERE regexp_matches(word, {NUM})),
j AS (SELECT l.doc_id, l.line_no, abs(value_line - l.line_no) AS gap, value_line, value,
 row_number() OVER (PARTITION BY l.doc_id, l.line_no ORDER BY abs(value_line - l.line_no), value_line, word_no) AS rn
 FROM l JOIN v ON v.doc_id = l.doc_id WHERE {LABEL.format('the').replace('text', 'l.text')})
SELECT doc_id, line_no, gap, value_line, value FROM j WHERE rn = 1""",
    "first_number": f"""WITH {LINES}, w AS (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS word_no FROM l),
v AS (SELECT doc_id, line_no, round(replace(word, ',', '')::DOUBLE, 10) AS value, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_no) AS rn FROM w WHERE regexp_matches(word, {NUM}))
SELECT doc_id, line_no, value FROM v WHERE rn = 1""",
    "year_lines": f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE contains(text, 'aggregate') OR regexp_matches(text, '19\\p{{Nd}}\\p{{Nd}}|20\\p{{Nd}}\\p{{Nd}}')",
    "short_word_share": f"""WITH {LINES} SELECT doc_id, line_no, len(list_filter(string_split(text, ' '), lambda w: length(w) <= 2 AND NOT regexp_matches(w, '\\p{{Nd}}') AND lower(w) NOT IN ({SHORT})))::INT AS short_words,
len(string_split(text, ' '))::INT AS words FROM l""",
    "corrupted_lines": f"""WITH {LINES}, c AS (SELECT *, len(list_filter(string_split(text, ' '), lambda w: length(w) <= 2 AND NOT regexp_matches(w, '\\p{{Nd}}') AND lower(w) NOT IN ({SHORT}))) AS k, len(string_split(text, ' ')) AS n FROM l)
SELECT doc_id, count(*) AS corrupted, md5(string_agg(text, chr(10) ORDER BY line_no)) AS text_md5 FROM c WHERE CASE WHEN text = '' THEN false
WHEN length(text) < 8 AND regexp_matches(text, '[a-zA-Z][0-9][a-zA-Z]') THEN true
WHEN regexp_matches(text, '^\\p{{Ll}}') AND regexp_matches(regexp_replace(text, '[ /.(),"*-]', '', 'g'), '[^\\p{{L}}\\p{{Nd}}]') THEN true
WHEN {TITLED.format('text')} OR {SUFFIXED.format('text')} THEN false ELSE k > 3 AND k * 100.0 / n >= 20 END GROUP BY doc_id""",
    "removal_rules": f"""WITH {LINES}, a AS (SELECT doc_id, line_no, regexp_replace(text, '[0-9]+', '', 'g') AS t FROM l),
b AS (SELECT doc_id, line_no, CASE WHEN contains(t, 'The') THEN regexp_replace(t, 'The', '', 'gi') ELSE t END AS t FROM a)
SELECT doc_id, line_no, md5({TRIM.format("CASE WHEN starts_with(t, 'Of') THEN '' ELSE t END")}) AS text_md5 FROM b""",
    "vocabulary_units": f"""WITH {LINES}, e AS (SELECT doc_id, line_no, CASE WHEN contains(lower(text), 'tion of') THEN 'tion of' WHEN contains(lower(text), 'on') THEN 'on' WHEN contains(lower(text), 'the ') THEN 'the ' END AS entry FROM l)
SELECT doc_id, entry, count(*) AS lines, min(line_no) AS first_line FROM e WHERE entry IS NOT NULL GROUP BY ALL""",
    "title_prefix_lines": f"""WITH c AS (SELECT c_custkey, concat(CASE WHEN c_custkey % 3 = 0 THEN 'Mr. ' ELSE '' END, c_name, CASE WHEN c_custkey % 5 = 0 THEN ' Farms Ltd' ELSE '' END) AS n FROM customer)
SELECT c_custkey, {TITLED.format('n')} AS titled, {SUFFIXED.format('n')} AS suffixed, {SUFFIX} AS suffix, regexp_matches(n, '\\p{{Nd}}$') AS address FROM c""",
    "reading_order": f"""WITH {LINES}, w AS (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS t, unnest(range(len(string_split(text, ' ')))) AS w FROM l),
p AS (SELECT doc_id, line_no::BIGINT * (1::BIGINT << 31) + w AS word_no, t, 1000 - line_no * 12.5 - (w % 2) * 1.0 AS top, w * 12.5 AS lft FROM w),
r AS (SELECT *, round_even(top::DOUBLE / 5, 0)::INT * 5 AS ry, round_even(lft::DOUBLE / 500, 0)::INT AS rx FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ry DESC, lft, word_no) AS ord FROM r),
g AS (SELECT doc_id, ry, rx, min(ord) AS ord, string_agg(t, ' ' ORDER BY ord) AS text, arg_min(top, ord) AS top FROM o GROUP BY ALL),
s AS (SELECT *, lag(top) OVER (PARTITION BY doc_id ORDER BY ord) - top AS gap FROM g)
SELECT doc_id, count(*) + count(*) FILTER (gap >= 25) AS lines, count(*) FILTER (text = '') + count(*) FILTER (gap >= 25) AS blanks, sum(length(text))::BIGINT AS chars,
md5(string_agg(CASE WHEN gap >= 25 THEN chr(10) ELSE '' END || text, chr(10) ORDER BY ord)) AS text_md5 FROM s GROUP BY doc_id""",
    "round_even": "SELECT l_orderkey, l_linenumber, round_even(l_quantity * 2.5 / 5, 0)::INT * 5 AS rounded FROM lineitem",
    "found_totals": """SELECT count(*) AS documents, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good,
count(*) FILTER (contains(text, 'License')) AS with_licence, round(avg(n_chars), 6) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id)""",
    "period_pivot": """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
count(*) FILTER (event_type = 'view') AS "view", round(sum(value), 4) AS total FROM events GROUP BY user_id""",
    "first_per_group": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, epoch_us(min(ts)) AS first_us FROM events GROUP BY user_id",
    "last_per_group": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id",
    "unmatched_groups": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "path_members": "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "path_filter": """SELECT user_id, count(*) FILTER (event_type = 'view')::INT AS views, max(event_id) AS last_id,
(CASE WHEN count(*) > 2 THEN (count(*) - 1) // 2 ELSE 0 END)::INT AS every_other, (1 + (count(*) > 2)::INT)::INT AS picked FROM events GROUP BY user_id""",
    "text_dump": f"WITH {LINES} SELECT doc_id, md5(string_agg(line_no || ' ' || text, chr(13) || chr(10) ORDER BY line_no)) AS dump_md5 FROM l GROUP BY doc_id",
    "file_stem": r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') || '.v1.html' AS u FROM pages),
s AS (SELECT page_id, string_split(string_split(u, '/')[-1], '.') AS p FROM u)
SELECT page_id, array_to_string(p[1:len(p) - 1], '-') AS stem FROM s""",
    "number_text": r"""SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE regexp_replace(p_retailprice::DECIMAL(38,10)::VARCHAR, '\.?0+$', '') END AS text, p_size::VARCHAR AS size FROM part""",
    "coalesced_lines": f"WITH {LINES} SELECT doc_id, min(line_no) AS line_no, count(*)::INT AS lines, md5(string_agg(text, ' ' ORDER BY line_no)) AS text_md5 FROM l WHERE {LABEL.format('the')} GROUP BY doc_id",
}
