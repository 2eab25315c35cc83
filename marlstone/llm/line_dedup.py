"""Line dedup by distinct-site spread.

HyperLogLog sketches of the sites of each line merge by aggregation. Lines whose estimate is
near the threshold get exact distinct counts. A line on enough sites is boilerplate: it stays
where it comes first (smallest id, then position) and goes everywhere else, so that a document
copied to many sites survives once, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import join_split, table
from marlstone.operators.stages import settled

#: Sites from which a line counts as boilerplate.
SITES = 10
#: log2 of the sketches' registers: a standard error of 1.6 per cent.
SKETCH_BITS = 12
#: Estimates within this share of the threshold, nine standard errors, are counted exactly.
BAND = 0.15
LINE = ["h1", "h2"]


def rows_with_keys(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """The rows as a struct ``row``, whose names cannot clash with those beside it: ``doc`` (id
    and a hash of the text, never null as a whole), ``site`` and the ``lines`` of the text."""
    text = F.col(text_col)
    return docs.select(
        F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("key")).alias("doc"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"),
    )


def shown_lines(rows: DataFrame) -> DataFrame:
    """``doc``, ``site``, ``pos`` and the 128-bit hash (``h1``, ``h2``) of lines that are not blank."""
    line = F.trim("line")
    return rows.select("doc", "site", F.posexplode("lines").alias("pos", "line")).filter(line != "").select(
        "doc", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(17), line).alias("h2")
    )


def boilerplate_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes of lines on at least ``sites`` sites, with ``first`` (document and position) and
    ``n``, how often the line occurs."""
    spread = settled(
        lines.groupBy(*LINE)
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("est"), F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n"))
        .filter(F.col("est") >= sites * (1 - BAND))
    )
    near = spread.filter(F.col("est") <= sites * (1 + BAND))
    exact = (
        join_split(lines, near.select(*LINE, "n"), LINE, "n").groupBy(*LINE, "site").agg(F.lit(1))
        .groupBy(*LINE).count().filter(F.col("count") >= sites).select(*LINE)
    )
    return settled(spread.filter(F.col("est") > sites * (1 + BAND)).union(near.join(exact, LINE, "left_semi").select(spread.columns)).drop("est"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and ``n_lines`` and ``n_removed``.

    Lines end at line feeds and are compared without blanks at their ends; blank lines are never
    removed. A null site is one site of its own, the empty one. Null text stays null and counts
    as one blank line. Rows that repeat an id, or have none, are told apart by their text; equal
    rows lose the same lines. Texts of any length are handled; an empty table gives no rows; other
    columns are kept as they are, whatever their names (``n_lines`` and ``n_removed`` are replaced).

    Lines meet the boilerplate in a join in which the most frequent lines, fewer than a fixed
    number, are broadcast; only removed positions are gathered by document."""
    rows = rows_with_keys(docs, id_col, text_col, site_col)
    lines = shown_lines(rows)
    bad = boilerplate_lines(lines, sites)
    removed = join_split(lines.drop("site"), bad, LINE, "n").filter(F.struct("doc", "pos") != F.col("first"))
    per_doc = removed.groupBy("doc").agg(F.collect_set("pos").alias("gone"))
    # lines are cut again after the join, which moves each text once
    lines = F.split(F.coalesce(F.col("row")[text_col], F.lit("")), "\n", -1)
    out = rows.drop("lines", "site").join(per_doc, "doc", "left").select("row", "gone", lines.alias("lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(kept)
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    made = F.struct(text.alias("text"), F.size("lines").cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
    same = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed", text_col)]
    return out.select("row", made.alias("made")).select(*same, F.col("made.text").alias(text_col), "made.n_lines", "made.n_removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLE = {
    "op8_line_dedup": f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
s AS (
  SELECT trim(line) AS k, count(DISTINCT coalesce(source, '')) AS n, min(doc_id) AS d
  FROM l WHERE trim(line) <> '' GROUP BY 1),
f AS (SELECT s.k, s.d, min(l.pos) AS p FROM s JOIN l ON trim(l.line) = s.k AND l.doc_id = s.d WHERE s.n >= {SITES} GROUP BY 1, 2),
m AS (
  SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND NOT (l.doc_id = f.d AND l.pos = f.p) AS gone
  FROM l LEFT JOIN f ON trim(l.line) = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM m GROUP BY doc_id"""
}
