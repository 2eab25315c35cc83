"""Line tables: the rows that every matching operator works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.text import is_blank, round_to, standardise


def from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """``doc_id``, ``line_no`` (0-based), ``text``: a narrow explode without a shuffle."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), separator, -1)).alias("line_no", "text")
    )


def standardised(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", standardise(F.col("text")))


def read_page_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached layout pages ``page-N.json`` as words: path, page, block, line, word ordinals, text
    and box. Missing pages are tolerated, empty pages give no rows."""
    point = "struct<X: double, Y: double>"
    rect = f"struct<BottomLeft: {point}, TopRight: {point}>"
    letter = f"struct<Value: string, GlyphRectangle: {rect}>"
    schema = f"TextLines array<struct<Words: array<struct<Letters: array<{letter}>>>>>"
    pages = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("path", F.input_file_name())
    page = F.regexp_extract("path", r"page-(\d+)\.json", 1).cast("int")
    box = lambda f, corner, axis: f(F.transform("word.Letters", lambda x: x["GlyphRectangle"][corner][axis]))
    return (
        pages.select("path", page.alias("page_no"), F.monotonically_increasing_id().alias("block"), F.posexplode("TextLines").alias("line", "l"))
        .select("path", "page_no", "block", "line", F.posexplode("l.Words").alias("word_no", "word"))
        .select(
            "path", "page_no", "block", "line", "word_no", F.array_join(F.transform("word.Letters", lambda x: x["Value"]), "").alias("text"),
            box(F.array_max, "TopRight", "Y").alias("top"), box(F.array_min, "BottomLeft", "X").alias("left"),
        )
    )


def read_licence_map(spark: SparkSession, path: str) -> DataFrame:
    """``licence_number`` -> ``filename`` (last path segment); of several rows the last wins, of
    several files the last by name. The first line of a file is its header; rows without a
    number, such as a blank last line, are dropped.

    A file is read in parts by many tasks: rows are ordered by file, offset of their part and
    place in it, and maxima of that order fold before the one shuffle, by number."""
    # a separator that no line holds: whole lines, with the header left out by the reader
    rows = spark.read.schema("line string").option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    parts = F.split("line", ",", -1)
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return (
        rows.select(order.alias("row"), "line").filter(F.size(parts) > 1)
        .select("row", F.element_at(F.split(parts[0], "/"), -1).alias("filename"), parts[1].alias("licence_number"))
        .groupBy("licence_number").agg(F.max_by("filename", "row").alias("filename"))
    )


def read_first_names(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case first names without stop words and names of one or two letters."""
    from marlstone.functions.wordlists import FIRST_NAME_STOPS

    name = F.lower(F.trim("FirstForename"))
    return (
        spark.read.option("header", True).csv(path).select(name.alias("name"))
        .filter((F.length("name") > 2) & ~F.col("name").isin(*FIRST_NAME_STOPS)).distinct()
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, lower-cased."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def reading_order(words: DataFrame, horizontal: Column | int = 500, step: int = 5, gap: float = 25.0) -> DataFrame:
    """Words with boxes (``doc_id``, ``page_no``, ``word_no``, ``text``, ``top``, ``left``) to
    lines in reading order: words whose tops and lefts round to the same steps are one line, in
    the order in which the lines appear; a blank line precedes a vertical gap of ``gap``."""
    page = W.partitionBy("doc_id", "page_no")
    placed = words.withColumns(
        {"_ry": round_to(F.col("top"), step), "_rx": F.rint(F.col("left") / horizontal).cast("int")}
    ).withColumn("_ord", F.row_number().over(page.orderBy(F.desc("_ry"), "left", "word_no")))
    merged = placed.groupBy("doc_id", "page_no", "_ry", "_rx").agg(
        F.min("_ord").alias("_ord"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_ord", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min_by("top", "_ord").alias("top"),
    )
    spaced = merged.withColumn("_gap", F.lag("top").over(page.orderBy("_ord")) - F.col("top"))
    rows = spaced.select(
        "doc_id", "page_no", "_ord", F.posexplode(F.when(F.col("_gap") >= gap, F.array(F.lit(""), "text")).otherwise(F.array("text"))).alias("_part", "text")
    )
    doc = W.partitionBy("doc_id").orderBy("page_no", "_ord", "_part")
    return rows.select("doc_id", "page_no", (F.row_number().over(doc) - 1).alias("line_no"), "text")


def ocr_lines(lines: DataFrame) -> DataFrame:
    """OCR lines (``doc_id``, ``page_no``, ``image_no``, ``ord``, ``text``) without blank ones,
    standardised and numbered from 0 in each image."""
    at = W.partitionBy("doc_id", "page_no", "image_no").orderBy("ord")
    return (
        lines.filter(~is_blank(F.col("text"))).withColumn("text", standardise(F.col("text")))
        .withColumn("line_no", F.row_number().over(at) - 1)
    )


def cloud_order(lines: DataFrame, step: int = 40) -> DataFrame:
    """OCR lines with a box corner (``x``, ``y``) in the order of rounded rows, then columns."""
    at = W.partitionBy("doc_id", "page_no", "image_no").orderBy(round_to(F.col("y"), step), "x", "ord")
    return lines.withColumn("ord", F.row_number().over(at) - 1)


def word_confidence(words: Column) -> Column:
    """Mean confidence of an array of words, without those that have none; null if none has."""
    known = F.filter(F.transform(words, lambda w: w["conf"]), lambda c: c.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known))


def staged_sources(lines: DataFrame, found: DataFrame, groups: list[str], costlier: DataFrame) -> DataFrame:
    """Lines of the next source for documents whose groups are not all found yet: wanted
    (document, group) pairs that are not in ``found``, then a semi join into ``costlier``."""
    wanted = lines.select("doc_id").distinct().withColumn("group", F.explode(F.array(*map(F.lit, groups))))
    missing = wanted.join(found.select("doc_id", "group"), ["doc_id", "group"], "left_anti")
    return costlier.join(missing.select("doc_id").distinct(), "doc_id", "left_semi")
