"""Exact dedup: 128-bit content hash, smallest id kept, bytes compared inside hash groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

#: Runs of these are one space when texts are compared.
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are grouped by ``hash_fn`` (128 bits) of the normalised text together with the text's
    bytes, so texts that only share a hash stay apart; partial aggregation folds a hot group
    inside each map task before the shuffle. Rows find their class again by (hash, sha256),
    a plain sort-merge join that AQE may split where one class holds much of the table.

    Null text counts as empty; rows of one text stay one class whatever their other columns;
    rows that repeat an id are one row each, and all rows with the smallest id of a class are
    kept. An empty table gives no rows; other columns are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text")).withColumns(
        {"_hash": hash_fn(F.col("_text")), "_sha": F.sha2("_text", 256)}
    )
    classes = (
        rows.groupBy("_hash", "_text")
        .agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_hash", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )
    return rows.select("_id", "_hash", "_sha").join(classes, ["_hash", "_sha"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_id") == F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op5_exact_dedup": """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
}
