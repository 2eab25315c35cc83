"""Corpus pipeline: language ID, quality, line dedup, near-dedup and packing of ``documents``.

Each stage works on all that its predecessor kept; each result is written as Parquet and read
again as the next one's input. All but the last return the columns of ``documents``.

Language and quality decide row by row, in place. Nulls: a text that is null or has no letter is
rejected as ``und`` by the first stage; a null source or language is a group of its own; rows
without a doc_id are rows like others. For the near-dedup stage a document is a doc_id with its
text: of rows equal in both one stays, and different texts under one doc_id are documents of
their own. Empty tables give empty results at every stage. Columns that ``documents`` has
besides its own are carried along up to packing, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import default_vocabulary
from marlstone.llm.common import table
from marlstone.llm.language_id import held_out, predicted, train
from marlstone.llm.line_dedup import line_dedup
from marlstone.llm.minhash import near_dedup
from marlstone.llm.packing import pack_documents
from marlstone.llm.quality import scored_rows
from marlstone.operators.stages import drop_stage, stage_dir

#: An ambiguous language below this score is rejected as no language.
LEAST_LANGUAGE_SCORE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose codeword fits no language."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    rows = docs.select(F.struct("*").alias("row"), predicted(F.col("text"), model).alias("p"))
    good = (F.col("p.lang_pred") != "und") & ~(F.col("p.ambiguous") & (F.col("p.score") < LEAST_LANGUAGE_SCORE))
    return rows.filter(good).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low posterior quality."""
    return scored_rows(docs, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines; a document of nothing else goes."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "source")])
    rows = docs.select(rest.alias("row"), F.struct("doc_id", F.xxhash64("text")).alias("key"), "text", "source")
    out = line_dedup(rows, "key").filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    made = {"text": F.col("text"), "source": F.col("source"), "n_chars": length}
    return out.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, similarity 0.8)."""
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64("text")).alias("key"), "text")
    kept = near_dedup(rows, "key").filter("kept").select("key")
    return rows.drop("text").join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 tokens."""
    return pack_documents(docs, default_vocabulary())


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("minhash", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained stages nor the tokens; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    base = f"{stage_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        docs._stage_path = f"{base}/{name}"
        if last is not None:
            drop_stage(last)
        last = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
