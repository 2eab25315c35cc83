"""Correction of OCR words against a lexicon: equi joins on words and on their deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.wordlists import PREFERRED_SPELLINGS
from marlstone.operators.stages import settled


def words_of(lines: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``pos``, ``word`` of lines, words between single blanks."""
    return lines.select("doc_id", "line_no", F.posexplode(F.split("text", " ", -1)).alias("pos", "word")).filter("word <> ''")


def unknown(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words, in lower case, that the lexicon (``word``) lacks, each once with its count."""
    low = words.select(F.lower("word").alias("word")).filter(F.col("word").rlike(r"\p{L}"))
    return low.groupBy("word").agg(F.count("*").alias("n")).join(lexicon, "word", "left_anti")


def deletions(word: Column) -> Column:
    """The word and all that are left of it without one character."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.array_distinct(F.concat(F.array(word), F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def suggestions(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word`` -> ``suggestion`` for unknown words: one edit or a swap of neighbours away, words
    of the preferred list first, then the nearest, then the first by alphabet. Words that share
    a deletion meet in an equi join, so there is no pass over word pairs."""
    left = words.select("word").distinct().withColumn("_key", F.explode(deletions(F.col("word"))))
    right = lexicon.select(F.col("word").alias("suggestion")).withColumn("_key", F.explode(deletions(F.col("suggestion"))))
    liked = F.col("suggestion").isin(*[w.lower() for w in PREFERRED_SPELLINGS])
    near = F.levenshtein("word", "suggestion")
    letters = lambda c: F.array_sort(F.split(c, ""))
    swap = letters("word") == letters("suggestion")
    return (
        left.join(right, "_key").filter((near == 1) | (near == 2) & swap)
        .groupBy("word").agg(F.min(F.struct((~liked).alias("a"), near.alias("b"), "suggestion"))["suggestion"].alias("suggestion"))
    )


def spellings(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc_id`` and its ``spelling`` (:data:`marlstone.functions.text.SPELLING`) for documents
    (``doc_id``, ``lines``) that have a word which the lexicon (``word``) lacks, or two neighbours that
    are a word together. Words without a letter are none. A word is looked up as it stands and
    without the marks at either end. Distinct words of a document are shuffled, not its lines; the
    lexicon is joined, never collected."""
    known = lexicon.select(F.lower("word").alias("word")).distinct()
    lines = docs.select("doc_id", F.explode("lines.text").alias("text")).filter("text <> ''").withColumn("words", F.split("text", " ", -1))
    bare = lambda w: F.array(w, T.trim_formatting(w), F.regexp_replace(w, T.LEADING, ""), F.regexp_replace(w, T.TRAILING, ""))
    words = lines.select("doc_id", F.explode(F.flatten(F.transform("words", bare))).alias("word"))
    words = words.select("doc_id", F.lower("word").alias("word")).filter(F.col("word").rlike(r"\p{L}")).distinct()
    odd = settled(words.join(known, "word", "left_anti"))
    better = suggestions(odd, known)
    pairs = F.transform("words", lambda w, i: F.concat(w, F.coalesce(F.get("words", i + 1), F.lit(""))))
    joined = lines.select("doc_id", F.explode(pairs).alias("word")).select("doc_id", F.lower("word").alias("word")).distinct().join(known, "word", "left_semi")
    fix = F.when(F.col("suggestion").isNotNull(), F.struct("word", "suggestion"))
    left = odd.join(better, "word", "left").groupBy("doc_id").agg(F.collect_set("word").alias("odd"), F.map_from_entries(F.collect_set(fix)).alias("better"))
    right = joined.groupBy("doc_id").agg(F.collect_set("word").alias("joined"))
    return left.join(right, "doc_id", "left").select("doc_id", F.struct("odd", "joined", "better").cast(T.SPELLING).alias("spelling"))


def corrected(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """OCR lines (``doc_id``, ``line_no``, ``text``) with corrected words.

    Lines that begin with a personal or institutional prefix stay. In the others a word that the
    lexicon lacks is joined to the next one where that makes a known word; initials, ``esq``,
    single characters and words with two dots stay; the rest take their suggestion, unless it
    differs by a plural ``s`` alone. Lines are put together again by one shuffle."""
    lexicon = lexicon.select("word").distinct()
    named = T.starts_with_title(F.col("text"))
    rows = words_of(lines.filter(~named).withColumn("text", T.standardise(F.col("text"))))
    line = W.partitionBy("doc_id", "line_no").orderBy("pos")
    rows = rows.withColumns({"_low": F.lower("word"), "_pair": F.lower(F.concat("word", F.lead("word").over(line))), "_n": F.count("*").over(W.partitionBy("doc_id", "line_no"))})
    known = lexicon.withColumn("_known", F.lit(True))
    rows = rows.join(known.select(F.col("word").alias("_low"), "_known"), "_low", "left")
    rows = rows.join(known.select(F.col("word").alias("_pair"), F.col("_known").alias("_joins")), "_pair", "left")
    fixed = (
        (F.col("_low") == "esq") | (F.col("_n") >= 2) & F.col("word").rlike(r"^\p{Lu}{2}$") | (F.length("word") <= 1)
        | (F.length("word") - F.length(F.replace("word", F.lit("."), F.lit(""))) >= 2) | ~F.col("word").rlike(r"\p{L}")
    )
    flag = F.coalesce("_joins", F.lit(False)) & F.col("_known").isNull() & ~fixed
    last = F.max(F.when(~F.col("_flag"), F.col("_at"))).over(line.rowsBetween(W.unboundedPreceding, -1))
    # of a run of words that could each be joined to the next, every second one is taken up
    rows = rows.withColumns({"_flag": flag, "_at": F.row_number().over(line)})
    rows = rows.withColumn("_takes", F.col("_flag") & ((F.col("_at") - F.coalesce(last, F.lit(0)) - 1) % 2 == 0))
    rows = rows.withColumn("_gone", F.coalesce(F.lag("_takes").over(line), F.lit(False))).withColumn("_next", F.lead("word").over(line)).filter("NOT _gone")
    wrong = rows.filter(F.col("_known").isNull() & ~fixed & ~F.col("_takes"))
    better = suggestions(wrong.select(F.col("_low").alias("word")), lexicon).withColumnRenamed("word", "_low")
    plural = (F.concat("_low", F.lit("s")) == F.col("suggestion")) | (F.concat("suggestion", F.lit("s")) == F.col("_low"))
    shaped = F.when(F.col("word").rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("suggestion", 1, 1)), F.substring("suggestion", 2, 100))).otherwise(F.col("suggestion"))
    word = (
        F.when(F.col("_takes"), F.concat("word", "_next")).when(F.col("_known").isNotNull() | fixed | F.col("suggestion").isNull() | plural, F.col("word")).otherwise(shaped)
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_word"))), lambda x: x["_word"]), " ")
    made = rows.join(better, "_low", "left").withColumn("_word", word).groupBy("doc_id", "line_no").agg(text.alias("_text"))
    return lines.join(made, ["doc_id", "line_no"], "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")
