"""First names of a list in documents: an equi join on the first word of a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.stages import settled

NAME_LETTERS = r"[\p{L}\p{M}'\u2019.-]+"


def persons(docs: DataFrame, first_names: DataFrame, spelling: DataFrame | None = None) -> DataFrame:
    """``doc_id`` and ``persons``, the names, in lower case, whose first word stands in the lines of
    a document (``doc_id``, ``lines``) or, with a ``spelling`` (``doc_id``, ``spelling``), in what its words
    are corrected to. Whether the whole name begins a line is for the test of the line to say, so
    the array may hold more than that, and is as long as the document has such words.

    A word counts as it stands, without the marks at either end, and as each run of letters in
    it. ``first_names`` (``name``) may be of any length: it is written once, so that Spark sees its
    size and broadcasts it or not; of documents only distinct words are shuffled. Null and blank
    names are no names; documents without any have no row."""
    name = F.lower(F.trim("name"))
    names = settled(
        first_names.select(name.alias("name")).filter("name <> ''").distinct().withColumn("word", F.element_at(F.split("name", " "), 1))
    )
    def read(text):
        marked = F.transform(F.split(text, " ", -1), lambda w: F.array(w, T.trim_formatting(w)))
        return F.concat(F.flatten(marked), F.regexp_extract_all(text, F.lit(NAME_LETTERS), F.lit(0)))

    # words of a document meet in its row, so that they need no shuffle to be distinct
    low = F.filter(F.transform("lines", lambda x: F.lower(x["text"])), lambda t: t != "")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform(low, read)))).alias("word"))
    if spelling is not None:
        fixed = F.concat(F.coalesce("spelling.joined", F.array()), F.coalesce(F.map_values("spelling.better"), F.array()))
        words = words.union(spelling.select("doc_id", F.explode(fixed).alias("word")))
    return words.join(names, "word").groupBy("doc_id").agg(F.collect_set("name").alias("persons"))
