"""Set-based operators over ordered lines: label hits, context windows, blocks, splits,
nearest values, removal rules and multiplicity. Each partitions on the document (or segment)
once; every "first" has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T

BLOCK_START, BLOCK_END = "[START_OF_BLOCK]", "[END_OF_BLOCK]"


def first_label(line: Column, labels: Sequence[str]) -> Column:
    """The first of fixed label texts, in their order, that the line matches; else null. A
    catalogue is known when the plan is made, so this is one expression and no join."""
    return F.coalesce(*[F.when(T.label_matches(line, F.lit(x)), F.lit(x)) for x in labels])


def label_hits(lines: DataFrame, labels: Sequence[Sequence[str]]) -> DataFrame:
    """Lines with the number of each label of which they match a text, and the first such text.

    The catalogue is part of the plan: a narrow explode of the labels that a line matches,
    without join or shuffle."""
    made = [F.struct(F.lit(i).alias("label_id"), first_label(F.col("text"), texts).alias("matched_text")) for i, texts in enumerate(labels)]
    hit = F.explode(F.filter(F.array(*made), lambda x: x["matched_text"].isNotNull()))
    return lines.withColumn("_hit", hit).select(*lines.columns, "_hit.label_id", "_hit.matched_text")


def documents_with(docs: DataFrame, text: str, labels: Sequence[str]) -> DataFrame:
    """Documents whose standardised text holds a label text anywhere (no word start needed)."""
    flat = F.lower(T.standardise(F.replace(F.col(text), F.lit("\n"), F.lit(","))))
    hit = F.lit(False)
    for x in labels:
        hit = hit | F.contains(flat, F.lit(x.lower()))
    return docs.filter(hit)


def fragments(hits: DataFrame) -> DataFrame:
    """Text before and after the matched label on its line, null where there is none."""
    before, after = T.text_before(F.col("text"), F.col("matched_text")), T.text_after(F.col("text"), F.col("matched_text"))
    return hits.withColumns({"before": F.nullif(before, F.lit("")), "after": F.nullif(after, F.lit(""))})


def first_per_label(hits: DataFrame, keys: Sequence[str] = ("doc_id", "label_id")) -> DataFrame:
    """The first hit in line order of each document and label."""
    at = W.partitionBy(*keys).orderBy("line_no")
    return hits.withColumn("_rn", F.row_number().over(at)).filter("_rn = 1").drop("_rn")


def context(lines: DataFrame, before: int, after: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each line with its previous lines, nearest first, and its next lines. For short frames;
    long ones join hits with lines by range (:func:`lines_after`)."""
    at = W.partitionBy(*keys).orderBy("line_no")
    cell = F.struct("line_no", "text")
    return lines.withColumns(
        {
            "previous": F.reverse(F.collect_list(cell).over(at.rowsBetween(-before, -1))),
            "following": F.collect_list(cell).over(at.rowsBetween(1, after)),
        }
    )


def between_blocks(
    lines: DataFrame, start: Sequence[str], end: Sequence[str], frame: Column | int, must_contain: Sequence[str] = (), keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """A block for each line that matches a start text: from what follows the text on its line
    to the line before the first end text, or to the end of the frame where ``end`` lists
    BLOCK_END. One row per block line: keys, ``start_line``, ``end_line`` (null at the frame's
    end), ``at``, ``line``. ``frame`` may use ``line_no`` and ``text`` of the start.

    Lines are cut into sections, each beginning with an end line, by a running count; a block
    lies in the section of its start. Windows and sections share one shuffle by document, so the
    work is that of the lines and of the blocks that come out."""
    real_ends = [x for x in end if x != BLOCK_END]
    ended = first_label(F.col("text"), real_ends).isNotNull() if real_ends else F.lit(False)
    doc, far = W.partitionBy(*keys).orderBy("line_no"), W.partitionBy(*keys).orderBy(F.desc("line_no"))
    matched = first_label(F.col("text"), [x for x in start if x != BLOCK_START])
    if BLOCK_START in start:
        matched = F.coalesce(matched, F.when(F.row_number().over(doc) == 1, F.lit(BLOCK_START)))
    rows = lines.select(*keys, "line_no", "text", ended.alias("_ends")).withColumns(
        {
            "matched_text": matched,
            "_part": F.sum(F.col("_ends").cast("int")).over(doc.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "_next": F.last(F.when(F.col("_ends"), F.col("line_no")), True).over(far.rowsBetween(W.unboundedPreceding, -1)),
        }
    )
    every = F.sort_array(F.collect_list(F.struct("line_no", "text", "matched_text")))
    parts = rows.groupBy(*keys, "_part").agg(every.alias("_lines"), F.max("_next").alias("_next"))
    starts = (
        parts.withColumn("s", F.explode(F.filter("_lines", lambda x: x["matched_text"].isNotNull())))
        .select(*keys, "_lines", "_next", "s.*").withColumn("_last", F.col("line_no") + frame)
    )
    after = F.when(F.col("matched_text") == BLOCK_START, F.col("text")).otherwise(T.text_after(F.col("text"), F.col("matched_text")))
    head = F.when(after != "", F.array(F.struct(F.col("line_no").alias("at"), after.alias("line"))))
    inside = F.filter("_lines", lambda x: (x["line_no"] > F.col("line_no")) & (x["line_no"] <= F.col("_last")))
    body = F.transform(inside, lambda x: F.struct(x["line_no"].alias("at"), x["text"].alias("line")))
    out = starts.select(
        *keys, F.col("line_no").alias("start_line"), F.when(F.col("_next") <= F.col("_last"), F.col("_next")).alias("end_line"),
        F.when(head.isNull(), body).otherwise(F.concat(head, body)).alias("_block"),
    )
    if BLOCK_END not in end:
        out = out.filter("end_line IS NOT NULL")
    if must_contain:
        wanted = F.array(*[F.lit(x.lower()) for x in must_contain])
        out = out.filter(F.exists("_block", lambda x: F.exists(wanted, lambda w: F.contains(F.lower(x["line"]), w))))
    return out.withColumn("b", F.explode("_block")).select(*keys, "start_line", "end_line", "b.at", "b.line")


def split_blocks(lines: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``part`` 1 or 2 of each line: the second part begins with the line before the first label
    line; without a label line everything is part 1."""
    seg = W.partitionBy(*keys)
    hit = F.min(F.when(first_label(F.col("text"), labels).isNotNull(), F.col("line_no"))).over(seg)
    return lines.withColumn("part", F.when(hit.isNull() | (F.col("line_no") < hit - 1), 1).otherwise(2))


def void_small_parts(parts: DataFrame, counts: DataFrame, least: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Parts of segments of which every part has at least ``least`` matches: one part below
    voids both. ``counts`` has the keys, ``part`` and ``n``."""
    worst = (
        parts.select(*keys, "part").distinct().join(counts, [*keys, "part"], "left")
        .groupBy(*keys).agg(F.min(F.coalesce("n", F.lit(0))).alias("_least")).filter(F.col("_least") >= least)
    )
    return parts.join(worst.select(*keys), list(keys), "left_semi")


def nearest(anchors: DataFrame, values: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each anchor line the value of the nearest line, the upper one of two as near, then
    the first on its line. ``values`` has the keys, ``value_line``, ``value_ord``, ``value``.

    Anchors and values meet in one shuffle by document; the last value up to an anchor, downwards
    and upwards, comes from two running windows, so no anchor meets every value."""
    found = F.struct("value_line", "value_ord", "value")
    left = anchors.select(*keys, F.col("line_no").alias("_at"), F.lit(1).alias("_anchor"))
    right = values.select(*keys, F.col("value_line").alias("_at"), F.lit(0).alias("_anchor"), found.alias("_v"))
    rows = left.unionByName(right, allowMissingColumns=True)
    seen = {}
    for name, line in (("_up", F.asc("_at")), ("_down", F.desc("_at"))):
        order = W.partitionBy(*keys).orderBy(line, "_anchor", F.desc("_v.value_ord"), F.desc("_v.value"))
        seen[name] = F.last("_v", True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    pick = lambda v: F.when(v.isNotNull(), F.struct(F.abs(v["value_line"] - F.col("_at")).alias("gap"), v["value_line"].alias("value_line"), v["value"].alias("value")))
    best = F.array_min(F.array_compact(F.array(pick(F.col("_up")), pick(F.col("_down")))))
    return (
        rows.withColumns(seen).filter("_anchor = 1").withColumn("_b", best).filter("_b IS NOT NULL")
        .dropDuplicates([*keys, "_at"]).select(*keys, F.col("_at").alias("line_no"), "_b.gap", "_b.value_line", "_b.value")
    )


def remove(line: Column, rules: Sequence[tuple[str, bool, bool]]) -> Column:
    """Removal rules (pattern, must start the line, whole line) one after another, then edge
    trimming. ``/re/`` is a regular expression; a literal is looked for as written and removed
    whatever its case. Without rules the line is unchanged."""
    out = line
    for pattern, anchored, whole in rules:
        if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
            gone = F.lit("") if whole else F.regexp_replace(out, pattern[1:-1], "")
            out = F.when(out.rlike(("^(?:%s)" if anchored else "%s") % pattern[1:-1]), gone).otherwise(out)
        else:
            quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in pattern)
            held = F.startswith(out, F.lit(pattern)) if anchored else F.contains(out, F.lit(pattern))
            out = F.when(held, F.lit("") if whole else F.regexp_replace(out, "(?i)" + quoted, "")).otherwise(out)
    return T.trim_formatting(out) if rules else out


def rules_used(line: Column, rules: Sequence[tuple[str, bool, bool]]) -> Column:
    """The patterns of the rules that change the line, in order."""
    return F.filter(
        F.array(*[F.when(remove(line, [r]) != T.trim_formatting(line), F.lit(r[0])) for r in rules]), lambda x: x.isNotNull()
    )


def trimmed_blocks(lines: DataFrame, collapse: bool = False, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Without blank lines at both ends of each segment; ``collapse`` also leaves one of each
    run of empty lines inside."""
    seg, at = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("line_no")
    shown = F.when(F.trim("text") != "", F.col("line_no"))
    out = lines.withColumns({"_a": F.min(shown).over(seg), "_b": F.max(shown).over(seg)}).filter("line_no BETWEEN _a AND _b").drop("_a", "_b")
    if collapse:
        out = out.withColumn("_p", F.lag("text").over(at)).filter("NOT (text = '' AND _p <=> '')").drop("_p")
    return out


def coalesced_lines(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Several results of a label as one, texts in line order."""
    return rows.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("texts"), F.min("line_no").alias("line_no")
    )


def without_block_starts(rows: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Drops results that begin at a block's start where a sibling begins at a label."""
    other = F.max(F.col("matched_text") != BLOCK_START).over(W.partitionBy(*parent))
    return rows.filter((F.col("matched_text") != BLOCK_START) | ~other)
