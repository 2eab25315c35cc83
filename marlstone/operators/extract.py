"""Catalogue-driven extraction: labels are data that meet the lines of each document.

A document is one row with ``lines``, ``array<struct<text, line_no>>``. For each level of the
catalogue a row is exploded to the labels that its text can hold, then to the lines that they
match, then to the places where a value may stand (beside the label, in the frame before or
after it, in the block up to an end label, in either part of a split). One set of expressions
reads the value by the label's format, so the plan does not grow with the catalogue, and every
level is a narrow pass over what the level above found, which is written once. What is found is small; it is shuffled by document once, and windows
settle minimum counts, the first that succeeds and related values, from the innermost level up.

All "first" choices follow (label order, line order, order of places)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import extractors as X
from marlstone.functions import text as T
from marlstone.functions.text import built_once, let
from marlstone.operators.lines import BLOCK_END, BLOCK_START
from marlstone.operators.persons import persons
from marlstone.operators.spelling import spellings
from marlstone.operators.stages import dealt, settled
from marlstone.plans.catalogue import FORMATS, POSITIONS, FlatLabel, Label, flatten

LABEL = (
    "struct<label_id:int,group:string,texts:array<string>,low:array<string>,spaced:array<string>,starts:boolean,match_all:boolean,position:string,format:string,"
    "ends:array<string>,ends_spaced:array<string>,ends_block:boolean,must_contain:array<string>,possibilities:array<string>,many:boolean,once:boolean,include:boolean,"
    "previous:int,following:int,rules:array<struct<pattern:string,literal:string,anchored:boolean,whole:boolean>>>"
)
PLACE = f"struct<ord:int,kind:string,mode:string,source:{X.LINES},backwards:boolean>"
#: Places after the label's own line, in order: which frame is searched and what a hit is called.
FRAMES = {
    "prefer_before": (("around", "near_next_line"), ("next", "near_next_line"), ("previous", "near_previous_line")),
    "prefer_after": (("far_around", "near_next_line"), ("previous", "near_previous_line"), ("next", "near_next_line")),
    "before": (("next", "near_next_line"),),
    "after": (("previous", "near_previous_line"),),
    "succession": (("next", "near_next_line"), ("previous", "near_previous_line")),
}
AFTER_SIDE = ("same_line", "before", "prefer_before", "prefer_after", "succession", "related")
BEFORE_SIDE = ("after", "prefer_before", "prefer_after", "succession", "related")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in text)


def _rule(pattern: str, anchored: bool, whole: bool) -> dict:
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        body = pattern[1:-1]
        return {"pattern": f"^(?:{body})" if anchored else body, "literal": None, "anchored": anchored, "whole": whole}
    return {"pattern": "(?i)" + _quoted(pattern), "literal": pattern, "anchored": anchored, "whole": whole}


def _every_place(x: Label) -> bool:
    """Whether a hit keeps the values of all its places."""
    return x.position == "split" or x.multiple == "every_value"


def _once(x: Label) -> bool:
    """Whether a hit keeps its first place with a value, whatever is found inside it."""
    return not _every_place(x) and x.minimum_sub_matches == 0


def _label_row(f: FlatLabel) -> dict:
    x: Label = f.label
    texts = [t for t in x.texts if t != BLOCK_START]
    return {
        "label_id": f.label_id, "group": f.group, "texts": texts, "low": [t.lower() for t in texts],
        "spaced": [" " + t.lower() for t in texts], "starts": BLOCK_START in x.texts,
        "match_all": x.match_all, "position": x.position, "format": x.format, "ends": [t for t in x.ends if t != BLOCK_END],
        "ends_spaced": [" " + t.lower() for t in x.ends if t != BLOCK_END],
        "ends_block": BLOCK_END in x.ends, "must_contain": [t.lower() for t in x.must_contain], "possibilities": list(x.possibilities),
        "many": x.multiple != "first", "once": _once(x), "include": x.include_label_text, "previous": x.previous, "following": x.following,
        "rules": [_rule(r.pattern, r.anchored, r.whole_line) for r in x.removes],
    }


def _spaced(text: Column) -> Column:
    """The text in lower case after a blank: it holds a label in that form exactly where the line
    matches the label, so that each line is lowered once and each match is one search."""
    return F.concat(F.lit(" "), F.lower(text))


def _literal(value: object, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def cut(lines: Column, start: Column, count: Column) -> Column:
    """``count`` elements from the 0-based ``start``."""
    return F.slice(lines, F.greatest(start, F.lit(0)) + 1, F.greatest(count, F.lit(0)))


def _as_line(text: Column, line_no: Column) -> Column:
    return F.struct(text.alias("text"), line_no.cast("int").alias("line_no"))


def _place(ord_: int, kind: Column | str, mode: str, source: Column, backwards: bool = False) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.lit(ord_).alias("ord"), name.alias("kind"), F.lit(mode).alias("mode"), source.alias("source"), F.lit(backwards).alias("backwards")).cast(PLACE)


def _none() -> Column:
    return F.array().cast(f"array<{PLACE}>")


def _carried(rows: DataFrame) -> list[str]:
    """What a lexicon and a list of names say about the document goes along where they are given."""
    return [c for c in ("spelling", "persons") if c in rows.columns]


@built_once
def _hit_columns() -> dict[str, Column]:
    """The expressions of :func:`hits`, by what they are called there."""
    n, split, lines = F.size("lines"), F.col("l.position") == "split", F.col("lines")
    held = lambda x: F.exists(x["low"], lambda t: F.contains(F.col("_flat"), t))
    first = lambda line: F.get(F.filter("_texts", lambda t: F.contains(line, t["spaced"])), F.lit(0))["texts"]
    found = F.transform(
        "lines",
        lambda x, i: F.when((F.size("_texts") > 0) & (F.trim(x["text"]) != ""), T.let(F.get("_spaced", i), first)),
    )
    shown = F.transform(
        F.arrays_zip(F.col("_found").alias("m"), F.col("lines").alias("x")),
        lambda z, i: F.coalesce(
            z["m"], F.when((i == 0) & F.col("l.starts"), F.lit(BLOCK_START)),
            F.when((F.size("l.texts") == 0) & ~F.col("l.starts") & (F.trim(z["x"]["text"]) != ""), F.lit("")),
            F.when(split & (i == n - 1), F.lit("")),
        ),
    )

    def hit(shown: Column, i: Column) -> Column:
        before = F.greatest(i - F.col("l.previous"), F.lit(0))
        return F.when(
            shown.isNotNull(),
            F.struct(
                i.alias("i"), shown.alias("matched"), F.get(lines, i).alias("line"), F.get(lines, i - 1)["text"].alias("above"),
                F.reverse(cut(lines, before, i - before)).alias("previous"), cut(lines, i + 1, F.col("l.following")).alias("next"),
            ),
        )

    return {
        "flat": F.lower(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")), "spaced": F.transform("lines", lambda x: _spaced(x["text"])),
        "labels": F.explode(F.filter("_labels", lambda x: x["starts"] | (x["position"] == "split") | (F.size(x["low"]) == 0) | held(x))),
        # of a label's texts those that the segment holds; its lines are searched for no other
        "texts": F.filter(F.arrays_zip("l.texts", "l.spaced", "l.low"), lambda t: F.contains(F.col("_flat"), t["low"])),
        # a hit carries its frames; the whole text goes along for splits alone
        "found": found, "shown": shown, "whole": F.when(split, lines).alias("whole"), "n": n.alias("n"),
        "hits": F.explode(F.filter(F.transform("_shown", hit), lambda h: h.isNotNull())).alias("h"), "near": F.concat(F.array("line"), "next", "previous"),
        "kept": ~F.col("l.match_all") | F.forall("l.texts", lambda t: F.exists("_near", lambda v: T.label_matches(v["text"], t))),
    }


def hits(segments: DataFrame, labels: Column) -> DataFrame:
    """Segments (``doc_id``, ``parent_id``, ``lines``) with each label ``l`` and line index ``i``
    that matches it, the text that did, the line and its frames."""
    c, carried = _hit_columns(), _carried(segments)
    labelled = (
        segments.withColumns({"_flat": c["flat"], "_labels": labels, "_spaced": c["spaced"]})
        .withColumn("l", c["labels"]).withColumn("_texts", c["texts"]).drop("_flat", "_labels")
    )
    out = (
        labelled.withColumn("_found", c["found"]).withColumn("_shown", c["shown"])
        .select("doc_id", "parent_id", *carried, "l", c["whole"], c["n"], c["hits"])
        .select("doc_id", "parent_id", *carried, "l", F.col("whole").alias("lines"), "n", "h.*")
    )
    return out.withColumn("_near", c["near"]).filter(c["kept"]).drop("_near")


@built_once
def _place_columns(positions: frozenset[str], spelled: bool) -> tuple[list[dict[str, Column]], list[Column]]:
    """What :func:`places` adds, step by step, and what it gives in the end."""
    known = T.knows(F.col("spelling")) if spelled else None
    position, text, no = F.col("l.position"), F.col("line.text"), F.col("line.line_no")
    inside = F.get(F.filter("l.texts", lambda t: F.contains(F.lower(text), F.lower(t))), F.lit(0))
    sides = F.when(F.size("l.texts") == 0, F.array("line")).otherwise(
        F.array(
            F.when(position.isin(*AFTER_SIDE), _as_line(T.text_after(text, F.col("_inside")), no)),
            F.when(position.isin(*BEFORE_SIDE), _as_line(T.text_before(text, F.col("_inside")), no)),
        )
    )
    ends = lambda line: F.exists("l.ends_spaced", lambda e: F.contains(line, e))
    block_end = F.when(position == "between", F.array_position(F.transform("next", lambda x: T.let(_spaced(x["text"]), ends)), True).cast("int"))
    starts = F.col("matched") == BLOCK_START
    after = F.when(starts, text).otherwise(T.text_after(text, F.col("matched")))
    head = F.when(F.col("_after") != "", F.array(_as_line(F.col("_after"), no))).otherwise(X.none())
    body = F.when(F.col("_end") > 0, F.slice("next", F.lit(1), F.col("_end") - 1)).otherwise(F.when(F.col("l.ends_block"), F.col("next")).otherwise(X.none()))
    named = F.when(
        F.col("l.include") & (F.size("_block") > 0), F.concat(F.array("line"), F.slice("_block", F.lit(2), F.greatest(F.size("_block"), F.lit(1))))
    ).otherwise(F.col("_block"))
    low = F.lower(F.array_join(F.transform("_named", lambda x: x["text"]), "\n"))
    held = (F.size("l.must_contain") == 0) | F.exists("l.must_contain", lambda t: F.contains(F.col("_low"), t))
    ended = F.when(F.col("_end") > 0, F.get(F.filter("l.ends", lambda e: T.label_matches(F.get("next", F.col("_end") - 1)["text"], e)), F.lit(0)))
    contained = F.get(F.filter("l.must_contain", lambda t: F.contains(F.col("_low"), t)), F.lit(0))
    block = F.filter(F.concat(head, body), lambda x: ~T.looks_corrupted(x["text"], known))
    added = [
        {"_inside": inside, "_end": block_end, "_after": after},
        {
            "_sides": F.filter(sides, lambda x: x["text"].isNotNull() & (x["text"] != "")),
            "_block": F.when(position == "between", block).otherwise(X.none()),
        },
        {"_named": named}, {"_low": low}, {"_held": held}, {"_ended": ended, "_contains": contained},
    ]
    usable = F.exists("_sides", lambda x: ~T.is_blank(x["text"]) & ~x["text"].isin("-", "—"))
    own = F.when(F.size("l.texts") == 0, "between").otherwise("same_line")
    one_line, i, n = F.col("n") == 1, F.col("i"), F.col("n")
    first_text = F.get("_sides", F.lit(0))["text"]
    above = F.col("above")
    two = (i > 0) & (first_text.rlike(r"^\p{Ll}") | F.startswith(F.lower(first_text), F.lit("trading as")))
    single = F.filter("_sides", lambda x: x["text"].rlike(r"^[^\s]+$"))
    same = F.when(
        (F.col("l.format") == "company") & usable,
        F.array(
            _place(1, "same_line_2_lines", "take", F.when(two, F.array(_as_line(F.concat(above, F.lit(" "), first_text), no))).otherwise(X.none())),
            _place(2, own, "typed", F.col("_sides")), _place(3, "same_line_single_word", "take", F.slice(single, 1, 1)),
        ),
    ).when(usable, F.array(_place(2, own, "typed", F.col("_sides")))).otherwise(_none())
    frames = {
        "next": F.col("next"), "previous": F.col("previous"), "around": F.concat("previous", "next"),
        "far_around": F.when(F.col("l.format") == "date_or_purpose", F.col("previous")).otherwise(F.concat(F.reverse("previous"), "next")),
    }
    framed = _none()
    for name, steps in ((p, s) for p, s in FRAMES.items() if p in positions):
        made = F.array(*[_place(4 + k, kind, "typed", F.filter(frames[f], lambda x: F.trim(x["text"]) != ""), f == "previous") for k, (f, kind) in enumerate(steps)])
        framed = F.when(position == name, made).otherwise(framed)
    around = F.concat("previous", F.array("line"), "next")
    start = F.instr(F.lower(text), F.lower("matched"))
    part_1 = F.when(F.col("matched") == "", F.col("lines")).when(one_line, F.array(_as_line(T.text_before(text, F.col("matched")), no))).otherwise(cut(F.col("lines"), F.lit(0), i - 1))
    part_2 = F.when(F.col("matched") == "", X.none()).when(one_line, F.array(_as_line(F.substring(text, start, F.length(text)), no))).otherwise(cut(F.col("lines"), i - 1, n))
    shown = lambda p: F.filter(p, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    every = (
        F.when(position == "between", F.when(F.col("_held"), F.array(_place(0, "between", "take", F.col("_named")))).otherwise(_none()))
        .when(position == "split", F.array(_place(1, "unset", "take", shown(part_1)), _place(2, "unset", "take", shown(part_2))))
        .when(position == "related", F.concat(same, F.array(_place(8, "unset", "related", around))))
        .otherwise(F.concat(same, framed))
    )
    between = lambda name, of: F.when(position == "between", F.col(of)).alias(name)
    return added, [every.alias("places"), between("matched_end", "_ended"), between("matched_contains", "_contains")]


def places(found: DataFrame, positions: Sequence[str] = POSITIONS) -> DataFrame:
    """Where values of each hit may stand, in order, as ``places``. ``positions`` are those that occur."""
    carried = _carried(found)
    steps, given = _place_columns(frozenset(positions), "spelling" in carried)
    for step in steps:
        found = found.withColumns(step)
    return found.select("doc_id", "parent_id", *carried, "l", "i", "matched", "line", *given)


@built_once
def _value_columns(formats: frozenset[str], first_names: tuple[str, ...] | None, is_ocr: bool, spelled: bool, named: bool) -> tuple[Column, Column]:
    """The values of all places of a hit, and the vocabulary entry of one."""
    spelling = F.col("spelling") if spelled else None
    known = None if spelling is None else T.knows(spelling)
    fmt, vocab = F.col("l.format"), F.size("l.possibilities") > 0
    words = F.col("persons") if named else F.array(*map(F.lit, first_names)) if first_names else None
    listed = vocab & fmt.isin("units", "text") | vocab & (fmt == "number") & (F.size("l.texts") == 0)

    def value(p: Column) -> Column:
        source = p["source"]
        numeric = F.filter(F.transform(source, lambda x: _as_line(X.first_number(x["text"]), x["line_no"])), lambda x: x["text"].isNotNull())
        typed = {
            "number": lambda: X.numbers(source, known), "licence_number": lambda: X.licence_numbers(source, F.col("l.many"), known),
            "company": lambda: X.names(source, p["backwards"], words, spelling, is_ocr), "date_or_purpose": lambda: X.dates_or_purposes(source),
            "single_word": lambda: X.single_word(source),
        }
        got = F.when(p["mode"] == "take", source).when(p["mode"] == "related", numeric)
        got = got.when(listed, X.vocabulary(source, F.col("l.possibilities"), spelling))
        for name, read in typed.items():
            if name in formats:
                got = got.when(fmt == name, read())
        return got.otherwise(X.whole_line(source)).cast(X.LINES)

    def step(acc: Column, p: Column) -> Column:
        with_value = lambda v: F.when(F.size(v) > 0, F.concat(acc, F.array(F.struct(p.alias("p"), v.alias("inner"))))).otherwise(acc)
        return F.when((F.size(p["source"]) == 0) | F.col("l.once") & (F.size(acc) > 0), acc).otherwise(let(value(p), with_value))

    # an explosion drops what has no value; a filter would work each value out once more
    start = F.array().cast(f"array<struct<p:{PLACE},inner:{X.LINES}>>")
    entry = F.when(listed & ~F.col("p.mode").isin("take", "related"), F.get("inner", F.lit(0))["text"])
    return F.explode(F.aggregate("places", start, step)).alias("_v"), entry


def values(rows: DataFrame, first_names: Sequence[str] | None = None, is_ocr: bool = False, formats: Sequence[str] = FORMATS) -> DataFrame:
    """The typed value of each place, one row a place ``p``; places without one are dropped. Of a hit
    that keeps the first place with a value (``l.once``), later places are not read. Where rows carry a spelling,
    OCR lines are corrected before the test of names, and vocabularies meet corrected lines too.
    ``formats`` are those that occur, so that no other one becomes part of the plan."""
    few = tuple(first_names) if first_names else None
    found, entry = _value_columns(frozenset(formats), few, is_ocr, "spelling" in rows.columns, "persons" in rows.columns)
    read = rows.select("*", found).select(*[c for c in rows.columns if c != "places"], "_v.p", "_v.inner")
    return read.withColumn("matched_vocab", entry)


def _holds(text: Column, r: Column) -> Column:
    literal = F.when(r["anchored"], F.startswith(text, r["literal"])).otherwise(F.contains(text, r["literal"]))
    return F.when(r["literal"].isNull(), F.regexp_like(text, r["pattern"])).otherwise(literal)


def _removed(text: Column) -> Column:
    """The label's removal rules one after another, then edge trimming."""

    def step(acc: Column, r: Column) -> Column:
        held = _holds(acc, r)
        return F.when(~held, acc).when(r["whole"], F.lit("")).otherwise(F.regexp_replace(acc, r["pattern"], F.lit("")))

    return T.trim_formatting(F.aggregate("l.rules", text, step))


@built_once
def _node_columns() -> list[Column]:
    cleaned = F.filter(F.transform("inner", lambda x: _as_line(_removed(x["text"]), x["line_no"])), lambda x: x["text"] != "")
    ruled = (F.size("l.rules") > 0) & F.col("l.format").isin("text", "company") & (F.col("l.position") != "split")
    texts = F.when(ruled, cleaned).otherwise(F.col("inner"))
    used = F.filter("l.rules", lambda r: F.exists("inner", lambda x: _holds(x["text"], r)))
    used = F.when(ruled, F.transform(used, lambda r: F.coalesce(r["literal"], r["pattern"]))).otherwise(F.array().cast("array<string>"))
    own_line = F.col("l.position").isin("between") | F.col("p.kind").isin("same_line", "same_line_2_lines", "same_line_single_word")
    name = F.concat_ws(":", F.col("l.label_id").cast("string"), F.col("i").cast("string"), F.col("p.ord").cast("string"))
    return [
        F.col("l.group").alias("group"), F.concat_ws("/", F.coalesce("parent_id", F.col("l.group")), name).alias("node_id"), F.col("parent_id"),
        F.col("l.label_id").alias("label_id"), F.when(own_line, F.col("line.line_no")).otherwise(F.get("inner", F.lit(0))["line_no"]).alias("line_no"),
        F.col("p.kind").alias("match_type"), texts.alias("texts"), F.nullif("matched", F.lit("")).alias("matched_text"), F.col("matched_end"),
        F.col("matched_contains"), F.col("matched_vocab"), used.alias("rules_used"), F.col("inner"),
        F.col("i").alias("_spot"), F.col("p.ord").alias("_try"), (F.col("p.mode") == "related").alias("_related"),
    ]


def nodes_of(
    segments: DataFrame, labels: Column, first_names: Sequence[str] | None, is_ocr: bool = False, here: Sequence[Label] | None = None
) -> DataFrame:
    """All candidate nodes of one level, whose labels are ``here`` (any where it is not given)."""
    formats = FORMATS if here is None else {x.format for x in here}
    found = values(places(hits(segments, labels), POSITIONS if here is None else {x.position for x in here}), first_names, is_ocr, formats)
    return found.select("doc_id", *_carried(found), *_node_columns())


def documents_as_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and standardised ``lines`` straight from the text, without a shuffle."""
    parts = F.split(F.coalesce(text_col, F.lit("")), "\n", -1)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.transform(parts, lambda x, i: F.struct(T.standardise(x).alias("text"), i.alias("line_no"))).alias("lines")
    )


def gather_lines(lines: DataFrame) -> DataFrame:
    """The same from a line table (``doc_id``, ``line_no``, ``text``): one shuffle by document."""
    row = F.struct(F.col("line_no").cast("int").alias("line_no"), T.standardise(F.col("text")).alias("text"))
    return lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("l")).select(
        "doc_id", F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["line_no"].alias("line_no"))).alias("lines")
    )


def settle(nodes: DataFrame, flat: list[FlatLabel]) -> DataFrame:
    """From the innermost level up: minimum counts (a split part with too few matches voids the
    other part of its cut), the scan that ends at a succession, the first place and line that succeed, label hits before block
    starts, and numbers nearest to the line of a related sibling. Then nodes stay whose parents
    do. Windows inside a document only: one shuffle, by ``doc_id``, in tasks of a bounded number of nodes,
    and one sort, by the steps of each node's path: what a window looks at (a node with its children,
    a hit, a label's hits, siblings) has the first steps in common and so lies together."""
    ids = lambda test, labels=flat: [f.label_id for f in labels if test(f)]
    among = lambda found: F.col("label_id").isin(*found) if found else F.lit(False)
    facts = _literal({str(f.label_id): {"depth": f.depth, "ord": f.ord, "name": f.label.name} for f in flat}, "map<string,struct<depth:int,ord:int,name:string>>")
    fact = F.element_at(facts, F.col("label_id").cast("string"))
    depth = max((f.depth for f in flat), default=0)
    # label, spot and place of the node and of each one above it
    steps = [f"_{part}{d}" for d in range(depth + 1) for part in ("label", "at", "place")]
    path = F.split(F.substring(F.col("node_id"), F.length("group") + 2, F.length("node_id")), "[/:]")
    # windows carry what they look at; the rest goes along as one value, which is copied as it stands
    moved = F.when(among(ids(lambda f: f.label.multiple == "joined" or f.label.position == "related")), F.col("texts"))
    out = (
        dealt(nodes.select("*", F.struct(*[c for c in nodes.columns if c not in ("doc_id", "group", "label_id", "line_no", "inner")]).alias("_row")), "doc_id")
        .withColumns({"_path": path, "_start": F.coalesce(F.col("matched_text") == BLOCK_START, F.lit(False)), "_texts": moved, "_fact": fact})
        .select(
            "doc_id", "group", "label_id", "line_no", "_row", "_spot", "_try", "_related", "_start", "_texts", F.lit(True).alias("_alive"),
            F.col("_fact.depth").alias("_level"), F.col("_fact.ord").alias("_ord"), *[F.get("_path", F.lit(k)).cast("int").alias(c) for k, c in enumerate(steps)],
        )
        .sortWithinPartitions("doc_id", "group", *steps)
    )
    level, alive = F.col("_level"), F.col("_alive")
    over = lambda n: W.partitionBy("doc_id", "group", *steps[:n])
    for d in range(depth, -1, -1):
        at = [f for f in flat if f.depth == d]
        here, labels = level == d, [f.label for f in at]
        kin, same, hit, family = (over(3 * d + n) for n in range(4))
        counted, below = [f for f in at if f.label.minimum_sub_matches > 0], any(f.depth == d + 1 for f in flat)

        def narrowed(df: DataFrame, keep: Column, here: Column = here) -> DataFrame:
            return df.withColumn("_alive", F.when(here, alive & F.coalesce(keep, F.lit(False))).otherwise(alive))

        # a level has those windows alone that its labels need, and one for all that looks at the same rows
        keep, ok = F.lit(True), F.lit(True)
        if counted:
            least = F.lit(0)
            for f in counted:
                least = F.when(F.col("label_id") == f.label_id, f.label.minimum_sub_matches).otherwise(least)
            found = F.sum(((level == d + 1) & alive).cast("int")).over(family) if below else F.lit(0)
            out, keep, ok = out.withColumn("_ok", found >= least), F.col("_ok"), F.col("_ok")
            if splits := ids(lambda f: f.label.position == "split", at):
                keep = F.when(among(splits), F.min(F.when(here, ok)).over(hit)).otherwise(ok)
        # other hits have one place, or keep all; a hit's places share its spot, so a scan ends and block starts give way as before
        if any(not (_once(x) or _every_place(x)) for x in labels):
            tried = F.col("_try") == F.min(F.when(alive & here & ok, F.col("_try"))).over(hit)
            keep = keep & (among(ids(lambda f: _every_place(f.label), at)) | tried)
        out = narrowed(out, keep).drop("_ok")
        if stops := ids(lambda f: f.label.position == "succession", at):
            end = F.min(F.when(alive & among(stops), F.col("_spot"))).over(kin)
            out = narrowed(out, F.coalesce(F.col("_spot") <= end, F.lit(True)))
        starts = any(BLOCK_START in x.texts for x in labels)
        firsts, joins = ids(lambda f: f.label.multiple == "first", at), ids(lambda f: f.label.multiple == "joined", at)
        if starts or firsts or joins:
            live, begun, joined = alive & here, F.col("_start") if starts else F.lit(False), among(joins)
            seen = {"_low": F.min(F.when(live, F.col("_spot")))}
            if starts:
                seen |= {"_named": F.max(F.when(live, ~begun)), "_low_named": F.min(F.when(live & ~begun, F.col("_spot")))}
            if joins:
                seen["_all"] = F.collect_list(F.when(live & joined, F.struct("_spot", F.col("_texts").alias("texts"), begun.alias("begun"))))
            out = out.withColumns({k: v.over(same) for k, v in seen.items()})
            named = F.coalesce("_named", F.lit(False)) if starts else F.lit(False)
            lowest = F.col("_spot") == (F.when(named, F.col("_low_named")).otherwise(F.col("_low")) if starts else F.col("_low"))
            if joins:
                parts = F.sort_array(F.filter("_all", lambda x: ~x["begun"] | ~named))  # noqa: B023
                out = out.withColumn("_texts", F.when(joined, F.flatten(F.transform(parts, lambda x: x["texts"]))).otherwise(F.col("_texts")))
            out = narrowed(out, (~begun | ~named) & (~(among(firsts) | joined) | lowest)).drop(*seen)
        if any(x.position == "related" for x in labels):
            wants = {f.label_id: (f.label.related_category, f.label.related_name) for f in at if f.label.position == "related"}
            meant = {k: ids(lambda f, want=want: None not in want and (f.label.category, f.label.name) == want, at) for k, want in wants.items()}
            seen = F.collect_set(F.when(alive & among(sorted({i for x in meant.values() for i in x})), F.struct("label_id", "line_no"))).over(kin)
            wanted = F.element_at(_literal({str(k): x for k, x in meant.items()}, "map<string,array<int>>"), F.col("label_id").cast("string"))
            anchor = F.coalesce(F.array_min(F.transform(F.filter("_kin", lambda k: F.array_contains(wanted, k["label_id"])), lambda k: k["line_no"])), F.lit(-1))
            near = F.array_min(F.transform("_texts", lambda x: F.struct(F.abs(x["line_no"] - F.col("_anchor")).alias("gap"), x["line_no"].alias("line_no"), x["text"].alias("text"))))
            chosen = here & F.col("_related")
            out = out.withColumn("_kin", seen).withColumn("_anchor", anchor).withColumn("_near", F.when(chosen, near))
            out = out.withColumns(
                {
                    "line_no": F.when(chosen, F.col("_near.line_no")).otherwise(F.col("line_no")),
                    "_texts": F.when(chosen, F.array(_as_line(F.col("_near.text"), F.col("_near.line_no")))).otherwise(F.col("_texts")),
                }
            ).drop("_kin", "_anchor", "_near")
    # by path, what lies above a node at some level is the last one of that level so far
    order = W.partitionBy("doc_id", "group").orderBy(*steps)
    so_far, whole = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    above = {f"_above{d}": F.last(F.when(level == d, alive), True).over(so_far) for d in range(max(depth, 1))}
    first = {"_best": F.min(F.when(alive & (level == 0), F.col("_ord"))).over(whole), "_root": F.last(F.when(level == 0, F.col("_ord")), True).over(so_far)}
    out, keep = out.withColumns(above | first), F.col("_root") == F.col("_best")
    for d, held in enumerate(above):
        keep = keep & ((level <= d) | F.col(held))
    out = out.filter(alive & keep)
    kept = {"texts": F.coalesce("_texts", "_row.texts")} | {c: F.col(c) for c in ("doc_id", "group", "label_id", "line_no")}
    shown = [c for c in nodes.columns if c not in ("_spot", "_try", "_related", "inner")]
    return out.select(*[kept.get(c, F.col(f"_row.{c}")).alias(c) for c in shown], fact["name"].alias("name"))


def with_words(docs: DataFrame, flat: list[FlatLabel], lexicon: DataFrame | None, first_names: DataFrame | None) -> DataFrame:
    """Documents that hold the text of an outermost label, with their ``spelling`` where there is a
    lexicon and their ``persons`` where there is a table of names."""
    outer = [f.label for f in flat if f.depth == 0 and f.label.format != "linked_licence"]
    if all(set(x.texts) - {BLOCK_START} and x.position != "split" and BLOCK_START not in x.texts for x in outer):
        low = F.lower(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
        texts = sorted({t.lower() for x in outer for t in x.texts})
        docs = docs.filter(F.exists(F.array(*map(F.lit, texts)), lambda t: F.contains(low, t)))
    docs = settled(docs.select("doc_id", "lines"))
    spelling = None if lexicon is None else settled(spellings(docs, lexicon))
    out = docs if spelling is None else docs.join(spelling, "doc_id", "left")
    return out if first_names is None else out.join(persons(docs, first_names, spelling), "doc_id", "left")


def extract(
    docs: DataFrame, groups: Sequence[tuple[str, Sequence[Label]]], first_names: DataFrame | Sequence[str] | None = None, is_ocr: bool = False,
    service: str = "native", lexicon: DataFrame | None = None, wanted: Sequence[str] | None = None,
) -> DataFrame:
    """All matches of a catalogue in ``docs`` (``doc_id``, ``lines``): a row for each node with
    ``group``, ``node_id``, ``parent_id``, ``label_id``, ``name``, ``line_no``, ``match_type``,
    ``texts``, how it was matched (``matched_text``, ``matched_end`` and ``matched_contains`` of a block,
    ``matched_vocab``, ``rules_used``), ``is_ocr`` and ``service``. With a ``lexicon`` (``word``), lines of
    more than half unknown words are garbage, initials are told from words, vocabularies meet
    corrected lines, and, for OCR, lines are corrected before the test of names; a word that a
    label's text cuts counts as known. ``first_names`` is a table (``name``) of any length, which is
    joined to the words of documents, or a few names, which become part of the plan. Linked licences are followed by
    :func:`marlstone.operators.links.closure`, so their labels give no rows here. With ``wanted``, the rows are those
    of these groups and the same as without: no group depends on another, so the others are not searched."""
    flat = [f for f in flatten(groups) if wanted is None or f.group in wanted]
    catalogue: dict[str, list[dict]] = {}
    for f in flat:
        if f.label.format != "linked_licence":
            catalogue.setdefault(str(f.parent_id), []).append(_label_row(f))
    labels = lambda key: F.element_at(_literal(catalogue, f"map<string,array<{LABEL}>>"), key)
    listed = first_names if isinstance(first_names, DataFrame) else None
    if lexicon is not None or listed is not None:
        docs = with_words(docs, flat, lexicon, listed)
    segments = docs.select("doc_id", *_carried(docs), F.lit(None).cast("string").alias("parent_id"), "lines")
    depth = max((f.depth for f in flat), default=0)
    few = None if listed is not None else first_names
    at = lambda d: [f.label for f in flat if f.depth == d]
    level = settled(nodes_of(segments, labels(F.lit("None")), few, is_ocr, at(0)))
    found = level
    for d in range(1, depth + 1):
        segments = level.filter(F.col("label_id").cast("string").isin(*catalogue)).select(
            "doc_id", *_carried(level), F.col("node_id").alias("parent_id"), F.col("inner").alias("lines"), F.col("label_id").cast("string").alias("_key")
        )
        level = settled(nodes_of(segments, labels(F.col("_key")), few, is_ocr, at(d)))
        found = found.unionByName(level)
    return settle(found.drop("spelling", "persons"), flat).withColumns({"is_ocr": F.lit(is_ocr), "service": F.lit(service)})
