"""Scalar text functions and predicates as Column expressions.

All stay inside whole-stage codegen; character classes are Unicode property classes, which
DuckDB's regular expressions share."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import wordlists as W

LEADING, TRAILING = r"^[\p{P}\p{S}\p{Z}\s]+", r"(?:[\p{S}\p{Z}\s]|[^\P{P})])+$"
EDGES = f"{LEADING}|{TRAILING}"
BLANK = r"[\p{P}\p{Z}\s]"
NUMERIC = r"^[+-]?(\d[\d,]*(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
YEAR = r"19\p{Nd}\p{Nd}|20\p{Nd}\p{Nd}"
#: Ordered rewrites of quotation marks, degree signs and double blanks.
REWRITES = (
    ("‘‘", '"'), ("’’", '"'), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'),
    ("'\"", '"'), ("'", '"'), ("°", "*"), ("  ", " "), ('""', '"'),
)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: expressions that use a value several times
    would otherwise hold, and grow with, as many copies of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(build: Callable) -> Callable:
    """``build``, whose arguments can be hashed and whose columns are named, is called once for each JVM
    and arguments. Every step of an expression is a call to the JVM, so that large ones take
    seconds to build; they hold names alone, no table and no rows."""
    kept: dict = {}

    @wraps(build)
    def given(*args):
        jvm = SparkContext._gateway
        for other in [k for k in kept if k[0] is not jvm]:
            del kept[other]
        if (jvm, args) not in kept:
            kept[jvm, args] = build(*args)
        return kept[jvm, args]

    return given


def trim_formatting(text: Column) -> Column:
    """Without punctuation, symbols and blanks at the start, and at the end up to a ``)``."""
    return F.regexp_replace(text, EDGES, "")


def standardise(text: Column) -> Column:
    """Trimmed, with typographic variants rewritten one after another (order matters)."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), REWRITES, F.regexp_replace(text, r"^\s+|\s+$", ""))


def is_blank(text: Column) -> Column:
    """Null, or nothing but punctuation and white space."""
    return text.isNull() | (F.regexp_replace(text, BLANK, "") == "")


def file_stem(path: Column) -> Column:
    """Last path segment without its last extension; other dots become ``-``."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "-")).otherwise("")


def is_numeric(token: Column) -> Column:
    return token.rlike(NUMERIC)


def to_number(token: Column) -> Column:
    """Double of a token with optional sign, thousands commas, decimals and exponent; else null."""
    return F.when(is_numeric(token), F.replace(token, F.lit(","), F.lit("")).try_cast("double"))


def number_text(value: Column) -> Column:
    """A double without a trailing ``.0`` and without an exponent."""
    plain = value.cast("decimal(38,10)").cast("string")
    return F.when(
        F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")
    ).otherwise(plain)


def first_word(text: Column) -> Column:
    return F.get(F.split(text, " "), F.lit(0))


def wrapped(text: Column, width: int = 30) -> Column:
    """A line feed after every ``width`` characters that are followed by others."""
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def percent(value: Column, is_ocr: Column) -> Column:
    """One decimal, for OCR rows only."""
    return F.when(is_ocr & value.isNotNull(), F.concat(F.bround(value, 1).cast("string"), F.lit("%"))).otherwise("")


def is_date_or_purpose(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("aggregate")) | text.rlike(YEAR), F.lit(False))


def _one_of(texts: Sequence[str]) -> str:
    return "(?:" + "|".join(re.sub(r"([^\w ])", r"\\\1", t) for t in texts) + ")"


def starts_with_title(text: Column) -> Column:
    """Begins with a personal or institutional prefix."""
    return F.coalesce(F.lower(text).rlike("^" + _one_of(W.NAME_PREFIXES)), F.lit(False))


def ends_with_suffix(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(_one_of(W.NAME_SUFFIXES) + r"\z"), F.lit(False))


def suffix_within(text: Column) -> Column:
    """The first name suffix, in list order, that the text contains; else null."""
    return let(F.lower(text), suffix_in)


def suffix_in(low: Column) -> Column:
    """The same of a text in lower case."""
    return F.coalesce(*[F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in W.NAME_SUFFIXES])


def ends_like_address(text: Column, low: Column | None = None) -> Column:
    """``low`` is the text in lower case, where it is at hand."""
    low = F.lower(text) if low is None else low
    return F.coalesce(_any([F.endswith(low, F.lit(s)) for s in W.ADDRESS_SUFFIXES]) | text.rlike(r"\p{Nd}$"), F.lit(False))


def describes_agency(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    return F.coalesce(_any([F.contains(low, F.lit(p)) for p in W.AGENCY_PHRASES]), F.lit(False))


def label_matches(line: Column, label: Column) -> Column:
    """The line begins with the label text or holds it after a blank, whatever the case."""
    low, want = F.lower(line), F.lower(label)
    return F.startswith(low, want) | F.contains(low, F.concat(F.lit(" "), want))


def text_before(line: Column, label: Column) -> Column:
    at = F.instr(F.lower(line), F.lower(label))
    return F.when(at > 0, F.trim(trim_formatting(F.substring(line, F.lit(1), at - 1))))


def text_after(line: Column, label: Column) -> Column:
    at = F.instr(F.lower(line), F.lower(label))
    return F.when(at > 0, F.trim(trim_formatting(F.substring(line, at + F.length(label), F.length(line)))))


def round_to(value: Column, step: float) -> Column:
    """Nearest multiple, ties to the even one."""
    return F.rint(value / step).cast("int") * F.lit(step).cast("int")


def count_words(text: Column) -> Column:
    """Words between single blanks, empty ones too."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def short_words(text: Column) -> Column:
    """How many words have at most two characters and no digit and are no common short word; one
    pass of a pattern, without arrays."""
    return F.regexp_count(text, F.lit(rf"(?<![^ ])(?!(?i:{_one_of(W.SHORT_WORDS)})(?![^ ]))[^ \p{{Nd}}]{{0,2}}(?![^ ])"))


#: What a lexicon says about a document, in lower case: words that it lacks, neighbours that are one
#: of its words together, and corrections of words that it lacks.
SPELLING = "struct<odd:array<string>,joined:array<string>,better:map<string,string>>"


def knows(spelling: Column) -> Callable[[Column], Column]:
    """Whether the lexicon behind a ``SPELLING`` has a word; every word where it is null."""
    return lambda word: ~F.coalesce(F.array_contains(spelling["odd"], F.lower(word)), F.lit(False))


def corrected(text: Column, spelling: Column, without_first: bool = False) -> Column:
    """The text with its words corrected one after another.

    A text that begins with a personal or institutional prefix, or is one word, stays. Of the
    others ``esq``, pairs of capitals, single characters and words with two dots stay; a single
    character or unknown word is joined to the next one where that makes a word; an unknown word
    takes its correction, unless they differ by a plural ``s`` alone. ``without_first`` drops a first
    word in lower case. A null spelling corrects nothing."""
    words = F.transform(F.split(text, " ", -1), standardise)
    many = F.size(words) > 1
    rows = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("next"), (i == 0).alias("first")))

    def step(acc: Column, x: Column) -> Column:
        w, follows, low = x["w"], x["next"], F.lower(x["w"])
        odd = F.coalesce(F.array_contains(spelling["odd"], low), F.lit(False))
        stays = (low == "esq") | w.rlike(r"^\p{Lu}{2}$")
        joins = (
            ~stays & many & ((F.length(w) == 1) | odd) & (F.trim(follows) != "") & ((F.length(w) > 1) | (F.length(follows) > 1))
            & F.coalesce(F.array_contains(spelling["joined"], F.lower(F.concat(w, follows))), F.lit(False))
        )
        better = F.element_at(spelling["better"], low)
        plural = (F.concat(low, F.lit("s")) == better) | (F.concat(better, F.lit("s")) == low)
        dotted = F.length(w) - F.length(F.replace(w, F.lit("."), F.lit(""))) >= 2
        shaped = F.when(w.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(better, 1, 1)), F.substring(better, F.lit(2), F.length(better)))).otherwise(better)
        word = (
            F.when(joins, F.concat(w, follows)).when(stays | (F.length(w) <= 1) | dotted | better.isNull() | plural | ~odd | ~many, w).otherwise(shaped)
        )
        gone = F.lit(without_first) & x["first"] & w.rlike(r"^\p{Ll}")
        put = F.when(acc["skip"] | gone, acc["out"]).otherwise(F.concat(acc["out"], F.array(word)))
        return F.struct(put.alias("out"), (~acc["skip"] & ~gone & joins).alias("skip"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))
    made = F.array_join(F.aggregate(rows, start, step, lambda acc: acc["out"]), " ")
    return F.when(spelling.isNull() | starts_with_title(text), text).otherwise(made)


def looks_corrupted(text: Column, known_word: Callable[[Column], Column] | None = None) -> Column:
    """Scores a line as OCR garbage. ``known_word`` maps a word Column to whether a lexicon has
    it; without one every word counts as known."""
    special = F.regexp_replace(text, r'[ /.(),"*-]', "").rlike(r"[^\p{L}\p{Nd}]")
    # more than three short words, and a fifth of all
    garbled = short_words(text) >= F.greatest(F.lit(4.0), count_words(text) / 5.0)
    if known_word:
        bad = F.size(
            F.filter(
                F.split(text, " ", -1),
                lambda w: ~known_word(w) & ~F.contains(w, F.lit("/")) & ~is_numeric(F.regexp_replace(w, "TL|,", "")),
            )
        )
        garbled = garbled | (count_words(text) >= 2) & (bad * 100.0 / count_words(text) > 50)
    return (
        F.when(text.isNull() | (text == ""), False)
        .when((F.length(text) < 8) & text.rlike("[a-zA-Z][0-9][a-zA-Z]"), True)
        .when(text.rlike(r"^\p{Ll}") & special, True)
        .when(starts_with_title(text) | ends_with_suffix(text), False)
        .otherwise(garbled)
    )
