"""Typed extractors over an ordered array of lines, ``array<struct<text, line_no>>``.

Each gives an array of such structs, empty when nothing is found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import wordlists as W
from marlstone.functions.text import let

LINES = "array<struct<text:string,line_no:int>>"
#: Maps a word to whether a lexicon has it; without one every word of a line counts as known.
Known = Callable[[Column], Column] | None
#: Forms of licence numbers, between slashes or blanks.
SLASHES = r"[0-9A-Z]{1,2}/[0-9]{1,5}(/[0-9.A-Z*]{1,4}/[0-9]{1,4})*"
SPACES = r"[0-9A-Z]{1,2} [0-9]{1,5}( [0-9.A-Z*]{1,4} [0-9]{1,4})*"
#: Licence numbers of four parts or more; a date has three.
WHOLE_NUMBER = SLASHES.removesuffix("*") + "+"


def none() -> Column:
    return F.array().cast(LINES)


def _line(text: Column, of: Column) -> Column:
    return F.struct(text.alias("text"), of["line_no"].cast("int").alias("line_no"))


def _while(lines: Column, more: Callable[[Column], Column], read: Callable[[Column], Column]) -> Column:
    """What ``read`` gives for line after line, put together for as long as ``more`` of what there
    is holds: later lines are not read."""
    step = lambda acc, x: F.when(more(acc), F.concat(acc, read(x))).otherwise(acc)
    return F.aggregate(lines, none(), step)


def _first(lines: Column, read: Callable[[Column], Column]) -> Column:
    """The first line, with its text as ``read`` gives it, of which that is not null."""
    one = lambda x: let(read(x["text"]), lambda t: F.when(t.isNotNull(), F.array(_line(t, x))).otherwise(none()))
    return _while(lines, lambda acc: F.size(acc) == 0, one)


def first_number(text: Column) -> Column:
    """The first numeric token of a line as text; null without one."""
    return let(F.get(F.filter(F.split(text, " ", -1), lambda w: T.is_numeric(w)), F.lit(0)), lambda w: let(T.to_number(w), T.number_text))


def numbers(lines: Column, known_word: Known = None) -> Column:
    """The first number of the lines, as its text and line."""
    return _first(lines, lambda t: let(first_number(t), lambda n: F.when(n.isNotNull() & ~T.looks_corrupted(t, known_word), n)))


def _candidates(text: Column) -> Column:
    """Pieces of a line that could be licence numbers, valid or not."""
    pieces = F.split(F.regexp_replace(text, " and| for| shall| under| from| \\(", ","), ",", -1)
    return F.filter(
        pieces,
        lambda p: ~p.rlike(r"[^\p{L}\p{N} /.*]") & (F.contains(p, F.lit(" ")) | F.contains(text, F.lit("/"))) & (F.length(p) >= 4),
    )


def _licence(piece: Column) -> Column:
    p = F.when(F.contains(piece, F.lit("/")), F.replace(piece, F.lit(" "), F.lit(""))).otherwise(piece)
    parts = F.size(F.filter(F.split(F.replace(p, F.lit(" "), F.lit("/")), "/", -1), lambda x: x.rlike(r"\p{Nd}")))
    return F.when((p.rlike(SLASHES) | p.rlike(SPACES)) & (parts >= 2), F.trim(p))


def licence_numbers(lines: Column, many: Column, known_word: Known = None) -> Column:
    """Licence numbers of the lines; unless ``many``, the first candidate alone, valid or not."""
    read = lambda x: F.when(T.looks_corrupted(x["text"], known_word), none()).otherwise(F.transform(_candidates(x["text"]), lambda p: _line(_licence(p), x)))
    every = _while(lines, lambda acc: many | (F.size(acc) == 0), lambda x: F.coalesce(read(x), none()))
    return let(every, lambda e: F.filter(F.when(many, e).otherwise(F.slice(e, 1, 1)), lambda x: x["text"].isNotNull()))


def vocabulary(lines: Column, entries: Column, spelling: Column | None = None) -> Column:
    """The first line that holds an entry, as it stands or corrected, as the first such entry in
    vocabulary order."""

    def hit(text: Column) -> Column:
        if spelling is None:
            return let(F.lower(text), lambda low: F.get(F.filter(entries, lambda v: F.contains(low, F.lower(v))), F.lit(0)))
        both = F.array(F.lower(text), F.lower(T.corrected(text, spelling)))
        return let(both, lambda b: F.get(F.filter(entries, lambda v: F.exists(b, lambda t: F.contains(t, F.lower(v)))), F.lit(0)))

    return _first(lines, hit)


def dates_or_purposes(lines: Column) -> Column:
    """Lines that name a purpose or a year; four digits inside a licence number are no year."""
    return F.filter(lines, lambda x: T.is_date_or_purpose(F.regexp_replace(x["text"], WHOLE_NUMBER, "")))


def shown(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~T.is_blank(x["text"]))


def single_word(lines: Column) -> Column:
    return _first(lines, lambda t: F.when(~T.is_blank(t), T.first_word(t)))


def whole_line(lines: Column) -> Column:
    return _first(lines, lambda t: F.when(~T.is_blank(t), t))


def name_in(text: Column, first_names: Column | None = None, known_word=None) -> Column:
    """The company or person that a line names, cut after a company suffix; null if none.

    ``first_names`` is an array of lower-case names, of one word or more, that count at the start
    of the line or after its first word; ``known_word`` maps a word to whether a lexicon has it
    (without one, no word is known)."""
    known = known_word or (lambda w: F.lit(False))

    def initials(parts: Column) -> Column:
        return (
            F.size(parts).between(2, 4) & F.get(parts, F.lit(0)).rlike(r"^\p{L}{1,2}$")
            & ((F.size(parts) == 2) | F.get(parts, F.lit(1)).rlike(r"^\p{L}{1,2}$")) & F.element_at(parts, -1).rlike(r"^\p{L}{3,}$")
            & ~F.forall(parts, lambda w: known(w) & (F.length(w) > 1))
        )

    def named(t: Column, low: Column, parts: Column, suffix: Column) -> Column:
        words = F.lit(False)
        for w in W.NAME_WORDS:
            words = words | F.contains(low, F.lit(w))
        if first_names is not None:
            rest = F.trim(F.lower(F.substring(t, F.length(F.get(parts, F.lit(0))) + 1, F.length(t))))
            begins = lambda n: F.startswith(low, F.concat(n, F.lit(" "))) | F.startswith(rest, F.concat(n, F.lit(" ")))
            words = words | F.coalesce(F.exists(first_names, begins), F.lit(False))
        cut = F.when(suffix.isNotNull(), F.substring(t, F.lit(1), F.instr(low, suffix) + F.length(suffix) - 1)).otherwise(t)
        bare = F.lower(cut).isin(*[s.strip() for s in W.NAME_SUFFIXES])
        is_name = (T.starts_with_title(t) | words | suffix.isNotNull()) & ~T.ends_like_address(t, low) & ~bare
        return F.when(t.isNull() | T.describes_agency(t, low), F.lit(None).cast("string")).when(initials(parts), t).when(is_name, cut)

    return let(text, lambda t: let(F.lower(t), lambda low: let(F.split(t, " ", -1), lambda p: let(T.suffix_in(low), lambda s: named(t, low, p, s)))))


def _until_suffix(run: Column) -> Column:
    """Up to and with the first line that has a company suffix."""

    def cut(r: Column) -> Column:
        ends = F.array_position(F.transform(r, lambda x: T.suffix_within(x["text"]).isNotNull()), True)
        return let(ends.cast("int"), lambda e: F.when(e > 0, F.slice(r, F.lit(1), e)).otherwise(r))

    return let(run, cut)


def names(
    lines: Column, backwards: Column, first_names: Column | None = None, spelling: Column | None = None, correct: bool = False
) -> Column:
    """The run of names from the first one on: it ends at a line without a name or after one
    with a company suffix, and lines after its end are not read. Lines read backwards come back in reading order, all with the line
    number of the first hit; the issuer is left out beside others. With a spelling, unknown words
    decide on garbage and initials; with ``correct``, lines are corrected before the test."""
    known = None if spelling is None else T.knows(spelling)
    read = (lambda t: T.corrected(t, spelling, True)) if correct and spelling is not None else (lambda t: t)
    name = lambda x: F.when(~T.looks_corrupted(x["text"], known), name_in(T.trim_formatting(read(x["text"])), first_names, known))
    state = lambda run, done: F.struct(run.alias("run"), done.alias("done"))

    def step(acc: Column, x: Column) -> Column:
        ended = state(acc["run"], F.size(acc["run"]) > 0)
        more = lambda t: state(F.concat(acc["run"], F.array(_line(t, x))), T.suffix_within(t).isNotNull())
        return F.when(acc["done"], acc).otherwise(let(name(x), lambda t: F.when(t.isNull(), ended).otherwise(more(t))))

    def ordered(run: Column) -> Column:
        at = F.get(run, F.lit(0))["line_no"]
        turned = F.when(backwards, F.reverse(run)).otherwise(run)
        alone = let(turned, lambda r: F.when(F.size(r) > 1, F.filter(r, lambda x: x["text"] != W.ISSUER)).otherwise(r))
        return let(at, lambda a: F.transform(_until_suffix(alone), lambda x: F.struct(x["text"].alias("text"), a.alias("line_no"))))

    return let(F.aggregate(lines, state(none(), F.lit(False)), step, lambda acc: acc["run"]), ordered)
