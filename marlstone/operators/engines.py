"""Text engines tried from the cheapest on: a costlier one reads only documents that still lack a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.extractors import LINES
from marlstone.operators.extract import extract, gather_lines
from marlstone.operators.stages import dealt, settled
from marlstone.plans.catalogue import Label


@dataclass(frozen=True)
class Engine:
    """``read`` gives ``doc_id`` and ``lines`` for a table of ``doc_id``; documents that the engine cannot
    read have no row."""

    name: str
    cost: int
    read: Callable[[DataFrame], DataFrame]
    is_ocr: bool = True


def cached(name: str, cost: int, lines: DataFrame, is_ocr: bool = True) -> Engine:
    """An engine whose lines (``doc_id``, ``line_no``, ``text``) are a table: a semi join, so that lines of
    other documents are dropped before they are gathered."""
    return Engine(name, cost, lambda wanted: gather_lines(lines.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")), is_ocr)


def by_cost(engines: Sequence[Engine]) -> list[Engine]:
    """Cheapest first, equal costs in the order given. Names must differ."""
    if len({e.name for e in engines}) != len(engines):
        raise ValueError("engine names must differ")
    return sorted(engines, key=lambda e: e.cost)


def lacking(docs: DataFrame, found: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(``doc_id``, ``group``) pairs that ``found`` does not have."""
    wanted = docs.select("doc_id").distinct().withColumn("group", F.explode(F.array(*map(F.lit, groups))))
    return wanted.join(found.select("doc_id", "group").distinct(), ["doc_id", "group"], "left_anti")


def extract_by_cost(
    docs: DataFrame, engines: Sequence[Engine], groups: Sequence[tuple[str, Sequence[Label]]], on_top: bool = True,
    first_names: DataFrame | Sequence[str] | None = None, lexicon: DataFrame | None = None,
) -> DataFrame:
    """Matches of a catalogue (rows of :func:`marlstone.operators.extract.extract`) in ``docs`` (``doc_id``).

    Each engine, by cost, is asked for the documents in which no cheaper one found some group, and
    adds what it finds of those groups; the others keep what they have. With ``on_top`` its lines
    follow those of the cheapest engine, which are read again only for the documents at hand. The
    loop ends early once nothing is lacking. Every round's matches are written once; what is
    driven from round to round are pairs of document and group."""
    names = [g for g, _ in groups]
    missing, base, found = lacking(docs, docs.select("doc_id", F.lit(None).cast("string").alias("group")).limit(0), names), None, None
    for engine in by_cost(engines):
        missing = settled(missing)
        if missing.isEmpty():
            break
        wanted = missing.select("doc_id").distinct()
        lines = engine.read(wanted)
        if base is None:
            base = engine
        elif on_top:
            below = base.read(wanted).select("doc_id", F.col("lines").cast(LINES).alias("_below"))
            lines = lines.join(below, "doc_id", "left").select(
                "doc_id", F.concat(F.coalesce("_below", F.array().cast(LINES)), F.col("lines").cast(LINES)).alias("lines")
            )
        # lines are few bytes, so that adaptive execution would leave them to one task
        lines = dealt(settled(lines), most=10_000)
        here = extract(lines, groups, first_names, engine.is_ocr, engine.name, lexicon)
        here = settled(here.join(missing, ["doc_id", "group"], "left_semi"))
        found = here if found is None else found.unionByName(here)
        missing = missing.join(here.select("doc_id", "group").distinct(), ["doc_id", "group"], "left_anti")
    if found is None:
        return extract(docs.select("doc_id", F.array().cast(LINES).alias("lines")).limit(0), groups)
    return found
