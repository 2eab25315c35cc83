"""All queries of the extraction engine, with the SQL that must agree with each."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "marlstone.plans.line_queries", "marlstone.plans.graph_queries", "marlstone.plans.licence_queries", "marlstone.plans.export_queries",
    "marlstone.plans.lexicon_queries", "marlstone.plans.source_queries", "marlstone.plans.variant_queries",
)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(m).ORACLE.items()}
