"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: module -> queries it registers
MODULES = {
    "exact_dedup": ["op5_exact_dedup"],
    "bpe": ["op6_bpe"],
    "packing": ["op2_packing"],
    "language_id": ["op1_language_id"],
    "minhash": ["op7_minhash"],
    "line_dedup": ["op8_line_dedup"],
    "quality": ["op9_quality"],
    "embeddings": ["op3_embedding_dedup"],
    "html_text": ["op4_html_text"],
    "licences": ["op10_licences"],
    "vector_codes": ["op11_vector_codes"],
    "whitening": ["op12_whitening"],
    "suffix_dedup": ["op13_suffix_dedup"],
}


def queries() -> dict:
    return {name: getattr(import_module(f"marlstone.llm.{m}"), name) for m, names in MODULES.items() for name in names}


def oracle_sql() -> dict[str, str]:
    """SQL of the modules; of one with a fitted model, made when it is asked for."""
    out = {}
    for m in MODULES:
        found = getattr(import_module(f"marlstone.llm.{m}"), "ORACLE", {})
        out |= found() if callable(found) else found
    return out
