"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Module, query and the name of its SQL in that module ('' where SQL can't express it).
QUERIES = [
    ("packing", "op1_pack", ""),
    ("token_files", "op2_token_files", ""),
    ("warc", "op3_warc", "OP3_SQL"),
    ("quality_classifier", "op8_quality_classifier", ""),
    ("substring_dedup", "op9_substring_dedup", ""),
    ("secret_scan", "op4_secret_scan", "OP4_SQL"),
    ("html_text", "op5_html_text", ""),
    ("jaccard_join", "op7_jaccard_join", "OP7_SQL"),
    ("quality_rules", "op6_quality_rules", "OP6_SQL"),
    ("decontaminate", "op10_decontaminate", "OP10_SQL"),
    ("merkle_manifest", "op11_merkle_manifest", "OP11_SQL"),
    ("mixing", "op12_mixing", "OP12_SQL"),
    ("fill_in_middle", "op13_fill_in_middle", "OP13_SQL"),
]


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {query: getattr(_module(module), query) for module, query, _ in QUERIES}


def oracle_sql() -> dict:
    return {query: getattr(_module(module), sql) for module, query, sql in QUERIES if sql}
