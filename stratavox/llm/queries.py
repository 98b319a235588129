"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: Query name, module and function.
_OPS = {
    "op1_secret_scan": "secrets",
    "op2_ngram_join": "ngram_join",
    "op3_token_shards": "token_shards",
    "op4_pii": "pii",
    "op5_byte_bpe": "bpe",
    "op6_quality_rules": "quality",
    "op7_substring_dedup": "substring_dedup",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_packing": "packing",
    "op10_exact_dedup": "exact_dedup",
    "op11_conversation_repair": "conversations",
    "op12_html_extraction": "html",
    "op13_periodic_runs": "periodic",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    """SQL on whole tables. The others are tested against brute force: SQL finds neither spans with offsets nor tokens, and strings of 100 bytes at every place are too many for it."""
    from . import sql

    return {"op2_ngram_join": sql.NGRAM_JOIN, "op6_quality_rules": sql.QUALITY_RULES, "op7_substring_dedup": sql.SUBSTRING_DEDUP, "op10_exact_dedup": sql.EXACT_DEDUP}
