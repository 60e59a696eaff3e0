"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: query name -> module that has it
QUERIES = {
    "op3_embedding_dedup": "embedding_dedup",
    "op5_suffix_dedup": "suffix_dedup",
    "op6_line_dedup": "line_dedup",
    "op10_minhash": "minhash",
    "op8_warc": "warc",
    "op1_mixing": "mixing",
    "op4_token_counts": "token_counts",
    "op7_sentencepiece": "sentencepiece_codec",
    "op2_toxicity": "toxicity",
    "op9_quality_rules": "quality_rules",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in QUERIES.values():
        found |= getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", {})
    return found
