"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

NAMES = {
    "op1_tokens": "op1_tokens",
    "op2_toxicity": "op2_toxicity",
    "op3_language": "op3_language",
    "op4_substrings": "op4_substrings",
    "op5_simhash": "op5_simhash",
    "op6_semantic": "op6_semantic",
    "op7_transport": "op7_transport",
    "op8_warc": "op8_warc",
    "op9_packing": "op9_packing",
    "op10_slots": "op10_slots",
    "op11_merkle": "op11_merkle",
    "op12_bpe": "op12_bpe",
    "op13_negatives": "op13_negatives",
}


def queries() -> dict:
    return {name: getattr(import_module(f"voxelspark.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict:
    from voxelspark.llm.sql import SQL

    return {k: v for k, v in SQL.items() if k in NAMES}
