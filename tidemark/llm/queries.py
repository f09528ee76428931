"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this package whose ``query(spark, sf_dir)`` it is.
MODULES = {
    "op2_byte_bpe": "bpe",
    "op5_simhash": "simhash",
    "op10_mixing": "mixing",
    "op3_pii": "pii",
    "op4_fingerprint": "fingerprint",
    "op9_language_id": "language",
    "op1_toxicity": "toxicity",
    "op8_topk": "topk",
    "op7_passages": "substring",
    "op6_chat": "chat",
    "op11_secrets": "secrets",
    "op12_divergence": "divergence",
    "op13_lexical": "lexical",
}


def queries() -> dict:
    return {name: import_module(f"tidemark.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tidemark.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
