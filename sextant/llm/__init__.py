"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and SQL, one per operator.
MODULES = ("bpe", "quality", "secrets", "token_counts", "mpeg", "bagminhash", "line_dedup", "paragraphs", "mixing", "langid", "conversation_trie", "spelling", "page_text")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"{__name__}.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
