"""Queries and SQL of this subpackage, collected for ``__spark_entry__.py``."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("lookalike", "boilerplate", "quality", "repair", "languages", "bpe", "packing", "spam")


def queries() -> dict:
    out = {}
    for name in _MODULES:
        module = import_module(f"leafmill.llm.{name}")
        out |= {k: v for k, v in vars(module).items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}
    return out


def oracle_sql() -> dict:
    """SQL where it can express a result; the other queries are tested against brute force, round trips and fixtures."""
    out = {}
    for name in _MODULES:
        out |= getattr(import_module(f"leafmill.llm.{name}"), "SQL", {})
    return out
