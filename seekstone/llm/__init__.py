"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> function) and ORACLE (name -> DuckDB SQL), by operator number.
MODULES = ("mixing", "line_dedup", "quality", "toxicity", "lm", "pii", "warc", "bpe", "minhash", "gif", "ngram_join", "filter_audit")


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"{__name__}.{name}"), kind))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
