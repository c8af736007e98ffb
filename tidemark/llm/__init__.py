"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ["url_filter", "line_dedup", "mixing", "quality", "near_dedup", "pii", "chat", "sharding", "decontam", "language_id"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLE.items()}
