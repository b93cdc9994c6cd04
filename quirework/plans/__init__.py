"""Registered queries, grouped by the kind of data they read."""

from __future__ import annotations

from importlib import import_module

from quirework.plans.registry import REGISTRY, Query

_MODULES = ("text_queries", "structure_queries", "page_queries", "ledger_queries", "assembly_queries")


def load_queries() -> dict[str, Query]:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
