"""Registered queries."""

from __future__ import annotations

from importlib import import_module

from tickerloom.plans.registry import CHECKS, QUERIES, Query

_MODULES = ("q_features", "q_lookup", "q_text", "q_tables", "q_stream")


def _load() -> None:
    for name in _MODULES:
        import_module(f"tickerloom.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
