"""Registered queries of this subpackage, each next to the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import pin_batches
from tickerloom.session import pin_session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

_MODULES = ("q_simhash", "q_exact", "q_quality", "q_toxicity", "q_decontaminate", "q_urls", "q_lm", "q_html", "q_language", "q_bpe", "q_audit", "q_warc", "q_negatives")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_batches(pin_session(spark)), sf_dir.rstrip("/"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def all_queries() -> dict[str, Query]:
    for name in _MODULES:
        import_module(f"tickerloom.llm.{name}")
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    all_queries()
    return dict(CHECKS)
