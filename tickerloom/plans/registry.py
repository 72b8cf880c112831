"""Registered queries, each next to the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.plans.check_views import VIEWS
from tickerloom.session import pin_session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Hand timestamps out without a zone, as the checking engine has them."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def with_views(body: str) -> str:
    """Put the views a statement refers to, directly or not, in front of it."""
    needed: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\bv_\w+", sql):
            if name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(body)
    if not needed:
        return body
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(fn(pin_session(spark), sf_dir.rstrip("/")))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return fn

    return register
