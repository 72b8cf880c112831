"""Benchmark items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import table
from tickerloom.llm.decontaminate import contaminated
from tickerloom.llm.registry import query


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
