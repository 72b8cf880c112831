"""SimHash near-duplicates over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import table
from tickerloom.llm.registry import query
from tickerloom.llm.simhash import near_duplicates


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
