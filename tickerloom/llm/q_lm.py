"""Language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import table
from tickerloom.llm.katz import score_texts
from tickerloom.llm.registry import query


@query("op7_katz")
def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and Katz score of every document, learned outside fold 1 of 5."""
    return score_texts(table(spark, sf_dir, "documents"))
