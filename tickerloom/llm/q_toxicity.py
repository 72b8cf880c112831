"""Toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import toxicity
from tickerloom.llm.common import table
from tickerloom.llm.registry import query


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
