"""Language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import language
from tickerloom.llm.common import table
from tickerloom.llm.registry import query


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    return language.language(docs, language.fit(docs))
