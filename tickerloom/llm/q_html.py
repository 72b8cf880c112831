"""Main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import table
from tickerloom.llm.html_text import main_texts
from tickerloom.llm.registry import query


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))
