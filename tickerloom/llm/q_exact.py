"""Exact duplicates over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import table
from tickerloom.llm.exact_dedup import exact_duplicates
from tickerloom.llm.registry import query


@query(
    "op2_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
            sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size,
        doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM d
    WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, which document of its group of equal texts stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))
