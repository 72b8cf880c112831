"""Archives of all pages, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import table
from tickerloom.llm.registry import query
from tickerloom.llm.warc import read_archives, write_archives

#: Base 32 takes five bits a letter: four letters of every five hexadecimal digits.
_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
    SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
        row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS n,
        first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first
    FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(hex, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::INT, 1)),
        'string_agg', '') AS payload_digest,
    CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN n > 1 THEN first END AS refers_to
FROM d
"""


@query("op12_warc", _SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as read back from the archives."""
    pages = table(spark, sf_dir, "pages")
    got = read_archives(write_archives(pages), dict(pages.dtypes)["page_id"])
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
