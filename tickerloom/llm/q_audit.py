"""Five filters on all documents, in all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import table
from tickerloom.llm.filter_audit import audit
from tickerloom.llm.registry import query

#: Each order is walked, and each document's removal is the first step that it fails.
_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
w AS (SELECT t.*, least, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS words FROM t JOIN least USING (text)),
m AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
    FROM w LEFT JOIN m USING (doc_id)
),
cells AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
f(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM f a, f b, f c, f d, f e
    WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
),
gone AS (
    SELECT part, filter_order, failed, n, good, toxic,
        CASE WHEN failed = '' THEN 6 ELSE list_min(list_transform(string_split(failed, ''), lambda x: strpos(filter_order, x))) END AS place
    FROM cells, orders
),
steps AS (
    SELECT part, filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS letter,
        sum(CASE WHEN place > step THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN place = step THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN place < step AND contains(failed, substr(filter_order, step::INT, 1)) THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN failed = substr(filter_order, step::INT, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN place = step THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN place = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM gone, range(1, 6) r(step)
    GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM steps
"""


@query("op11_filter_audit", _SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the 120 orders of five filters, for each language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
