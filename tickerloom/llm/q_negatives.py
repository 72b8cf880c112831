"""Hard negatives of a fiftieth of the embeddings, among all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import table
from tickerloom.llm.hard_negatives import mine
from tickerloom.llm.registry import query

#: Every anchor with every row.
_SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, list_dot_product(a.v, e.v)::BIGINT AS score
    FROM e a JOIN e ON a.vec_id <> e.vec_id
    WHERE a.vec_id % 50 = 0
),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_hard_negatives", _SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three negatives for each of up to five positives of each anchor."""
    embeds = table(spark, sf_dir, "embeddings")
    label, vec_id = embeds["label"], embeds["vec_id"]
    moved = embeds.withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(moved)
