"""Similar articles by cosine: one query vector, one stored article, and many queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions.vectors import cosine, unit
from tickerloom.session import stored


def similar_to_vector(embeds: DataFrame, query: Sequence[float], limit: int = 10, threshold: float = 0.7) -> DataFrame:
    """Articles more similar than the threshold, best first."""
    vector = F.lit([float(x) for x in query])
    scored = embeds.select("article_id", cosine(F.col("embedding"), vector).alias("similarity"))
    return scored.filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "article_id").limit(limit)


def similar_to_article(embeds: DataFrame, article_id: int, limit: int = 10, threshold: float = 0.7) -> DataFrame:
    """As above against a stored vector, the article itself left out; an unknown id gives no rows."""
    own = embeds.filter(F.col("article_id") == article_id).select("embedding").scalar()
    others = embeds.filter(F.col("article_id") != article_id).withColumn("_stored", own)
    scored = others.select("article_id", cosine(F.col("embedding"), F.col("_stored")).alias("similarity"))
    return scored.filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "article_id").limit(limit)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "article_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_TOPK_SCHEMA = "query_id bigint, article_id bigint, similarity double"


def similar_topk(
    embeds: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.7, block_rows: int = 4096
) -> DataFrame:
    """Exact top k for every row of ``queries`` (query_id, embedding), an article never matching itself.

    Queries go to the tasks in blocks of at most ``block_rows``, and every block passes over the embeddings where they
    lie: these are never shuffled, and a task hands on k rows per query of the block at most.
    """
    asked = stored(
        queries.select("query_id", unit(F.col("embedding")).alias("vec")).filter("vec is not null")
        .withColumn("_n", F.monotonically_increasing_id()),
        "similar-queries",
    )
    articles = embeds.select("article_id", unit(F.col("embedding")).alias("vec")).filter("vec is not null")
    found, last = None, -1
    while True:
        # The next block in the order of the row numbers, a bounded read.
        rows = asked.filter(F.col("_n") > last).orderBy("_n").limit(block_rows).collect()
        if not rows:
            break
        last = rows[-1]._n
        block = embeds.sparkSession.sparkContext.broadcast(
            (np.array([r.query_id for r in rows]), np.array([r.vec for r in rows], dtype="float64"))
        )
        part = articles.mapInPandas(_topk_of_block(block, k, threshold), _TOPK_SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return _best(embeds.sparkSession.createDataFrame([], _TOPK_SCHEMA), k)
    return _best(found, k)


#: Queries and articles that are compared at a time: bounds the memory of a task, however many of them are similar.
_QUERIES, _ARTICLES = 512, 1024


def _topk_of_block(block, k: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vecs = block.value
        sims = np.full((len(ids), k), -np.inf)
        articles = np.full((len(ids), k), np.iinfo("int64").max)
        for batch in batches:
            for at in range(0, len(batch), _ARTICLES):
                part = batch.iloc[at : at + _ARTICLES]
                own, those = np.stack(part["vec"].to_numpy()).T, part["article_id"].to_numpy()
                for i in range(0, len(ids), _QUERIES):
                    rows = slice(i, i + _QUERIES)
                    _merge(sims[rows], articles[rows], vecs[rows] @ own, those, ids[rows], threshold)
        q, j = np.nonzero(np.isfinite(sims))
        found = pd.DataFrame({"query_id": ids[q], "article_id": articles[q, j], "similarity": sims[q, j]})
        yield found.astype({"query_id": "int64", "article_id": "int64", "similarity": "float64"})

    return run


def _merge(best: np.ndarray, best_ids: np.ndarray, sims: np.ndarray, those: np.ndarray, ids: np.ndarray, threshold: float) -> None:
    """Put articles into the rows of the best, ordered by similarity and id, if they are better than the last there."""
    k = best.shape[1]
    better = (sims > best[:, -1:]) | ((sims == best[:, -1:]) & (those[None, :] < best_ids[:, -1:]))
    q, a = np.nonzero(better & (sims > threshold) & (those[None, :] != ids[:, None]))
    rows = np.unique(q)
    of = np.concatenate([np.repeat(rows, k), q])
    value = np.concatenate([best[rows].ravel(), sims[q, a]])
    name = np.concatenate([best_ids[rows].ravel(), those[a]])
    order = np.lexsort((name, -value, of))
    first = order[np.searchsorted(of[order], rows)[:, None] + np.arange(k)]
    best[rows], best_ids[rows] = value[first], name[first]
