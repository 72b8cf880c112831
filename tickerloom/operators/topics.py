"""Topics that keep their identity: clusters of each day, matched with those of the day before.

A day's centres are fitted on a bounded sample of it, and all of its articles go to the nearest. A cluster goes on with the topic
of the cluster before it when each is the other's most similar one and they are similar enough; else it begins a topic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions.vectors import dot, unit
from tickerloom.session import stored


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    """Rows to begin with: the one nearest to the mean, then always the one farthest from all so far."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    nearest = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    return x[picked]


def _directions(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centres of unit vectors, themselves of length 1; one that loses its rows stays."""
    centres = _spread(x, k)
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([np.bincount(of, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def _merged(x: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """Centres of which no two are as similar as a topic and its next day must be."""
    size = np.bincount(np.argmax(x @ centres.T, axis=1), minlength=len(centres))
    centres, size = centres[size > 0], size[size > 0]
    while len(centres) > 1:
        alike = centres @ centres.T - 2 * np.eye(len(centres))
        a, b = sorted(np.unravel_index(np.argmax(alike), alike.shape))
        if alike[a, b] < least:
            break
        both = size[a] * centres[a] + size[b] * centres[b]
        centres[a], size[a] = both / np.linalg.norm(both), size[a] + size[b]
        centres, size = np.delete(centres, b, axis=0), np.delete(size, b)
    return centres


def daily_centres(embeds: DataFrame, per_day: int = 8, least: float = 0.8, sample_rows: int = 4096) -> DataFrame:
    """``date``, ``cluster``, ``centre``: ``per_day`` centres at most, from the articles of the day whose ids hash lowest."""

    def fit(day: pd.DataFrame) -> pd.DataFrame:
        vecs = np.stack(day.sort_values("article_id")["vec"].to_numpy())
        centres = _merged(vecs, _directions(vecs, per_day), least)
        return pd.DataFrame({"date": day["date"].iloc[0], "cluster": np.arange(len(centres), dtype="int32"), "centre": list(centres)})

    vecs = embeds.select("article_id", F.to_date("published_at").alias("date"), unit(F.col("embedding")).alias("vec"))
    by_hash = W.partitionBy("date").orderBy(F.xxhash64("article_id"), "article_id")
    some = vecs.filter("vec is not null and date is not null").withColumn("_n", F.row_number().over(by_hash))
    sampled = some.filter(F.col("_n") <= sample_rows).drop("_n")
    return sampled.groupBy("date").applyInPandas(fit, "date date, cluster int, centre array<double>")


def _successors(centres: DataFrame, least: float) -> DataFrame:
    """``node`` and the ``parent`` that it goes on from, both as day and cluster; of the last day before that has articles."""
    days = centres.select("date").distinct()
    before = days.withColumn("day_before", F.lag("date").over(W.orderBy("date")))  # a row per day
    node = F.concat_ws("/", F.col("date").cast("string"), F.col("cluster").cast("string"))
    named = centres.join(before, "date").select(node.alias("node"), "date", "day_before", "centre")
    old = named.select(F.col("node").alias("parent"), F.col("date").alias("day_before"), F.col("centre").alias("_old"))
    pairs = named.join(old, "day_before").select("node", "parent", dot(F.col("centre"), F.col("_old")).alias("alike"))
    best = [
        F.row_number().over(W.partitionBy(one).orderBy(F.desc("alike"), other)).alias(f"_{one}")
        for one, other in (("node", "parent"), ("parent", "node"))
    ]
    mutual = pairs.filter(F.col("alike") >= least).select("node", "parent", *best)
    links = mutual.filter("_node = 1 and _parent = 1").select("node", "parent")
    return named.select("node").join(links, "node", "left")


def topic_names(centres: DataFrame, least: float = 0.8) -> DataFrame:
    """``node`` (day and cluster) and its ``topic``, named after the node where it began.

    Each round follows twice as many steps back as the round before.
    """
    steps = stored(_successors(centres, least).select("node", F.coalesce("parent", "node").alias("topic")), "topic-steps")
    while True:
        further = steps.select(F.col("node").alias("topic"), F.col("topic").alias("_first"))
        after = stored(steps.join(further, "topic").select("node", F.col("_first").alias("topic"), (F.col("topic") != F.col("_first")).alias("_moved")), "topic-steps")
        steps = after.select("node", "topic")
        if after.filter("_moved").isEmpty():
            return steps


def topics(embeds: DataFrame, per_day: int = 8, least: float = 0.8, sample_rows: int = 4096) -> DataFrame:
    """Add ``date`` and ``topic`` to each article that has a time and a vector with a length."""
    centres = stored(daily_centres(embeds, per_day, least, sample_rows), "topic-centres")
    node = F.concat_ws("/", F.col("date").cast("string"), F.col("cluster").cast("string"))
    named = centres.withColumn("node", node).join(topic_names(centres, least), "node")
    of_day = named.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("cluster", "topic", "centre"))).alias("_topics"))
    dated = embeds.withColumn("date", F.to_date("published_at")).withColumn("_vec", unit(F.col("embedding"))).filter("_vec is not null")
    rated = F.transform("_topics", lambda t: F.struct(dot(F.col("_vec"), t["centre"]).alias("alike"), (-t["cluster"]).alias("n"), t["topic"].alias("topic")))
    return dated.join(of_day, "date").withColumn("topic", F.array_max(rated)["topic"]).drop("_vec", "_topics")
