"""Signals: assemble the features of a ticker and hour, score them, name the contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions.keys import stable_id
from tickerloom.operators.features import velocity
from tickerloom.params import ScoreParams


def assemble_signals(mentions: DataFrame, novelties: DataFrame | None, params: ScoreParams) -> DataFrame:
    """One row per ticker and hour: mean sentiment, mean novelty, velocity and the union of tags.

    ``mentions``: article_id, ticker, ts, sentiment, event_tags. All aggregates of an hour are taken in one
    pass; an hour has few different tag lists, whose tags are all kept, with a boost or without.
    """
    hour = F.date_trunc("hour", "ts")
    hourly = mentions.groupBy("ticker", hour.alias("hour")).agg(
        F.avg("sentiment").alias("sentiment"), F.count("*").alias("mentions"), F.collect_set("event_tags").alias("_tags")
    )
    out = velocity(hourly, params.velocity_days).withColumn(
        "event_tags", F.array_sort(F.array_distinct(F.array_compact(F.flatten("_tags"))))
    )
    if novelties is None:
        out = out.withColumn("novelty", F.lit(None).cast("double"))
    else:
        by_hour = novelties.groupBy("ticker", F.date_trunc("hour", "published_at").alias("hour")).agg(
            F.avg("novelty").alias("novelty")
        )
        out = out.join(by_hour, ["ticker", "hour"], "left")
    return out.select(
        signal_id().alias("id"), "ticker", F.col("hour").alias("ts"), "sentiment", "novelty", "velocity", "event_tags"
    )


def signal_id(ticker: str = "ticker", ts: str = "hour") -> Column:
    return stable_id(F.col(ticker), F.unix_seconds(ts).cast("string"))


def tag_boost(tags: Column, params: ScoreParams) -> Column:
    """Sum of the boosts of the distinct tags."""
    total = F.lit(0.0)
    for tag, boost in sorted(params.boosts.items()):
        total = total + F.when(F.coalesce(F.array_contains(tags, tag), F.lit(False)), F.lit(boost)).otherwise(F.lit(0.0))
    return total


def score(signals: DataFrame, params: ScoreParams) -> DataFrame:
    """Weighted sum of the features plus the tag boost; a missing feature counts as 0."""

    def part(col: str, weight: float) -> Column:
        return F.coalesce(F.col(col), F.lit(0.0)) * weight

    total = (
        part("sentiment", params.w_sentiment)
        + part("novelty", params.w_novelty)
        + part("velocity", params.w_velocity)
        + tag_boost(F.col("event_tags"), params)
    )
    return signals.withColumn("score", total)


def contributors(mentions: DataFrame, params: ScoreParams) -> DataFrame:
    """The strongest articles of each signal: (signal_id, article_id, rank, weight).

    An article's strength is its absolute sentiment times link confidence, its weight the share of that in
    the whole signal. Spark keeps the best few per map task before it shuffles, so hot hours stay cheap.
    """
    strength = F.abs(F.coalesce("sentiment", F.lit(0.0))) * F.coalesce("confidence", F.lit(1.0))
    rows = mentions.select("ticker", F.date_trunc("hour", "ts").alias("hour"), "article_id", strength.alias("strength"))
    totals = rows.groupBy("ticker", "hour").agg(F.sum("strength").alias("total"))
    w = W.partitionBy("ticker", "hour").orderBy(F.desc("strength"), F.asc("article_id"))
    best = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= params.contributors)
    return best.join(totals, ["ticker", "hour"]).select(
        signal_id().alias("signal_id"),
        "article_id",
        "rank",
        F.when(F.col("total") > 0, F.col("strength") / F.col("total")).otherwise(F.lit(0.0)).alias("weight"),
    )


def explain(
    signals: DataFrame, contribs: DataFrame, articles: DataFrame, chars: int = 200, article_key: str = "article_id"
) -> DataFrame:
    """Contributing articles of each signal with excerpt, weight and attribution.

    ``article_key`` names the column of ``contribs`` that holds the number of the stored article.
    """
    shown = articles.select(
        F.col("id").alias(article_key), "title", F.substring("text", 1, chars).alias("excerpt"), "source", "license", "url", "retrieved_at"
    )
    keyed = signals.select(F.col("id").alias("signal_id"), "ticker", "ts", "score")
    return contribs.join(shown, article_key).join(keyed, "signal_id")
