"""Aggregations over the stored frames. All of them combine before they shuffle."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.fields import change_pct
from tickerloom.functions.keys import time_then_id


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: (table_name, row_count)."""
    counted = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counted)


def count_by(df: DataFrame, col: str, null_in_total_only: bool = False) -> DataFrame:
    """Total and count per value in one pass: (metric, value, n). The total row has a null value."""
    rolled = df.rollup(col).agg(F.count("*").alias("n"), F.grouping(col).alias("g"))
    if null_in_total_only:
        rolled = rolled.filter((F.col("g") == 1) | F.col(col).isNotNull())
    return rolled.select(
        F.when(F.col("g") == 1, F.lit("total")).otherwise(F.lit(col)).alias("metric"), F.col(col).alias("value"), "n"
    )


def data_coverage(bars: DataFrame) -> DataFrame:
    """Bars and distinct tickers, overall and per timeframe."""
    per_ticker = bars.groupBy("timeframe", "ticker").agg(F.count("*").alias("n"))
    by_frame = per_ticker.groupBy("timeframe").agg(
        F.sum("n").alias("bars"), F.count_distinct("ticker").alias("tickers")
    )
    overall = per_ticker.agg(F.sum("n").alias("bars"), F.count_distinct("ticker").alias("tickers"))
    return overall.select(F.lit("all").alias("timeframe"), "bars", "tickers").unionByName(by_frame)


def signal_stats(signals: DataFrame, ticker: str | None = None) -> DataFrame:
    if ticker is not None:
        signals = signals.filter(F.col("ticker") == ticker)
    parts = [F.avg(c).alias(f"avg_{c}") for c in ("sentiment", "novelty", "velocity")]
    return signals.agg(F.count("*").alias("total"), *parts)


def price_stats(bars: DataFrame, as_of: Any, timeframe: str = "1d", days: int = 30) -> DataFrame:
    """Per ticker over the closed interval of ``days`` days up to ``as_of``; bars without a close do not count."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.make_dt_interval(F.lit(days))
    used = bars.filter(
        (F.col("timeframe") == timeframe) & F.col("ts").between(start, end) & F.col("c").isNotNull()
    )
    first, last = F.min_by("c", "ts"), F.max_by("c", "ts")
    return (
        used.groupBy("ticker")
        .agg(
            first.alias("first_c"),
            last.alias("current_price"),
            F.min("c").alias("min_price"),
            F.max("c").alias("max_price"),
            F.coalesce(F.avg("v"), F.lit(0.0)).alias("avg_volume"),
            F.coalesce(F.sum("v"), F.lit(0)).alias("total_volume"),
            F.count("*").alias("data_points"),
        )
        .withColumn("price_change", F.col("current_price") - F.col("first_c"))
        .withColumn("price_change_pct", change_pct(F.col("first_c"), F.col("current_price")))
        .drop("first_c")
    )


def tickers_with_articles(tickers: DataFrame, links: DataFrame, limit: int = 100) -> DataFrame:
    counts = links.groupBy(F.col("ticker").alias("symbol")).agg(F.count("*").alias("article_count"))
    return (
        counts.join(tickers, "symbol").orderBy(F.desc("article_count"), F.asc("symbol")).limit(limit)
    )


def bars_from_ticks(ticks: DataFrame, timeframe: str, unit: str, tie: str, price: str = "value") -> DataFrame:
    """Open, high, low, close and tick count per ticker and time slot; ``tie`` is an id that orders equal times."""
    order = time_then_id(F.col("ts"), F.col(tie))
    return (
        ticks.groupBy("ticker", F.date_trunc(unit, "ts").alias("slot"))
        .agg(
            F.min_by(price, order).alias("o"),
            F.max(price).alias("h"),
            F.min(price).alias("l"),
            F.max_by(price, order).alias("c"),
            F.count("*").alias("v"),
        )
        .select("ticker", F.col("slot").alias("ts"), "o", "h", "l", "c", "v", F.lit(timeframe).alias("timeframe"))
    )


def roll_up_bars(bars: DataFrame, timeframe: str, unit: str) -> DataFrame:
    """Shorter bars to longer ones."""
    return (
        bars.groupBy("ticker", F.date_trunc(unit, "ts").alias("slot"))
        .agg(
            F.min_by("o", "ts").alias("o"),
            F.max("h").alias("h"),
            F.min("l").alias("l"),
            F.max_by("c", "ts").alias("c"),
            F.sum("v").alias("v"),
        )
        .select("ticker", F.col("slot").alias("ts"), "o", "h", "l", "c", "v", F.lit(timeframe).alias("timeframe"))
    )


def heatmap(df: DataFrame, rows: str, bucket: Column, value: str = "score") -> DataFrame:
    """Average value per row key and time bucket, in long form (the set of buckets stays open)."""
    return df.groupBy(rows, bucket.alias("bucket")).agg(
        F.avg(value).alias(f"avg_{value}"), F.count(value).alias("points")
    )
