"""Filters, lookups and the joins behind them. Every limit orders by a tie-breaking key as well."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    return df.orderBy(*order).limit(limit) if limit else df


def scan(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows; no limit or a zero limit means all."""
    return df.limit(limit) if limit else df


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def exists_flags(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    present = df.select(key).distinct().withColumn("present", F.lit(True))
    return keys.join(present, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def find_by(df: DataFrame, limit: int | None = None, order_by: str | None = None, **equal: Any) -> DataFrame:
    """Rows equal on every given column; a null value is no condition, an unknown column is an error."""
    for name, value in equal.items():
        if name not in df.columns:
            raise ValueError(f"no such column: {name}")
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    if order_by:
        df = df.orderBy(order_by)
    return df.limit(limit) if limit else df


def in_range(df: DataFrame, col: str, start: Any = None, end: Any = None) -> DataFrame:
    """Closed interval; either bound may be missing."""
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(col) <= F.lit(end).cast("timestamp"))
    return df


def in_list(df: DataFrame, col: str, values: Sequence[str] | DataFrame | None) -> DataFrame:
    """A short list becomes a predicate, a frame of values a semi join; no list is no condition."""
    if values is None:
        return df
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)), col, "left_semi")
    return df.filter(F.col(col).isin(list(values))) if values else df


def newest(df: DataFrame, ts: str, key: str, limit: int | None) -> DataFrame:
    return _top(df, [F.desc_nulls_last(ts), F.asc(key)], limit)


# Articles

def recent_articles(articles: DataFrame, limit: int = 100) -> DataFrame:
    return newest(articles, "published_at", "id", limit)


def article_by_url(articles: DataFrame, url: str) -> DataFrame:
    return articles.filter(F.col("url") == url)


def articles_by_source(articles: DataFrame, source: str, limit: int = 100) -> DataFrame:
    return newest(articles.filter(F.col("source") == source), "published_at", "id", limit)


def articles_by_range(articles: DataFrame, start: Any, end: Any, limit: int = 100) -> DataFrame:
    return newest(in_range(articles, "published_at", start, end), "published_at", "id", limit)


def articles_by_ticker(articles: DataFrame, links: DataFrame, ticker: str, limit: int = 100) -> DataFrame:
    ids = links.filter(F.col("ticker") == ticker).select(F.col("article_id").alias("id"))
    return newest(articles.join(ids, "id"), "published_at", "id", limit)


def articles_with_tickers(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Each article with its ticker list, sorted, empty when it has no link (one link per ticker at most)."""
    nested = links.groupBy(F.col("article_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("ticker", "confidence", "method"))).alias("tickers")
    )
    empty = F.array().cast(nested.schema["tickers"].dataType)
    return articles.join(nested, "id", "left").withColumn("tickers", F.coalesce("tickers", empty))


# Embeddings

def embeddings_by_model(embeds: DataFrame, model: str, limit: int = 100) -> DataFrame:
    return _top(embeds.filter(F.col("model") == model), [F.asc("article_id")], limit)


def recent_embeddings_for_ticker(
    embeds: DataFrame, articles: DataFrame, links: DataFrame, ticker: str, since: Any, limit: int = 100
) -> DataFrame:
    """One row per embedding, however many links its article has."""
    recent = in_range(articles, "published_at", since).select(F.col("id").alias("article_id"), "published_at")
    linked = links.filter(F.col("ticker") == ticker).select("article_id")
    found = embeds.join(recent, "article_id").join(linked, "article_id", "left_semi")
    return newest(found, "published_at", "article_id", limit)


# Price bars

def bars_by_ticker(
    bars: DataFrame, ticker: str, start: Any = None, end: Any = None, timeframe: str | None = None, limit: int = 1000
) -> DataFrame:
    found = in_range(find_by(bars, ticker=ticker, timeframe=timeframe), "ts", start, end)
    return newest(found, "ts", "timeframe", limit)


def bars_by_timeframe(bars: DataFrame, ticker: str, timeframe: str, limit: int = 1000) -> DataFrame:
    return newest(find_by(bars, ticker=ticker, timeframe=timeframe), "ts", "timeframe", limit)


def bars_by_range(
    bars: DataFrame,
    start: Any,
    end: Any,
    tickers: Sequence[str] | DataFrame | None = None,
    timeframe: str | None = None,
    limit: int = 10000,
) -> DataFrame:
    found = in_list(in_range(find_by(bars, timeframe=timeframe), "ts", start, end), "ticker", tickers)
    return _top(found, [F.desc_nulls_last("ts"), F.asc("ticker"), F.asc("timeframe")], limit)


def ohlcv(bars: DataFrame, ticker: str, start: Any, end: Any, timeframe: str = "1d") -> DataFrame:
    found = in_range(find_by(bars, ticker=ticker, timeframe=timeframe), "ts", start, end)
    return found.select(
        F.col("ts").alias("timestamp"),
        F.col("o").alias("open"),
        F.col("h").alias("high"),
        F.col("l").alias("low"),
        F.col("c").alias("close"),
        F.col("v").alias("volume"),
    ).orderBy("timestamp")


def latest_per_ticker(df: DataFrame, keys: Sequence[str] = ("ticker",), ts: str = "ts") -> DataFrame:
    """The newest row of every ticker; one ticker is the same after a filter."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(ts))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def tickers_with_data(bars: DataFrame, timeframe: str | None = None) -> DataFrame:
    return find_by(bars, timeframe=timeframe).select("ticker").distinct()


# Signals

def signals_by_ticker(
    signals: DataFrame, ticker: str, start: Any = None, end: Any = None, limit: int = 100
) -> DataFrame:
    return newest(in_range(find_by(signals, ticker=ticker), "ts", start, end), "ts", "id", limit)


def signals_by_range(
    signals: DataFrame, start: Any, end: Any, tickers: Sequence[str] | DataFrame | None = None, limit: int = 1000
) -> DataFrame:
    return newest(in_list(in_range(signals, "ts", start, end), "ticker", tickers), "ts", "id", limit)


def signals_by_score(signals: DataFrame, threshold: float, limit: int = 100) -> DataFrame:
    return newest(signals.filter(F.col("score") >= threshold), "score", "id", limit)


def signals_by_tags(signals: DataFrame, tags: Sequence[str], limit: int = 100) -> DataFrame:
    """Signals that hold every given tag; an empty list is no condition."""
    for tag in tags:
        signals = signals.filter(F.array_contains("event_tags", tag))
    return newest(signals, "ts", "id", limit)


def signals_page(
    signals: DataFrame,
    ticker: str | None = None,
    start: Any = None,
    end: Any = None,
    after: tuple[Any, int] | None = None,
    page: int = 100,
) -> DataFrame:
    """One page in (ts, id) descending order, starting after the last row of the page before."""
    found = in_range(find_by(signals, ticker=ticker), "ts", start, end)
    if after is not None:
        ts, last_id = F.lit(after[0]).cast("timestamp"), after[1]
        found = found.filter((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < last_id)))
    return _top(found, [F.desc_nulls_last("ts"), F.desc("id")], page)


def signals_with_contribs(signals: DataFrame, contribs: DataFrame) -> DataFrame:
    """Each signal with its contributions by rank, missing ranks last (a signal keeps a few contributors)."""
    nested = contribs.groupBy(F.col("signal_id").alias("id")).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("rank").isNull().alias("unranked"), F.col("rank"), F.col("article_id")))
        ).alias("_c")
    )
    items = F.transform("_c", lambda c: F.struct(c["rank"].alias("rank"), c["article_id"].alias("article_id")))
    joined = signals.join(nested, "id", "left")
    listed = joined.withColumn("contributions", items).drop("_c")
    empty = F.array().cast(listed.schema["contributions"].dataType)
    return listed.withColumn("contributions", F.coalesce("contributions", empty))


def with_flags(signals: DataFrame, rising_z: float, fresh: float) -> DataFrame:
    return signals.withColumn("rising", F.coalesce(F.col("velocity") >= rising_z, F.lit(False))).withColumn(
        "fresh", F.coalesce(F.col("novelty") >= fresh, F.lit(False))
    )


# Ticker dimension

def active_tickers(tickers: DataFrame, as_of: Any = None) -> DataFrame:
    """Without a date the open-ended tickers; with one those whose half-open validity holds it."""
    if as_of is None:
        return tickers.filter(F.col("valid_to").isNull())
    day = F.lit(as_of).cast("date")
    return tickers.filter(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= day))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > day))
    )


def tickers_point_in_time(facts: DataFrame, tickers: DataFrame, ts: str = "ts") -> DataFrame:
    """Facts with the ticker attributes valid at their own time."""
    day = F.to_date(ts)
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (
        F.col("valid_to").isNull() | (F.col("valid_to") > day)
    )
    return facts.join(tickers, facts["ticker"] == tickers["symbol"]).filter(valid)


def find_by_alias(tickers: DataFrame, aliases: DataFrame) -> DataFrame:
    """The symbol behind each alias, exact and case-sensitive; the smallest symbol where several match."""
    exploded = tickers.select("symbol", F.explode("aliases").alias("alias"))
    return exploded.join(aliases.select("alias"), "alias", "left_semi").groupBy("alias").agg(
        F.min("symbol").alias("symbol")
    )


def alias_map(tickers: DataFrame) -> DataFrame:
    return tickers.filter(F.col("aliases").isNotNull()).select("symbol", "aliases")


def restrict_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    return df.join(universe.select("ticker"), "ticker", "left_semi")
