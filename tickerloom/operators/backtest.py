"""Join signals to later prices without look-ahead, and measure how well scores rank returns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def forward_returns(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Each bar with the return from its close to the close ``horizon`` bars later (null at the end).

    The window holds one row per ticker and time slot, however many trades stand behind a bar.
    """
    later = F.lead("c", horizon).over(W.partitionBy("ticker", "timeframe").orderBy("ts"))
    ret = F.when(F.col("c") != 0, later / F.col("c") - 1)
    return bars.withColumn("forward_return", ret)


def next_bar(
    events: DataFrame, bars: DataFrame, carry: list[str], ts: str = "ts", chunk_seconds: int = 86400, inclusive: bool = False
) -> DataFrame:
    """As-of join, forward: each event gets the ticker's first bar after its own time, or at it if ``inclusive``.

    Time is cut into chunks. A (ticker, chunk) becomes one row with its bars in order, of which there are no
    more than time slots, and the first bar of the next chunk that has one. Events join that row by equality
    and pick their bar from it. So the events are never sorted or gathered per ticker, and Spark can split the
    rows of a busy ticker over many tasks.

    Adds ``entry_ts`` and the ``carry`` columns of the bar.
    """

    def chunk(col: str) -> Column:
        return F.floor(F.unix_seconds(col) / chunk_seconds).alias("_chunk")

    bar = F.struct(F.col("ts").alias("entry_ts"), *carry)
    held = bars.groupBy("ticker", chunk("ts")).agg(F.sort_array(F.collect_list(bar)).alias("_bars"))
    asked = events.select("ticker", chunk(ts)).distinct()
    first = F.when(F.size("_bars") > 0, F.col("_bars")[0])
    later = W.partitionBy("ticker").orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    chunks = asked.join(held, ["ticker", "_chunk"], "full").withColumn("_next", F.last(first, ignorenulls=True).over(later))

    after = F.filter("_bars", lambda x: (x["entry_ts"] >= F.col(ts)) if inclusive else (x["entry_ts"] > F.col(ts)))
    hit = F.coalesce(F.get(after, 0), F.col("_next"))
    return (
        events.withColumn("_chunk", chunk(ts))
        .join(chunks, ["ticker", "_chunk"], "left")
        .withColumn("_hit", hit)
        .select(*events.columns, "_hit.entry_ts", *[F.col(f"_hit.{c}").alias(c) for c in carry])
    )


def signal_returns(
    signals: DataFrame,
    bars: DataFrame,
    timeframe: str,
    horizon: int = 1,
    chunk_seconds: int = 86400,
    signal_seconds: int = 3600,
    sessions: bool = False,
) -> DataFrame:
    """Signals with known_at, entry bar and forward return.

    A signal covers ``signal_seconds`` from its time on and is known at their end; its entry is the first bar that
    begins then or later. With ``sessions``, only bars within market hours count, for entry and for return.
    """
    own = bars.filter(F.col("timeframe") == timeframe)
    if sessions:
        own = own.filter(in_session(F.col("ts")))
    known = signals.withColumn("known_at", F.col("ts") + F.make_dt_interval(secs=F.lit(signal_seconds)))
    priced = forward_returns(own, horizon)
    return next_bar(known, priced, ["c", "forward_return"], "known_at", chunk_seconds, True).withColumnRenamed("c", "entry_close")


#: Regular hours of the market in its own time, in minutes after midnight.
MARKET_ZONE, MARKET_OPEN, MARKET_CLOSE = "America/New_York", 570, 960


def in_session(ts: Column) -> Column:
    """Whether an instant lies within regular market hours: Monday to Friday, daylight saving as it is there."""
    local = F.from_utc_timestamp(ts, MARKET_ZONE)
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & (minute >= MARKET_OPEN) & (minute < MARKET_CLOSE)


def look_ahead_rows(returns: DataFrame, known_at: str = "known_at") -> DataFrame:
    """Rows that were entered before their signal was known; a sound join has none."""
    return returns.filter(F.col("entry_ts") < F.col(known_at))


def cross_rank(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Rank within a date, ties at their mean rank, and decile of that rank.

    The frame holds one row per ticker and date, so a date is as large as the ticker universe.
    """
    w = W.partitionBy(by)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(by, value)) - 1) / 2
    ranked = df.filter(F.col(value).isNotNull()).withColumn(out, rank)
    decile = F.floor((F.col(out) - 1) * 10 / F.count("*").over(w)) + 1
    return ranked.withColumn(f"{out}_decile", decile.cast("int"))


def daily_scores(signals: DataFrame) -> DataFrame:
    """Mean score per ticker and day, dated at the last signal of the day."""
    return signals.groupBy("ticker", F.to_date("ts").alias("date")).agg(
        F.avg("score").alias("score"), F.max("ts").alias("ts")
    )


def _ranked(returns: DataFrame, by: str) -> DataFrame:
    used = returns.filter(F.col("score").isNotNull() & F.col("forward_return").isNotNull())
    return cross_rank(cross_rank(used, by, "score", "score_rank"), by, "forward_return", "return_rank")


def _rank_correlation() -> Column:
    spread = (F.stddev_pop("score_rank") > 0) & (F.stddev_pop("return_rank") > 0)
    return F.when(spread, F.corr("score_rank", "return_rank"))


def information_coefficient(returns: DataFrame, by: str = "date") -> DataFrame:
    """Spearman correlation of score and forward return per date."""
    return _ranked(returns, by).groupBy(by).agg(_rank_correlation().alias("ic"), F.count("*").alias("names"))


def decile_returns(returns: DataFrame, by: str = "date") -> DataFrame:
    """Mean forward return per score decile."""
    used = returns.filter(F.col("score").isNotNull() & F.col("forward_return").isNotNull())
    return (
        cross_rank(used, by, "score", "score_rank")
        .groupBy(F.col("score_rank_decile").alias("decile"))
        .agg(F.avg("forward_return").alias("mean_return"), F.count("*").alias("names"))
    )


def _same_sign(a: Column, b: Column) -> Column:
    return (F.signum(a) == F.signum(b)).cast("double")


def hit_rate(returns: DataFrame) -> DataFrame:
    """Share of signals whose score and forward return have the same sign."""
    used = returns.filter(F.col("score").isNotNull() & F.col("forward_return").isNotNull())
    return used.agg(
        F.avg(_same_sign(F.col("score"), F.col("forward_return"))).alias("hit_rate"), F.count("*").alias("signals")
    )


def report_json(report: DataFrame) -> DataFrame:
    """A report as one JSON object per row, in the column ``json``; measures that are null are left out."""
    return report.select(F.to_json(F.struct("*")).alias("json"))


def backtest_report(
    returns: DataFrame, universe: DataFrame | None = None, start: Any = None, end: Any = None, by: str = "date"
) -> DataFrame:
    """One row: mean IC, top-decile return, hit rate. A universe frame restricts the tickers, a closed window the dates."""
    if start is not None:
        returns = returns.filter(F.col(by) >= F.lit(start))
    if end is not None:
        returns = returns.filter(F.col(by) <= F.lit(end))
    if universe is not None:
        returns = returns.join(universe.select("ticker"), "ticker", "left_semi")
    ranked = _ranked(returns, by)
    top = F.col("score_rank_decile") == 10
    # All measures come out of one pass over the ranked rows.
    per_date = ranked.groupBy(by).agg(
        _rank_correlation().alias("ic"),
        F.sum(F.when(top, F.col("forward_return"))).alias("top_return"),
        F.count_if(top).alias("top_names"),
        F.sum(_same_sign(F.col("score"), F.col("forward_return"))).alias("hits"),
        F.count("*").alias("names"),
    )
    return per_date.agg(
        F.avg("ic").alias("mean_ic"),
        F.try_divide(F.sum("top_return"), F.sum("top_names")).alias("top_decile_return"),
        F.try_divide(F.sum("hits"), F.sum("names")).alias("hit_rate"),
        F.coalesce(F.sum("names"), F.lit(0)).alias("signals"),
    )
