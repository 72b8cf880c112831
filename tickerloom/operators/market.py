"""The market's calendar: holidays and early closes by rule, sessions in order, and returns counted in sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.operators.backtest import MARKET_CLOSE, MARKET_OPEN, MARKET_ZONE, next_bar

#: Minute after midnight at which the market closes on half days.
EARLY_CLOSE = 780


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month, counted from its end if n is negative."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7 + 7 * (-n - 1))


def _easter(year: int) -> dt.date:
    """Gregorian Easter Sunday, by the golden number, the century's corrections and the moon's epact."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon = epact - (epact // 28) * (1 - (epact // 28) * (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    day = moon - weekday
    month = 3 + (day + 40) // 44
    return dt.date(year, month, day + 28 - 31 * (month // 4))


def market_holidays(year: int) -> set[dt.date]:
    """Days on which the market stays closed: a Saturday's holiday moves to Friday, a Sunday's to Monday.

    New Year's Day is not moved into the old year.
    """
    fixed = [dt.date(year, 7, 4), dt.date(year, 12, 25)] + ([dt.date(year, 6, 19)] if year >= 2022 else [])
    moved = {d - dt.timedelta(days=1) if d.weekday() == 5 else d + dt.timedelta(days=1) if d.weekday() == 6 else d for d in fixed}
    new_year = dt.date(year, 1, 1)
    if new_year.weekday() != 5:
        moved.add(new_year + dt.timedelta(days=1) if new_year.weekday() == 6 else new_year)
    floating = {
        _nth_weekday(year, 1, 0, 3),
        _nth_weekday(year, 2, 0, 3),
        _easter(year) - dt.timedelta(days=2),
        _nth_weekday(year, 5, 0, -1),
        _nth_weekday(year, 9, 0, 1),
        _nth_weekday(year, 11, 3, 4),
    }
    return moved | floating


def half_days(year: int) -> set[dt.date]:
    """Days of an early close: before Independence Day and Christmas, and after Thanksgiving, if the market opens."""
    days = {dt.date(year, 7, 3), dt.date(year, 12, 24), _nth_weekday(year, 11, 3, 4) + dt.timedelta(days=1)}
    return {d for d in days if d.weekday() < 5} - market_holidays(year)


def sessions(
    spark: SparkSession, first: dt.date, last: dt.date, closed: set[dt.date] | None = None, early: set[dt.date] | None = None
) -> DataFrame:
    """``session`` (a date), ``ordinal`` in order, and ``opens``, ``closes`` as instants, from a day to a day.

    ``closed`` and ``early`` add to the days that the rules give; ``closed`` wins. A row per trading day.
    """
    years = range(first.year, last.year + 1)
    shut = (closed or set()).union(*(market_holidays(y) for y in years))
    half = (early or set()).union(*(half_days(y) for y in years))
    days = [first + dt.timedelta(days=n) for n in range((last - first).days + 1)]
    open_days = [d for d in days if d.weekday() < 5 and d not in shut]
    rows = [(d, n, EARLY_CLOSE if d in half else MARKET_CLOSE) for n, d in enumerate(open_days)]
    local = spark.createDataFrame(rows, "session date, ordinal int, closing int")

    def instant(minute: Column) -> Column:
        at = F.col("session").cast("timestamp") + F.make_dt_interval(mins=minute)
        return F.to_utc_timestamp(at, MARKET_ZONE)

    return local.select("session", "ordinal", instant(F.lit(MARKET_OPEN)).alias("opens"), instant(F.col("closing")).alias("closes"))


def in_sessions(bars: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows within a session, with its date and ordinal. The calendar has a row a day, and Spark picks how to join it."""
    local = F.to_date(F.from_utc_timestamp(ts, MARKET_ZONE))
    placed = bars.withColumn("session", local).join(calendar, "session")
    return placed.filter((F.col(ts) >= F.col("opens")) & (F.col(ts) < F.col("closes"))).drop("opens", "closes")


def session_returns(
    signals: DataFrame, bars: DataFrame, calendar: DataFrame, horizon: int = 1, signal_seconds: int = 3600, chunk_seconds: int = 86400
) -> DataFrame:
    """Signals with ``known_at``, their entry bar, and the return to the close ``horizon`` market sessions after the entry's.

    The entry is the first bar within a session that begins when the signal is known or later. Sessions are counted by the
    calendar, so one in which a ticker has no bar counts too, and gives no return.
    """
    own = in_sessions(bars, calendar)
    closes = own.groupBy("ticker", F.col("ordinal").alias("_exit")).agg(F.max_by("c", "ts").alias("exit_close"))
    known = signals.withColumn("known_at", F.col("ts") + F.make_dt_interval(secs=F.lit(signal_seconds)))
    entered = next_bar(known, own, ["c", "session", "ordinal"], "known_at", chunk_seconds, True)
    priced = entered.withColumn("_exit", F.col("ordinal") + horizon).join(closes, ["ticker", "_exit"], "left").drop("_exit", "ordinal")
    gain = F.when(F.col("c") != 0, F.col("exit_close") / F.col("c") - 1)
    return priced.withColumn("session_return", gain).withColumnRenamed("c", "entry_close").withColumnRenamed("session", "entry_session")


def forward_in_sessions(bars: DataFrame, calendar: DataFrame, horizon: int = 1) -> DataFrame:
    """Bars within sessions, with the return to the close ``horizon`` bars later."""
    later = F.lead("c", horizon).over(W.partitionBy("ticker", "timeframe").orderBy("ts"))
    return in_sessions(bars, calendar).withColumn("forward_return", F.when(F.col("c") != 0, later / F.col("c") - 1))
