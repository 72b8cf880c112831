"""Frames that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators import backtest as bt
from tickerloom.operators import features as ft
from tickerloom.operators import scoring as sc
from tickerloom.params import ScoreParams
from tickerloom.sources import views as v

PARAMS = ScoreParams()

# Digits to which shown values are rounded. A score is a sum of 6-digit features times one-digit weights, so
# eight digits hold it exactly and no engine has to break a half.
DIGITS, SCORE_DIGITS, MEAN_SCORE_DIGITS = 6, 8, 10


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def joined_text(df: DataFrame, *cols: str) -> DataFrame:
    """Arrays as comma-separated text, so that any engine can compare them."""
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


def velocities(spark: SparkSession, sf: str) -> DataFrame:
    return ft.velocity(ft.mention_counts(v.mentions(spark, sf)), PARAMS.velocity_days)


def novelties(spark: SparkSession, sf: str) -> DataFrame:
    return ft.novelty(v.embeddings(spark, sf), PARAMS.novelty_hours)


def features(spark: SparkSession, sf: str) -> DataFrame:
    assembled = sc.assemble_signals(v.scored_mentions(spark, sf), novelties(spark, sf), PARAMS)
    return rounded(assembled, "sentiment", "novelty", "velocity", digits=DIGITS)


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Scored signals. Rounding makes equal scores equal in every engine, so that ties break alike."""
    return rounded(sc.score(features(spark, sf), PARAMS), "score", digits=SCORE_DIGITS)


def contribs(spark: SparkSession, sf: str) -> DataFrame:
    return sc.contributors(v.scored_mentions(spark, sf), PARAMS)


def signal_rows(df: DataFrame) -> DataFrame:
    """Signals as the queries show them."""
    cols = ["id", "ticker", "ts", "sentiment", "novelty", "velocity", "score", "event_tags"]
    return joined_text(df, "event_tags").select(*cols)


def hourly_returns(spark: SparkSession, sf: str) -> DataFrame:
    return bt.signal_returns(signals(spark, sf).select("id", "ticker", "ts", "score"), v.bars(spark, sf, "1h"), "1h")


def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    daily = rounded(bt.daily_scores(signals(spark, sf)), "score", digits=MEAN_SCORE_DIGITS)
    return bt.signal_returns(daily, v.bars(spark, sf, "1d"), "1d", chunk_seconds=30 * 86400)
