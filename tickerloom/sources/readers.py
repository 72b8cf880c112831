"""Landed files to raw items. Fetching them is not Spark's work; reading them is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.fields import as_utc, has_offset
from tickerloom.params import CASHTAG_PATTERN, SEC_FORMS
from tickerloom.schemas import PRICE_BAR, RAW_LANDED, TICKER_CSV


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """The landed NDJSON as it is; a line that does not parse keeps its text in ``_corrupt``."""
    return (
        spark.read.schema(RAW_LANDED)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def map_news_items(landed: DataFrame, keep_corrupt: bool = False) -> DataFrame:
    """Landed rows to raw items: timestamps parsed to UTC (no offset, no timestamp), language lower-cased.

    ``keep_corrupt`` carries the text of lines that didn't parse along.
    """

    def instant(col: str):
        return F.when(has_offset(F.col(col)), as_utc(F.col(col))).alias(col)

    return landed.select(
        "source", "source_id", "url", instant("published_at"), instant("retrieved_at"), "title", "text",
        F.lower("lang").alias("lang"), "license", "author", "meta", *(["_corrupt"] if keep_corrupt else []),
    )


def map_filings(landed: DataFrame, forms: list[str] = SEC_FORMS) -> DataFrame:
    """Filing-feed items of the listed forms; the form travels in ``meta.form``."""
    return map_news_items(landed).filter(F.col("meta")["form"].isin(forms))


def map_posts(landed: DataFrame) -> DataFrame:
    """Social posts, only those that name a ticker with a cashtag."""
    return map_news_items(landed).filter(F.col("text").rlike(CASHTAG_PATTERN))


def keep_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """A source's keep-list; pruning reaches the file scan."""
    return df.select(*fields)


def union_sources(frames: dict[str, DataFrame], enabled: dict[str, bool]) -> DataFrame:
    """The enabled sources in one frame; a disabled source is not even scanned."""
    on = [df for name, df in frames.items() if enabled.get(name, False)]
    if not on:
        raise ValueError("no source is enabled")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), on)


def read_ticker_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ticker universe: symbol, name and ``;``-separated aliases."""
    csv = spark.read.schema(TICKER_CSV).option("header", True).csv(path)
    return csv.withColumn("aliases", F.split("aliases", ";"))


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars; validation is a separate step."""
    return spark.read.schema(PRICE_BAR).option("header", True).csv(path)
