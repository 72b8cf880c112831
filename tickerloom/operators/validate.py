"""Row validation as a distributed job: name every broken rule, then split valid from quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.keys import ticker_ok
from tickerloom.functions.text import URL_PATTERN
from tickerloom.params import LINK_METHODS, SOURCES, TIMEFRAMES


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _null_or(col: str, cond: Column) -> Column:
    return F.col(col).isNull() | cond


def with_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``errors``: the names of the rules that do not hold, in rule order."""
    broken = [F.when(~_true(ok), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*broken)))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def check_raw_items(df: DataFrame, max_title: int = 512, max_text: int = 20000) -> DataFrame:
    lowered = df.withColumn("lang", F.lower("lang"))
    return with_errors(
        lowered,
        {
            "source": F.col("source").isin(SOURCES),
            "url": F.col("url").rlike(URL_PATTERN),
            "published_at": F.col("published_at").isNotNull(),
            "retrieved_at": F.col("retrieved_at").isNotNull(),
            "title": F.length("title") <= max_title,
            "text": F.length("text") <= max_text,
            "lang": F.length("lang").between(2, 5),
        },
    )


def check_articles(df: DataFrame) -> DataFrame:
    return with_errors(
        df,
        {
            "source": F.col("source").isNotNull(),
            "url": F.col("url").isNotNull(),
            "published_at": F.col("published_at").isNotNull(),
            "credibility": _null_or("credibility", F.col("credibility").between(0, 100)),
        },
    )


def check_links(df: DataFrame, linker_output: bool = False) -> DataFrame:
    """Stored links may leave confidence, method and terms null; linker output may not."""
    confidence, method = F.col("confidence").between(0, 1), F.col("method").isin(LINK_METHODS)
    rules = {
        "article_id": F.col("article_id").isNotNull(),
        "ticker": ticker_ok(F.col("ticker")),
        "confidence": _null_or("confidence", confidence),
        "method": _null_or("method", method),
    }
    if linker_output:
        del rules["article_id"]
        rules.update(confidence=confidence, method=method, matched_terms=F.col("matched_terms").isNotNull())
    return with_errors(df, rules)


def check_sentiment(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    probs = ["prob_pos", "prob_neg", "prob_neu"]
    rules = {p: F.col(p).between(0, 1) for p in probs}
    rules["prob_sum"] = F.abs(F.col("prob_pos") + F.col("prob_neg") + F.col("prob_neu") - 1) <= tolerance
    return with_errors(df, rules)


def check_embeddings(df: DataFrame, dims: int = 384) -> DataFrame:
    return with_errors(
        df,
        {
            "length": F.size("embedding") == dims,
            "dims": F.col("dims") == F.size("embedding"),
        },
    )


def check_bars(df: DataFrame) -> DataFrame:
    rules = {
        "ticker": ticker_ok(F.col("ticker")),
        "ts": F.col("ts").isNotNull(),
        "timeframe": F.col("timeframe").isin(TIMEFRAMES),
    }
    for name in ("o", "h", "l", "c", "v"):
        rules[name] = _null_or(name, F.col(name) >= 0)
    return with_errors(df, rules)


def check_signals(df: DataFrame, max_contributors: int = 2) -> DataFrame:
    filled = df.withColumn("event_tags", F.coalesce("event_tags", F.array().cast("array<string>")))
    return with_errors(
        filled,
        {
            "ticker": ticker_ok(F.col("ticker")),
            "ts": F.col("ts").isNotNull(),
            "contributors": _null_or("contributors", F.size("contributors") <= max_contributors),
        },
    )


def check_contribs(df: DataFrame) -> DataFrame:
    return with_errors(
        df,
        {
            "signal_id": F.col("signal_id").isNotNull(),
            "article_id": F.col("article_id").isNotNull(),
            "rank": _null_or("rank", F.col("rank") >= 1),
        },
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; a null key refers to nothing and passes."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def ambiguous_ids(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Ids that stand for more than one key; there should be none."""
    return df.select(id_col, *keys).distinct().groupBy(id_col).agg(F.count("*").alias("keys")).filter("keys > 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
