"""Domain frames over the supplied tables. Everything is derived by fixed rules, nothing is made up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.keys import letters
from tickerloom.operators.features import lexicon_sentiment, tag_events
from tickerloom.operators.normalize import normalize_articles
from tickerloom.operators.stats import bars_from_ticks

EPOCH = "2024-01-01 00:00:00"

# How event types stand in for news.
EVENT_POSITIVE = ["purchase", "signup"]
EVENT_NEGATIVE = ["error"]
EVENT_TAGS = {"earnings": "purchase", "guidance": "signup", "mna": "error"}
EVENT_METHODS = {"click": "cashtag", "view": "dict", "purchase": "synonym", "signup": "ner"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _after_epoch(amount: Column, unit_seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + amount * unit_seconds)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article mention per event: article_id, ts, ticker, confidence, method, plus the event's own fields."""
    k = F.get_json_object("props", "$.k").cast("int")
    method = F.lit(None).cast("string")
    for kind, name in EVENT_METHODS.items():
        method = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(method)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        letters(F.col("user_id")).alias("ticker"),
        "event_type",
        "value",
        "props",
        (k / 100).alias("confidence"),
        method.alias("method"),
        k.alias("k"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select(
        "article_id", "ticker", "confidence", "method", F.array("event_type").alias("matched_terms")
    )


def scored_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with sentiment and tags taken from the event type."""
    tagged = tag_events(mentions(spark, sf_dir), EVENT_TAGS, F.col("event_type"))
    return lexicon_sentiment(tagged, F.col("event_type"), EVENT_POSITIVE, EVENT_NEGATIVE)


def bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    unit = {"1d": "day", "1h": "hour", "1m": "minute"}[timeframe]
    return bars_from_ticks(mentions(spark, sf_dir), timeframe, unit, "article_id")


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "1d").unionByName(bars(spark, sf_dir, "1h"))


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw items. The address follows the text, so a copy within a source repeats an address."""
    source_no = F.substring("source", 4, 9).cast("int")
    source = F.element_at(
        F.array(*[F.lit(s) for s in ("gdelt", "sec", "stocktwits", "twitter", "reddit")]),
        (F.pmod(source_no, F.lit(5)) + 1).cast("int"),
    )
    suffix = F.element_at(
        F.array(F.lit("?utm_source=feed"), F.lit("#top"), F.lit("")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")
    )
    address = F.concat(
        F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), F.sha1("text"), suffix
    )
    return table(spark, sf_dir, "documents").select(
        source.alias("source"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("source_id"),
        address.alias("url"),
        _after_epoch(F.col("doc_id"), 60).alias("published_at"),
        _after_epoch(F.col("doc_id") * 60 + F.pmod("n_chars", F.lit(90)), 1).alias("retrieved_at"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        "lang",
        F.when(F.col("lang") == "en", F.lit("CC-BY")).alias("license"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("source")).alias("author"),
        F.col("doc_id"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as raw items: title and language from the markup, the whole markup as text."""
    return table(spark, sf_dir, "pages").select(
        F.lit("gdelt").alias("source"),
        F.concat(F.lit("page-"), F.col("page_id")).alias("source_id"),
        "url",
        _after_epoch(F.col("page_id"), 60).alias("published_at"),
        _after_epoch(F.col("page_id") + 5, 60).alias("retrieved_at"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("text"),
        F.regexp_extract("html", '<html lang="([a-zA-Z]+)"', 1).alias("lang"),
        F.lit(None).cast("string").alias("license"),
        F.lit(None).cast("string").alias("author"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_documents(spark, sf_dir).drop("doc_id").unionByName(raw_pages(spark, sf_dir))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored articles under their own number."""
    raw = raw_documents(spark, sf_dir)
    return raw.select(
        F.col("doc_id").alias("id"),
        "source",
        F.regexp_replace("url", r"[?#].*$", "").alias("url"),
        "published_at",
        "retrieved_at",
        "title",
        "text",
        "lang",
        "license",
        "author",
        F.when(F.col("author").isNotNull(), F.lit(80.0)).alias("credibility"),
    )


def clean_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw items, normalised."""
    return normalize_articles(raw_items(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"),
        "embedding",
        F.when(F.col("label") < 5, F.lit("minilm")).otherwise(F.lit("other")).alias("model"),
        F.size("embedding").alias("dims"),
        letters(F.col("label")).alias("ticker"),
        _after_epoch(F.col("vec_id"), 600).alias("published_at"),
    )


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a ticker dimension with validity dates."""
    key = F.col("s_suppkey")
    symbol = letters(key)
    start = F.date_add(F.lit("2023-06-01").cast("date"), F.pmod(key, F.lit(400)).cast("int"))
    joined = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        symbol.alias("symbol"),
        F.col("s_name").alias("name"),
        F.when(F.pmod(key, F.lit(11)) > 0, F.col("n_name")).alias("exchange"),
        F.lpad(key.cast("string"), 10, "0").alias("cik"),
        F.when(F.pmod(key, F.lit(7)) > 0, F.array(F.col("s_name"), symbol)).alias("aliases"),
        F.when(F.pmod(key, F.lit(5)) > 0, start).alias("valid_from"),
        F.when(F.pmod(key, F.lit(3)) == 0, F.date_add(start, 180)).alias("valid_to"),
    )


def linker_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a known cashtag in front, and two known names and a cashtag before a stop at the end."""

    def number(modulus: int) -> Column:
        return F.pmod("doc_id", F.lit(modulus))

    body = F.concat(
        F.lit("$"), letters(number(97)), F.lit(" "), F.col("text"),
        F.lit(" Supplier#"), F.lpad(number(89).cast("string"), 9, "0"), F.lit(". Supplier No "),
        number(83).cast("string"), F.lit(", see $"), letters(number(79)), F.lit("."),
    )
    named = F.array(*[letters(number(m)) for m in (97, 89, 83, 79)])
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), body.alias("text"), named.alias("named"))


def linker_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticker dimension with one more alias, of three words."""
    phrase = F.concat(F.lit("Supplier No "), F.regexp_replace("cik", "^0+(?=.)", ""))
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    return tickers(spark, sf_dir).withColumn("aliases", F.array_union(own, F.array(phrase)))


def linker_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linker_articles(spark, sf_dir).select(
        F.col("id").alias("article_id"), F.explode(F.array_distinct("named")).alias("ticker")
    )
