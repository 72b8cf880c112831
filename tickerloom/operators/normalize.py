"""Raw items to clean articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.functions.binding import let
from tickerloom.functions.fields import credibility
from tickerloom.functions.keys import stable_id
from tickerloom.params import STOP_WORDS


def normalize_articles(raw: DataFrame) -> DataFrame:
    """One projection from validated raw items to articles; attribution columns ride along."""
    unescaped = raw.select(
        "source", "published_at", "retrieved_at", "lang", "license", "author",
        F.col("title").alias("raw_title"),
        tx.validated_url(F.col("url")).alias("raw_url"),
        tx.unescape_html(F.col("title")).alias("plain_title"),
        tx.unescape_html(F.col("text")).alias("plain_text"),
    )
    # Two steps, so that the cleaned title and address are there once for the hash and the id as well.
    cleaned = unescaped.select(
        "*",
        tx.strip_markup(F.col("plain_title")).alias("title"),
        tx.strip_markup(F.col("plain_text")).alias("text"),
        tx.canonical_url(F.col("raw_url")).alias("url"),
    )
    return cleaned.select(
        stable_id(F.col("url")).alias("id"),
        "source",
        "url",
        "published_at",
        "retrieved_at",
        "title",
        "text",
        "lang",
        tx.article_hash(F.col("raw_title"), F.col("title"), F.col("raw_url")).alias("hash"),
        credibility(F.col("source"), F.col("author"), F.col("license"), F.col("raw_url")).alias("credibility"),
        "license",
        "author",
    )


def guess_language(text: Column) -> Column:
    """The language whose function words are most frequent in the text; null when none occurs."""

    def best(tokens: Column) -> Column:
        hits = [
            F.struct(_count_in(tokens, ws).alias("hits"), F.lit(lang).alias("lang")) for lang, ws in sorted(STOP_WORDS.items())
        ]
        return F.greatest(*hits)

    winner = let(tx.words(text), best)
    return F.when(winner["hits"] > 0, winner["lang"])


def _count_in(tokens: Column, listed: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(listed)))


def keep_languages(df: DataFrame, langs: list[str], guess: bool = True) -> DataFrame:
    """Keep listed languages; text is examined only where the item states no language."""
    if not guess:
        return df.filter(F.col("lang").isin(langs))
    stated = F.col("lang").isNotNull()
    lang = F.when(stated, F.col("lang")).otherwise(guess_language(F.col("text")))
    return df.withColumn("lang", lang).filter(F.col("lang").isin(langs))


def boilerplate_lines(docs: DataFrame, min_share: float, min_docs: int = 2) -> DataFrame:
    """Lines that at least ``min_share`` of a source's documents hold: (source, line, docs).

    The list stays short by itself: a source whose documents hold L distinct lines on average has at most
    L / min_share such lines.
    """
    lines = docs.select("source", F.explode(_distinct_lines(F.col("text"))).alias("line"))
    counts = lines.groupBy("source", "line").agg(F.count("*").alias("docs"))
    totals = docs.groupBy("source").agg(F.count("*").alias("total"))
    return (
        counts.filter(F.col("docs") >= min_docs)
        .join(totals, "source")
        .filter(F.col("docs") >= F.col("total") * F.lit(min_share))
        .select("source", "line", "docs")
    )


def _distinct_lines(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    return F.array_distinct(F.filter(trimmed, lambda s: s != ""))


def strip_boilerplate(docs: DataFrame, min_share: float, min_docs: int = 2, salts: int = 64) -> DataFrame:
    """Remove each source's repeated lines from its documents, without taking the documents apart.

    The short lists are repeated ``salts`` times and documents are dealt by their text as well as their source, so that
    one source with a great part of all documents meets its list in many tasks.
    """
    drop = (
        boilerplate_lines(docs, min_share, min_docs)
        .groupBy("source")
        .agg(F.collect_set("line").alias("drop_lines"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    docs = docs.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int"))
    kept = F.filter(
        F.split("text", "\n"),
        lambda s: ~F.array_contains(F.col("drop_lines"), F.trim(s)),
    )
    stripped = F.when(F.col("drop_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return docs.join(drop, ["source", "_salt"], "left").withColumn("text", stripped).drop("drop_lines", "_salt")
