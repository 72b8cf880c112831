"""Data quality, ingest and drift metrics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions.graph import components
from tickerloom.session import stored


def duplicate_share(df: DataFrame, key: str) -> DataFrame:
    """Percentage of rows that repeat an earlier row's key; a row without a key (null or empty) repeats nothing."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    repeats = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) != "", F.col("n") - 1).otherwise(F.lit(0))
    return per_key.agg((F.try_divide(F.sum(repeats), F.sum("n")) * 100).alias("value"))


def language_drift(df: DataFrame, split_at: Any, ts: str = "published_at") -> DataFrame:
    """Total-variation distance between the language shares before and from ``split_at``; null when one is empty."""
    late = F.col(ts) >= F.lit(split_at).cast("timestamp")
    counts = df.groupBy("lang").agg(F.count_if(~late).alias("a"), F.count_if(late).alias("b"))
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = counts.select(
        F.struct("a", "b").alias("c"), totals.select(F.struct("ta", "tb")).scalar().alias("t")
    )
    gap = F.abs(F.try_divide(F.col("c.a"), F.col("t.ta")) - F.try_divide(F.col("c.b"), F.col("t.tb")))
    return shares.agg((F.sum(gap) / 2).alias("value"))


def linker_precision(links: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of links on labelled articles that the labels confirm."""
    labelled = truth.select("article_id").distinct()
    right = truth.select("article_id", "ticker").distinct().withColumn("right", F.lit(1.0))
    judged = links.join(labelled, "article_id", "left_semi").join(right, ["article_id", "ticker"], "left")
    return judged.agg(F.avg(F.coalesce("right", F.lit(0.0))).alias("value"))


def quality_report(articles: DataFrame, links: DataFrame, truth: DataFrame, split_at: Any) -> DataFrame:
    parts = [
        ("duplicate_url_pct", duplicate_share(articles, "url")),
        ("duplicate_hash_pct", duplicate_share(articles, "hash")),
        ("language_drift", language_drift(articles, split_at)),
        ("linker_precision", linker_precision(links, truth)),
    ]
    report = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        report = row if report is None else report.unionByName(row)
    return report


def ingest_metrics(raw: DataFrame, by: str = "retrieved_at") -> DataFrame:
    """Items, lag and share of repeated URLs per hour of retrieval."""
    hour = F.date_trunc("hour", by).alias("hour")
    lag = (F.unix_micros("retrieved_at") - F.unix_micros("published_at")) / 1_000_000
    per_url = raw.groupBy(hour, "url").agg(
        F.count("*").alias("n"), F.sum(lag).alias("lag"), F.max(lag).alias("max_lag")
    )
    return per_url.groupBy("hour").agg(
        F.sum("n").alias("items"),
        (F.sum("lag") / F.sum("n")).alias("mean_lag_sec"),
        F.max("max_lag").alias("max_lag_sec"),
        (1 - F.count("*") / F.sum("n")).alias("dedupe_rate"),
    )


def lag_percentiles(raw: DataFrame, by: Column, probs: list[float], accuracy: int = 10000) -> DataFrame:
    """Approximate lag percentiles per group, from a mergeable sketch of bounded size."""
    lag = F.unix_seconds("retrieved_at") - F.unix_seconds("published_at")
    return raw.groupBy(by.alias("bucket")).agg(F.percentile_approx(lag, probs, accuracy).alias("lag_percentiles"))


def population_stability(df: DataFrame, value: str, late: Column, bins: int = 10, accuracy: int = 10000) -> DataFrame:
    """Population stability index of a value between an early and a late period.

    Bin edges are quantiles of the early period. Rows are (bin, early, late, psi); the sum of psi is the
    index. An empty bin counts as half a row.
    """
    probs = [i / bins for i in range(1, bins)]
    used = df.filter(F.col(value).isNotNull()).withColumn("_late", late)
    edges = used.filter(~F.col("_late")).agg(F.percentile_approx(value, probs, accuracy)).scalar()
    placed = used.withColumn("_edges", edges).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: F.col(value) > e))
    )
    counts = placed.groupBy("bin").agg(
        F.count_if(~F.col("_late")).alias("early"), F.count_if(F.col("_late")).alias("late")
    )
    totals = counts.agg(F.struct(F.sum("early").alias("e"), F.sum("late").alias("l"))).scalar()
    a = F.try_divide(F.greatest(F.col("early").cast("double"), F.lit(0.5)), F.col("_t.e"))
    b = F.try_divide(F.greatest(F.col("late").cast("double"), F.lit(0.5)), F.col("_t.l"))
    return counts.withColumn("_t", totals).select("bin", "early", "late", ((b - a) * F.log(b / a)).alias("psi"))


def drop_bursts(posts: DataFrame, max_per_hour: int, ts: str = "ts") -> DataFrame:
    """Drop the posts of an author on one ticker in an hour with more than ``max_per_hour`` of them.

    Bursts are found by counting; the posts themselves are only checked against the short list of bursts.
    """
    keyed = posts.withColumn("_hour", F.date_trunc("hour", ts))
    keys = ["author", "ticker", "_hour"]
    bursts = keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > max_per_hour).select(*keys)
    return keyed.join(bursts, keys, "left_anti").drop("_hour")


# Drift from stored sketches

def day_sketches(df: DataFrame, value: str, ts: str = "ts", k: int = 2048) -> DataFrame:
    """``date``, ``sketch`` and ``n`` of a value: a few kilobytes a day, which any period's quantiles can be merged from."""
    used = df.filter(F.col(value).isNotNull()).select(F.to_date(ts).alias("date"), F.col(value).cast("double").alias("_v"))
    return used.groupBy("date").agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count("*").alias("n"))


def period_sketch(sketches: DataFrame, start=None, end=None) -> DataFrame:
    """One row: the merged ``sketch`` of the days from ``start`` up to, but without, ``end``, and their ``n``."""
    days = sketches
    if start is not None:
        days = days.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.filter(F.col("date") < F.lit(end).cast("date"))
    return days.agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def stability_of_sketches(early: DataFrame, late: DataFrame, bins: int = 10) -> DataFrame:
    """The population stability index between two periods, from their sketches alone: (bin, early, late, psi).

    Edges are quantiles of the early period; ``early`` and ``late`` are shares of the period. An empty bin counts as half a row. A
    period without rows gives none.
    """
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = early.filter("n > 0").select(F.kll_sketch_get_quantile_double("sketch", probs)).first()
    # Ranks are asked for constants; there is a number for each bin.
    edges = F.array(*[F.lit(float(e)) for e in sorted(set(found[0]))]) if found else F.array(F.lit(0.0))

    def ranked(period: DataFrame, rank: str, n: str) -> DataFrame:
        within = F.concat(F.array(F.lit(0.0)), F.kll_sketch_get_rank_double("sketch", edges), F.array(F.lit(1.0)))
        return period.filter("n > 0").select(F.lit(1).alias("_one"), within.alias(rank), F.col("n").alias(n))

    both = ranked(early, "_er", "_en").join(ranked(late, "_lr", "_ln"), "_one")  # a row each
    cut = both.withColumn("bin", F.explode(F.sequence(F.lit(0), F.size("_er") - 2)))

    def share(rank: str, n: str) -> Column:
        return F.greatest(F.get(rank, F.col("bin") + 1) - F.get(rank, "bin"), 0.5 / F.col(n))

    shares = cut.select("bin", share("_er", "_en").alias("early"), share("_lr", "_ln").alias("late"))
    return shares.withColumn("psi", (F.col("late") - F.col("early")) * F.log(F.col("late") / F.col("early")))


# Coordination

def same_text_bursts(posts: DataFrame, text: str, ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """``text``, ``author``, ``burst`` and ``n``: a burst is a run of posts of one text without a pause of over ``seconds``.

    Posts are first summed up by slots as long as the pause: within a slot none is longer. So the run of a text that everyone
    posts is found from one row a slot.
    """
    slot = F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).alias("slot")
    own = posts.filter(F.col(text).isNotNull() & F.col("author").isNotNull() & F.col(ts).isNotNull())
    summed = own.groupBy(F.col(text).alias("text"), slot, "author").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    slots = summed.groupBy("text", "slot").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    line = W.partitionBy("text").orderBy("slot")
    pause = F.unix_micros("first") - F.unix_micros(F.lag("last").over(line)) > seconds * 1_000_000
    begun = slots.withColumn("begins", F.when(F.coalesce(pause, F.lit(True)), F.col("slot")))
    burst = F.last("begins", ignorenulls=True).over(line).alias("burst")
    return summed.join(begun.select("text", "slot", burst), ["text", "slot"]).select("text", "author", "burst", "n")


def coordinated_groups(
    posts: DataFrame, text: str, ts: str = "ts", seconds: int = 3600, least_authors: int = 3, least_texts: int = 2
) -> DataFrame:
    """``author``, ``ring``, ``authors``, ``texts``: authors tied together by posting equal texts at the same time.

    An author and a burst of a text are joined if the burst has at least two authors; a connected set with at least ``least_authors``
    authors and ``least_texts`` different texts is a ring, named after its smallest author. It doesn't matter how little each of
    them posts. Posts without author, text or time are left out.
    """
    bursts = same_text_bursts(posts, text, ts, seconds).select(F.col("author").cast("string").alias("author"), F.struct("text", "burst").alias("at")).distinct()
    shared = bursts.groupBy("at").agg(F.count("*").alias("_n")).filter("_n > 1").select("at")
    edges = bursts.join(shared, "at").select("author", F.concat(F.lit("t"), F.sha2(F.to_json("at"), 256)).alias("at"), F.col("at.text").alias("text"))
    edges = stored(edges.withColumn("author", F.concat(F.lit("a"), "author")), "rings")
    of = components(edges.select(F.col("author").alias("a"), F.col("at").alias("b"))).select(F.col("node").alias("author"), "component")
    placed = edges.join(of, "author")
    rings = placed.groupBy("component").agg(
        F.count_distinct("author").alias("authors"), F.count_distinct("text").alias("texts"), F.substring(F.min("author"), 2, 1 << 30).alias("ring")
    )
    large = rings.filter((F.col("authors") >= least_authors) & (F.col("texts") >= least_texts))
    members = placed.select("component", F.substring("author", 2, 1 << 30).alias("author")).distinct()
    return members.join(large, "component").select("author", "ring", "authors", "texts")
