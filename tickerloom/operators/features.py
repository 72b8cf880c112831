"""Per-article and per-ticker features: tags, sentiment, embeddings, mentions, velocity, novelty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions.binding import let
from tickerloom.functions.blocks import block_join
from tickerloom.functions.keys import word_hash
from tickerloom.functions.text import title_and_lead, words
from tickerloom.functions.vectors import norm, unit
from tickerloom.operators.pivots import cell_ranges, choose_pivots, meetings, unit_rows, with_cells
from tickerloom.params import FORM_TAGS, NEGATIVE_WORDS, POSITIVE_WORDS, TAG_RULES
from tickerloom.session import stored

HOUR = 3600
DAY = 24 * HOUR


# Event tags

def tag_events(
    articles: DataFrame,
    rules: dict[str, str] = TAG_RULES,
    text: Column | None = None,
    form: str | None = None,
    form_tags: dict[str, str] = FORM_TAGS,
) -> DataFrame:
    """Add ``event_tags``: the tags whose pattern occurs in the text or whose filing form matches, sorted."""
    body = F.concat_ws(" ", "title", "text") if text is None else text
    hits = [F.when(body.rlike(pattern), F.lit(tag)) for tag, pattern in rules.items()]
    if form is not None:
        hits += [F.when(F.col(form) == name, F.lit(tag)) for name, tag in form_tags.items()]
    return articles.withColumn("event_tags", F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))))


def union_tags(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tags per group; as there are few tags, the partial sets stay small."""
    return (
        tagged.select(*keys, F.explode_outer("event_tags").alias("tag"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("tag")).alias("event_tags"))
    )


# Sentiment

def lexicon_sentiment(
    articles: DataFrame,
    text: Column | None = None,
    positive: list[str] = POSITIVE_WORDS,
    negative: list[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """Shares of positive, negative and other words of the whole text; a text without words is neutral."""
    body = F.concat_ws(" ", "title", "text") if text is None else text
    counted = articles.withColumn("_w", words(body)).select(
        *articles.columns,
        F.size("_w").alias("_n"),
        F.size(F.filter("_w", lambda w: w.isin(positive))).alias("_p"),
        F.size(F.filter("_w", lambda w: w.isin(negative))).alias("_q"),
    )
    total = F.greatest(F.col("_n"), F.lit(1))
    return (
        counted.withColumn("prob_pos", F.col("_p") / total)
        .withColumn("prob_neg", F.col("_q") / total)
        .withColumn("prob_neu", 1 - (F.col("_p") + F.col("_q")) / total)
        .withColumn("sentiment", (F.col("_p") - F.col("_q")) / total)
        .drop("_n", "_p", "_q")
    )


Scorer = Callable[[pd.Series], pd.DataFrame]


def model_sentiment(
    articles: DataFrame, load: Callable[[], Scorer], id_col: str, text_col: str, model: str, model_rev: str
) -> DataFrame:
    """Sentiment from a pluggable model. ``load`` runs once per Python worker; the scorer takes a batch of
    texts and returns prob_pos, prob_neg and prob_neu."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            probs = scorer(batch[text_col]).reset_index(drop=True)
            yield pd.DataFrame(
                {
                    "article_id": batch[id_col].to_numpy(),
                    "prob_pos": probs["prob_pos"],
                    "prob_neg": probs["prob_neg"],
                    "prob_neu": probs["prob_neu"],
                    "score": probs["prob_pos"] - probs["prob_neg"],
                    "model": model,
                    "model_rev": model_rev,
                }
            )

    schema = (
        "article_id bigint, prob_pos double, prob_neg double, prob_neu double, score double,"
        " model string, model_rev string"
    )
    return articles.select(id_col, text_col).mapInPandas(score, schema)


def mean_sentiment(scored: DataFrame, keys: list[str], value: str = "sentiment", weight: str | None = None) -> DataFrame:
    """Plain mean, or the weighted mean when a weight column is named."""
    if weight is None:
        mean = F.avg(value)
    else:
        total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
        mean = F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total)
    return scored.groupBy(*keys).agg(mean.alias("sentiment"), F.count("*").alias("articles"))


# Embeddings

def hashed_embeddings(articles: DataFrame, dims: int, lead: int, model: str = "hashed-words") -> DataFrame:
    """Unit vector of hashed word counts of title and lead: a stand-in without a model file."""
    body = title_and_lead(F.col("title"), F.col("text"), lead)
    slots = F.transform(words(body), lambda w: F.pmod(word_hash(w), F.lit(dims)).cast("int"))

    def counts(sorted_slots: Column) -> Column:
        """Counts of all slots in one pass: after each run of equal slots its length, and zeros for the slots between."""
        places = F.transform(sorted_slots, lambda s, i: F.struct(s.alias("slot"), i.alias("at")))
        ends = F.filter(places, lambda p: F.coalesce(F.get(sorted_slots, p["at"] + 1) != p["slot"], F.lit(True)))
        start = F.struct(F.lit(-1).alias("slot"), F.lit(-1).alias("at"))

        def pieces(ends: Column) -> Column:
            def piece(end: Column, i: Column) -> Column:
                last = F.coalesce(F.get(ends, i - 1), start)
                zeros = F.array_repeat(F.lit(0.0), end["slot"] - last["slot"] - 1)
                return F.concat(zeros, F.array((end["at"] - last["at"]).cast("double")))

            tail = F.array_repeat(F.lit(0.0), dims - 1 - F.element_at(ends, -1)["slot"])
            return F.concat(F.flatten(F.transform(ends, piece)), tail)

        return let(ends, pieces)

    worded = articles.filter(body.rlike(r"[\p{L}\p{Nd}]"))
    return worded.select(
        F.col("id").alias("article_id"),
        let(let(F.array_sort(slots), counts), unit).alias("embedding"),
        F.lit(model).alias("model"),
        F.lit(dims).alias("dims"),
    )


def model_embeddings(
    articles: DataFrame, load: Callable[[], Callable[[pd.Series], np.ndarray]], lead: int, model: str
) -> DataFrame:
    """Embeddings of title and lead from a pluggable model, loaded once per Python worker."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(encode(batch), dtype="float32")))

    body = title_and_lead(F.col("title"), F.col("text"), lead)
    embedded = articles.select(F.col("id").alias("article_id"), embed(body).alias("embedding"))
    return embedded.withColumn("model", F.lit(model)).withColumn("dims", F.size("embedding"))


# Mentions and velocity

def mention_counts(mentions: DataFrame, ts: str = "ts") -> DataFrame:
    """Mentions per ticker and hour; everything about velocity is built on this small frame."""
    return mentions.groupBy("ticker", F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("mentions"))


def rolling_baseline(counts: DataFrame, days: int = 30) -> DataFrame:
    """Mean and sample deviation of the hourly counts of the ``days`` before each hour, the hour excluded.

    Hours without a mention count as zero, from the ticker's first hour on. They enter through their number
    only, so the series is never filled in: with n hours, the sum and the sum of squares of the few non-zero
    ones give both moments. A ticker has one row per hour here, so a window never grows with the mentions.
    """
    count = F.col("mentions").cast("decimal(18,0)")  # squares of busy hours outgrow a bigint
    by_time = W.partitionBy("ticker").orderBy("_t")

    def total(value: Column) -> Column:
        """Over the look-back, as a difference of two running totals: a sliding frame is summed anew for every row."""
        until_now = F.sum(value).over(by_time.rangeBetween(W.unboundedPreceding, -1))
        until_start = F.sum(value).over(by_time.rangeBetween(W.unboundedPreceding, -days * DAY - 1))
        return F.coalesce(until_now, F.lit(0)) - F.coalesce(until_start, F.lit(0))

    first = F.min("_t").over(by_time.rowsBetween(W.unboundedPreceding, 0))
    hours = ((F.col("_t") - first) / HOUR).cast("bigint")
    framed = counts.withColumn("_t", F.unix_seconds("hour")).withColumns(
        {
            "_n": F.least(hours, F.lit(days * 24).cast("bigint")),
            "_s": total(count),
            "_q": total(count * count),
        }
    )
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    mean = F.when(n > 0, s.cast("double") / n)
    var = F.when(n > 1, (q * n - s * s).cast("double") / (n * (n - 1)))
    return (
        framed.withColumn("baseline_hours", n)
        .withColumn("mean", mean)
        .withColumn("std", F.sqrt(var))
        .drop("_t", "_n", "_s", "_q")
    )


def velocity(counts: DataFrame, days: int = 30) -> DataFrame:
    """z-score of each hour's mentions against its baseline; 0 while the baseline has no spread."""
    z = (F.col("mentions") - F.col("mean")) / F.col("std")
    return rolling_baseline(counts, days).withColumn("velocity", F.when(F.col("std") > 0, z).otherwise(F.lit(0.0)))


def top_rising(velocities: DataFrame, rising_z: float, k: int) -> DataFrame:
    """The k strongest rises, one per ticker."""
    w = W.partitionBy("ticker").orderBy(F.desc("velocity"), F.desc("hour"))
    best = velocities.filter(F.col("velocity") >= rising_z).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return best.drop("_n").orderBy(F.desc("velocity"), F.asc("ticker")).limit(k)


# Novelty

def _nearest_kernel(left: pd.DataFrame, right: pd.DataFrame, same_key: np.ndarray) -> pd.DataFrame:
    """Largest cosine similarity of each left vector to the right vectors of its ticker inside its look-back."""
    if left.empty or right.empty:
        return pd.DataFrame({"head": pd.Series(dtype="object"), "slot": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
    sims = unit_rows(left["embedding"]) @ unit_rows(right["embedding"]).T
    own_slot = (left["slot"].to_numpy() == left["own_slot"].to_numpy())[:, None]
    inside = same_key & np.where(
        own_slot,
        right["first_us"].to_numpy()[None, :] < left["first_us"].to_numpy()[:, None],
        right["last_us"].to_numpy()[None, :] >= left["since_us"].to_numpy()[:, None],
    )
    best = np.where(inside, sims, -np.inf).max(axis=1)
    seen = np.isfinite(best)
    return pd.DataFrame({"head": left["head"].to_numpy()[seen], "slot": left["slot"].to_numpy()[seen], "sim": best[seen]})


def _head(ticker: str, slot: Column | str, embedding: str) -> Column:
    """A 128-bit key of one group of equal vectors: small to shuffle, and unique at any size."""
    return F.concat(F.hex(F.xxhash64(ticker, slot, embedding)), F.lit("-"), F.hex(F.xxhash64(embedding, slot, ticker)))


def _vector_groups(embeds: DataFrame, hours: int) -> DataFrame:
    """Equal vectors of one ticker and time slot, as one row with their first and last time."""
    width = hours * HOUR * 1_000_000
    return (
        embeds.withColumn("_us", F.unix_micros("published_at"))
        .groupBy("ticker", F.floor(F.col("_us") / width).cast("bigint").alias("slot"), "embedding")
        .agg(F.min("_us").alias("first_us"), F.max("_us").alias("last_us"))
        .withColumn("head", _head("ticker", "slot", "embedding"))
    )


_SIMS = "head string, slot bigint, sim double"


def _sides(groups: DataFrame, hours: int) -> tuple[DataFrame, DataFrame]:
    """Vectors that look back, once for each slot that they look into, and vectors that are found there.

    Vectors are shipped as they are stored, and made unit vectors where they meet.
    """
    left = groups.select(
        "ticker",
        F.col("slot").alias("own_slot"),
        "head",
        "embedding",
        "first_us",
        (F.col("first_us") - hours * HOUR * 1_000_000).alias("since_us"),
        F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"),
    )
    return left, groups.select("ticker", "slot", F.col("head").alias("other"), "embedding", "first_us", "last_us")


def pruned_meetings(
    groups: DataFrame, slots: DataFrame, hours: int, block_rows: int, pivots: int = 16
) -> tuple[DataFrame, DataFrame]:
    """Similarities of nearest predecessors in the given slots, and which cells each vector met (with ``members``).

    Every vector meets its own cell; then those cells of the slot that may hold something more similar than that.
    """
    keys = ["ticker", "slot"]
    sides = [side.join(slots, keys, "left_semi") for side in _sides(groups, hours)]
    points = choose_pivots(sides[1], pivots)
    left, right = (stored(with_cells(side, points), "novelty-cells") for side in sides)

    def met(rows: DataFrame) -> DataFrame:
        return block_join(rows, right, [*keys, "cell"], "head", "other", _nearest_kernel, _SIMS, block_rows)

    at_home = stored(met(left), "novelty-home")
    ranges = cell_ranges(right, keys, len(points))
    best = at_home.groupBy("head", "slot").agg(F.max("sim").alias("sim"))
    found = best.join(left.select("head", *keys).distinct(), ["head", "slot"]).select("head", *keys, "sim")
    further = stored(meetings(left, ranges, keys, len(points), found), "novelty-further")
    home = left.join(ranges.select(*keys, "cell", "members"), [*keys, "cell"]).select("head", *keys, "cell", "members")
    return at_home.unionByName(met(further.drop("members"))), home.unionByName(further.select("head", *keys, "cell", "members"))


def nearest_earlier(embeds: DataFrame, hours: int = 24, block_rows: int = 2048, pivot_rows: int = 8192) -> DataFrame:
    """Per distinct vector of a ticker and time slot, the similarity of the nearest vector in the look-back.

    Slots are as wide as the look-back [t - hours, t), so a vector needs its own slot and the one before. A
    group of equal vectors is one row: in the own slot only its first time matters, in the earlier slot only
    its last. Slots are worked off block by block; in those of more than ``pivot_rows`` vectors, cells around pivots are left
    out where angles say that nothing more similar can be in them. Both ways are exact.
    """
    keys = ["ticker", "slot"]
    groups = _vector_groups(embeds, hours).filter(norm(F.col("embedding")) > 0)
    heavy = None
    if embeds.limit(pivot_rows + 1).count() > pivot_rows:
        sizes = groups.groupBy(*keys).agg(F.count("*").alias("_n"))
        heavy = stored(sizes.filter(F.col("_n") > pivot_rows).select(*keys), "novelty-heavy")
    left, right = _sides(groups, hours)
    if heavy is None or heavy.isEmpty():
        sims = block_join(left, right, keys, "head", "other", _nearest_kernel, _SIMS, block_rows)
        return sims.groupBy("head").agg(F.max("sim").alias("sim"))
    pruned, _ = pruned_meetings(groups, heavy, hours, block_rows)
    left, right = (side.join(heavy, keys, "left_anti") for side in (left, right))
    sims = block_join(left, right, keys, "head", "other", _nearest_kernel, _SIMS, block_rows)
    return sims.unionByName(pruned).groupBy("head").agg(F.max("sim").alias("sim"))


def novelty(embeds: DataFrame, hours: int = 24, block_rows: int = 2048, pivot_rows: int = 8192) -> DataFrame:
    """1 minus the largest cosine similarity to the ticker's articles of the preceding hours; 1 when none.

    Input: article_id, ticker, published_at, embedding. An article that repeats a vector of its own slot has
    similarity 1 and is settled without comparison; only each group's first article is compared.
    """
    width = hours * HOUR * 1_000_000
    us = F.unix_micros("published_at")
    slot = F.floor(us / width).cast("bigint")
    rows = embeds.select(
        "article_id",
        "ticker",
        "published_at",
        us.alias("_us"),
        _head("ticker", slot, "embedding").alias("head"),
        (norm(F.col("embedding")) > 0).alias("_long"),
    )
    firsts = _vector_groups(embeds, hours).select("head", "first_us")
    nearest = firsts.join(nearest_earlier(embeds, hours, block_rows, pivot_rows), "head", "left")
    repeat = F.col("_long") & (F.col("_us") > F.col("first_us"))
    similarity = F.when(repeat, F.lit(1.0)).otherwise(F.coalesce("sim", F.lit(0.0)))
    return (
        rows.join(nearest, "head")
        .withColumn("nearest_sim", F.when(repeat, F.lit(1.0)).otherwise(F.col("sim")))
        .withColumn("novelty", 1 - similarity)
        .select("article_id", "ticker", "published_at", "nearest_sim", "novelty")
    )
