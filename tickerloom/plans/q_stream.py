"""Incremental jobs over the supplied tables, checked against the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.functions.keys import letters
from tickerloom.plans.frames import rounded
from tickerloom.plans.q_tables import land, landed_items
from tickerloom.plans.registry import query
from tickerloom.schemas import RAW_LANDED
from tickerloom.session import work_dir
from tickerloom.sources import views as v
from tickerloom.sources.readers import map_news_items
from tickerloom.streaming import jobs
from tickerloom.streaming import neardup as near


def _mention_stream(spark, sf):
    """The events as a stream of mentions; a new file of the table is a new micro-batch."""
    schema = v.table(spark, sf, "events").schema
    events = jobs.file_stream(spark, f"{sf}/events.parque*", schema, "parquet")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), letters(F.col("user_id")).alias("ticker"))


@query("stream_mentions", "SELECT ticker, hour, mentions FROM v_hourcount")
def stream_mentions(spark, sf):
    root = work_dir(spark, "stream-mentions")
    log = jobs.run_to_log(jobs.hourly_mentions(_mention_stream(spark, sf)), root, "update")
    return jobs.read_log(spark, log, ["ticker", "hour"])


@query(
    "stream_sliding",
    """SELECT ticker, start, start + INTERVAL 24 HOUR AS "end", CAST(sum(mentions) AS BIGINT) AS mentions FROM
      (SELECT ticker, mentions, unnest(generate_series(hour - INTERVAL 23 HOUR, hour, INTERVAL 1 HOUR)) AS start FROM v_hourcount)
    WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM v_mention) GROUP BY ticker, start""",
)
def stream_sliding(spark, sf):
    """Windows that the watermark has closed when the run ends."""
    root = work_dir(spark, "stream-sliding")
    log = jobs.run_to_log(jobs.sliding_mentions(_mention_stream(spark, sf)), root, "append")
    return jobs.read_log(spark, log, ["ticker", "start", "end"])


@query(
    "stream_velocity",
    """SELECT ticker, hour, mentions, round(velocity, 6) AS velocity FROM v_velocity
    WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM v_mention)""",
)
def stream_velocity(spark, sf):
    """Hours that the watermark has closed when the run ends."""
    jobs.use_rocksdb_state(spark)
    root = work_dir(spark, "stream-velocity")
    log = jobs.run_to_log(jobs.running_velocity(_mention_stream(spark, sf)), root, "append")
    return rounded(jobs.read_log(spark, log, ["ticker", "hour"]), "velocity")


@query("stream_dedupe", "SELECT DISTINCT url FROM v_clean")
def stream_dedupe(spark, sf):
    """Landed items with their canonical address; an address counts once within 24 hours of its first item.

    The items of this run lie within that time or in one batch, so each address comes out once.
    """
    path = land(spark, landed_items(v.raw_items(spark, sf)), "items")
    landed = map_news_items(jobs.file_stream(spark, path, RAW_LANDED, "json"))
    keyed = landed.select(tx.canonical_url(tx.validated_url(F.col("url"))).alias("url"), "published_at")
    root = work_dir(spark, "stream-dedupe")
    log = jobs.run_to_log(jobs.first_by_url(keyed, "24 hours"), root, "append")
    return spark.read.parquet(log).select("url")


@query(
    "stream_upsert",
    """SELECT id, url, hash, credibility FROM (SELECT c.* FROM v_clean c JOIN v_raw r ON r.source_id = c.source_id
      WHERE length(r.title) <= 512 AND length(r.text) <= 20000 AND length(r.lang) BETWEEN 2 AND 5)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY retrieved_at DESC, published_at DESC, hash DESC) = 1""",
)
def stream_upsert(spark, sf):
    """Landed items, validated, normalised and upserted by address."""
    path = land(spark, landed_items(v.raw_items(spark, sf)), "items")
    log = jobs.ingest_articles(spark, path, work_dir(spark, "stream-upsert"))
    return jobs.read_log(spark, log, ["url"]).select("id", "url", "hash", "credibility")


@query(
    "stream_quarantine",
    """SELECT source_id, concat_ws(',', CASE WHEN NOT length(title) <= 512 OR title IS NULL THEN 'title' END,
        CASE WHEN length(text) > 20000 THEN 'text' END, CASE WHEN NOT length(lang) BETWEEN 2 AND 5 OR lang IS NULL THEN 'lang' END)
      AS errors FROM v_raw
    WHERE NOT coalesce(length(title) <= 512 AND length(text) <= 20000 AND length(lang) BETWEEN 2 AND 5, false)""",
)
def stream_quarantine(spark, sf):
    """Landed items that the streaming ingest turns away, with the rules that they break."""
    path = land(spark, landed_items(v.raw_items(spark, sf)), "items")
    root = work_dir(spark, "stream-quarantine")
    jobs.ingest_articles(spark, path, root)
    return spark.read.parquet(f"{root}/quarantine").select("source_id", F.array_join("errors", ",").alias("errors"))


@query(
    "stream_near_dups",
    """SELECT a.id, s.sig AS simhash, (SELECT CASE WHEN f.id <> a.id THEN f.id END FROM v_sigs f
      WHERE bit_count(xor(f.sig, s.sig)) <= 3 ORDER BY f.published_at, f.id LIMIT 1) AS dup_of
    FROM v_article a LEFT JOIN v_sigs s ON s.id = a.id""",
)
def stream_near_dups(spark, sf):
    """Near-duplicate titles over three micro-batches, in no order of time: as if all had come at once."""
    articles = v.articles(spark, sf).select("id", "published_at", "title")
    path = near.land_in_batches(articles, work_dir(spark, "near-landed"), 3, F.xxhash64("id"))
    stream = jobs.file_stream(spark, path, articles.schema, "parquet", maxFilesPerTrigger=1)
    return near.read_marked(spark, near.mark_near_duplicates(stream, work_dir(spark, "near-dups")))
