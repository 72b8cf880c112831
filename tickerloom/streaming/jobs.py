"""Incremental jobs. Each runs over what has landed and stops; the same job resumes from its checkpoint.

Results go to a log with one folder per micro-batch, written by overwrite so that a repeated batch leaves
one copy. Readers take the newest row per key, which makes the log an upsert table without rewriting it.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickerloom.operators.dedupe import keep_last_in_batch
from tickerloom.operators.normalize import normalize_articles
from tickerloom.operators.validate import check_raw_items, quarantined_rows, valid_rows
from tickerloom.schemas import RAW_LANDED
from tickerloom.sources.readers import map_news_items

HOUR_US, HOUR_MS = 3_600_000_000, 3_600_000


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str, **options: Any) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def run_to_log(stream: DataFrame, root: str, mode: str) -> str:
    """Process everything that has landed; returns the folder of the log."""
    log = f"{root}/log"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return log


def read_log(spark: SparkSession, log: str, keys: list[str]) -> DataFrame:
    """The newest row of every key."""
    return keep_last_in_batch(spark.read.parquet(log), keys, ["batch"]).drop("batch")


def compact_log(spark: SparkSession, log: str, keys: list[str], target: str) -> str:
    """Write the current state of a log as a plain table."""
    read_log(spark, log, keys).write.mode("overwrite").parquet(target)
    return target


# Articles

def ingest_articles(spark: SparkSession, landed_path: str, root: str, **options: Any) -> str:
    """Landed items, mapped, validated, normalised, and upserted by URL into the log whose path is returned.

    Items that break a rule, and lines that don't parse, go to ``root/quarantine`` with the names of the rules, one
    folder per micro-batch as in the log; nothing is lost.
    """
    options = {"columnNameOfCorruptRecord": "_corrupt"} | options
    landed = file_stream(spark, landed_path, RAW_LANDED, "json", **options)
    checked = check_raw_items(map_news_items(landed, keep_corrupt=True))
    unreadable = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("unreadable"))).otherwise(F.col("errors"))
    log = f"{root}/log"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        good = normalize_articles(valid_rows(batch).drop("_corrupt"))
        last = keep_last_in_batch(good, ["url"], ["retrieved_at", "published_at", "hash"])
        last.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        quarantined_rows(batch).write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch_id}")

    query = (
        checked.withColumn("errors", unreadable)
        .writeStream.foreachBatch(upsert)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return log


def first_by_url(stream: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Suppress repeats of a URL within the watermark delay, across micro-batches; state expires with it."""
    return stream.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["url"])


# Mentions

def hourly_mentions(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "ticker").agg(
        F.count("*").alias("mentions")
    )
    return counted.select("ticker", F.col("window.start").alias("hour"), "mentions")


def sliding_mentions(stream: DataFrame, length: str = "24 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Sliding counts of closed windows. Mentions are counted per step first, so each count, not each
    mention, is spread over the windows it belongs to."""
    steps = stream.withWatermark("ts", delay).groupBy(F.window("ts", step), "ticker").agg(F.count("*").alias("n"))
    slid = steps.groupBy(F.window(F.window_time("window"), length, step), "ticker").agg(F.sum("n").alias("mentions"))
    return slid.select("ticker", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mentions")


VELOCITY_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("hour", T.TimestampType()),
        T.StructField("mentions", T.LongType()),
        T.StructField("velocity", T.DoubleType()),
    ]
)


class VelocityProcessor(StatefulProcessor):
    """z-score of each closed hour against the ticker's preceding days.

    Kept per ticker: its first hour, and the non-zero hourly counts of the look-back. A timer in event time drops both once
    the watermark has passed the look-back of the ticker's last hour; a ticker that speaks again after that begins anew.
    """

    def __init__(self, days: int) -> None:
        self.hours = days * 24

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", T.StructType([T.StructField("hour", T.LongType())]))
        self.counts = handle.getListState(
            "counts", T.StructType([T.StructField("hour", T.LongType()), T.StructField("n", T.LongType())])
        )

    def _expiry(self, hour: int) -> int:
        """Milliseconds at which no further hour can have this one in its look-back."""
        return (hour + self.hours + 1) * HOUR_MS

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("hour")
        hours = (arrived["hour"].astype("datetime64[us]").astype("int64") // HOUR_US).tolist()
        held = {int(h): int(n) for h, n in self.counts.get()}
        known = self.first.get()
        first = int(known[0]) if known else hours[0]
        if not known:
            self.first.update((first,))
        held |= dict(zip(hours, arrived["mentions"].tolist(), strict=True))
        line = sorted(held)
        total = list(accumulate((held[h] for h in line), initial=0))
        squares = list(accumulate((held[h] ** 2 for h in line), initial=0))
        scores = []
        for hour, n in zip(hours, arrived["mentions"].tolist(), strict=True):
            a, b = bisect_left(line, hour - self.hours), bisect_left(line, hour)
            scores.append(self._score(n, min(hour - first, self.hours), total[b] - total[a], squares[b] - squares[a]))
        last = line[-1]
        # One message for all hours: each call of a state goes through a socket.
        self.counts.put([(h, held[h]) for h in line if h >= last - self.hours])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self._expiry(last))
        yield pd.DataFrame(
            {
                "ticker": key[0],
                "hour": arrived["hour"].to_numpy(),
                "mentions": arrived["mentions"].to_numpy(),
                "velocity": scores,
            }
        )

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.first.clear()
        self.counts.clear()
        yield from ()

    @staticmethod
    def _score(count: int, n: int, total: int, squares: int) -> float:
        spread = squares * n - total * total
        if n < 2 or spread <= 0:
            return 0.0
        return (count - total / n) / math.sqrt(spread / (n * (n - 1)))

    def close(self) -> None:
        pass


def running_velocity(stream: DataFrame, days: int = 30, delay: str = "1 hour") -> DataFrame:
    """Velocity of each hour once the watermark has closed it.

    Spark counts the hour before the state sees it, so a hot ticker reaches its state as one row per hour.
    """
    return (
        hourly_mentions(stream, delay)
        .groupBy("ticker")
        .transformWithStateInPandas(VelocityProcessor(days), VELOCITY_SCHEMA, "append", "eventTime")
    )


def use_rocksdb_state(spark: SparkSession) -> None:
    """State beyond memory, and the provider that map state needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
