"""Near-duplicate titles across micro-batches, with a stored table of signature keys.

Each micro-batch looks up which stored signatures share a key with one of its own, settles these together, and stores the keys of its
signatures by date. Every output is a folder of its batch, written by overwrite, and a batch reads only earlier ones, so a
repeated batch leaves one copy.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.dedupe import near_first, signature_keys, title_signatures
from tickerloom.session import stored

_SIGNATURE = "sig long, first struct<published_at:timestamp,id:long>"
_KEYS = f"key long, {_SIGNATURE}, batch long, date date"


def settle_batch(batch: DataFrame, batch_id: int, root: str, horizon_days: int) -> None:
    """Store the batch's articles with their signatures, the earliest article near each signature concerned, and the keys."""
    spark = batch.sparkSession
    signed = stored(title_signatures(batch.select("id", "published_at", "title")), "near-batch")
    signed.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
    own = signed.filter("simhash is not null").groupBy(F.col("simhash").alias("sig")).agg(F.min(F.struct("published_at", "id")).alias("first"))
    own = stored(own, "near-signatures")
    span = own.agg(F.min("first.published_at").alias("a"), F.max("first.published_at").alias("b")).first()
    known = own.limit(0)
    if batch_id and span.a is not None:
        earlier = spark.read.schema(_KEYS).parquet(f"{root}/keys").filter(F.col("batch") < batch_id)
        # Folders outside of the horizon aren't read.
        near_in_time = earlier.filter(
            F.col("date").between(F.date_sub(F.lit(span.a).cast("date"), horizon_days), F.date_add(F.lit(span.b).cast("date"), horizon_days))
        )
        shared = near_in_time.join(signature_keys(own).select("key").distinct().hint("merge"), "key", "left_semi")
        known = shared.groupBy("sig").agg(F.min("first").alias("first"))
    both = known.unionByName(own).groupBy("sig").agg(F.min("first").alias("first"))
    near_first(stored(both, "near-candidates")).write.mode("overwrite").parquet(f"{root}/firsts/batch={batch_id}")
    keys = signature_keys(own).select("key", "sig", "first").withColumn("date", F.to_date("first.published_at"))
    keys.write.mode("overwrite").partitionBy("date").parquet(f"{root}/keys/batch={batch_id}")


def mark_near_duplicates(stream: DataFrame, root: str, horizon_days: int = 30) -> str:
    """Run over everything that has landed (id, published_at, title); returns ``root``.

    Signatures further apart than ``horizon_days`` days don't meet.
    """

    def settle(batch: DataFrame, batch_id: int) -> None:
        settle_batch(batch, batch_id, root, horizon_days)

    options = {"checkpointLocation": f"{root}/checkpoint"}
    query = stream.writeStream.foreachBatch(settle).options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
    return root


def read_marked(spark: SparkSession, root: str) -> DataFrame:
    """``id``, ``simhash`` and ``dup_of`` of all articles so far: the earliest near copy, null for the earliest itself.

    An earlier copy that lands later moves the mark, as the earliest of all batches' findings counts.
    """
    log = spark.read.parquet(f"{root}/log")
    first = spark.read.schema(f"{_SIGNATURE}, batch long").parquet(f"{root}/firsts").groupBy("sig").agg(F.min("first").alias("first"))
    marked = log.join(first.withColumnRenamed("sig", "simhash").hint("merge"), "simhash", "left")
    return marked.select("id", "simhash", F.when(F.col("first.id") != F.col("id"), F.col("first.id")).alias("dup_of"))


def land_in_batches(articles: DataFrame, path: str, batches: int, order: Any) -> str:
    """Write rows as files in an order, one micro-batch each; for tests and for replays."""
    articles.repartitionByRange(batches, order).write.parquet(path)
    return path
