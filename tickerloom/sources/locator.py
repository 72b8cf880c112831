"""Which dates of a zone table hold a key, without reading the table.

Beside a table lie, for each date, the hashes of its keys and a Bloom filter of them: all bits of a key are in one bitmap, and a
date has a power of two of these. A batch of keys first meets the bitmaps, then the hashes of the dates that may hold a
key. A date whose summary is missing gets it when it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap, as Spark's bitmap functions have them; bits of a key; bits that a filter has for each key.
BITMAP_BITS, KEY_BITS, BITS_PER_KEY = 32768, 4, 12


def _folder(root: str, zone: str, table: str) -> str:
    return f"{root.rstrip('/')}/{zone}/{table}.keys"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    return top, top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def date_folders(spark: SparkSession, path: str) -> set[str]:
    """Dates that have a folder below a path; none if there is no such path."""
    top, fs = _hadoop(spark, path)
    if not fs.exists(top):
        return set()
    names = [status.getPath().getName() for status in fs.listStatus(top)]
    return {name.removeprefix("date=") for name in names if name.startswith("date=")}


def forget(spark: SparkSession, root: str, zone: str, table: str, dates: list[str]) -> None:
    """Drop the summaries of dates that are about to change."""
    for part in ("bloom", "hashes"):
        for date in dates:
            path, fs = _hadoop(spark, f"{_folder(root, zone, table)}/{part}/date={date}")
            fs.delete(path, True)


def exists(spark: SparkSession, root: str, zone: str, table: str) -> bool:
    path, fs = _hadoop(spark, _folder(root, zone, table))
    return fs.exists(path)


def _bits(h: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BITMAP_BITS)) for i in range(KEY_BITS)]


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def build(spark: SparkSession, root: str, zone: str, table: str, keys: list[str], dates: list[str]) -> None:
    """Summaries of dates of a table, from its key columns."""
    folder = _folder(root, zone, table)
    rows = spark.read.parquet(f"{root.rstrip('/')}/{zone}/{table}").filter(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    _write(rows.select(F.xxhash64(*keys).alias("h"), "date"), f"{folder}/hashes")
    hashes = spark.read.parquet(f"{folder}/hashes").filter(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    needed = F.ceil(F.log2(F.greatest(F.count("*") * (BITS_PER_KEY / BITMAP_BITS), F.lit(1.0))))
    sizes = hashes.groupBy("date").agg(F.pow(F.lit(2.0), needed).cast("bigint").alias("buckets"))
    placed = hashes.join(sizes, "date").select(
        "date", "buckets", F.pmod("h", "buckets").alias("bucket"), F.explode(F.array(*_bits(F.col("h")))).alias("bit")
    )
    _write(placed.groupBy("date", "buckets", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), f"{folder}/bloom")


def refresh(spark: SparkSession, root: str, zone: str, table: str, keys: list[str]) -> None:
    """Summaries for the dates that have none."""
    folder = _folder(root, zone, table)
    missing = date_folders(spark, f"{root.rstrip('/')}/{zone}/{table}") - date_folders(spark, f"{folder}/bloom")
    if missing:
        build(spark, root, zone, table, keys, sorted(missing))


def dates_holding(spark: SparkSession, root: str, zone: str, table: str, keys: list[str], batch: DataFrame) -> tuple[list[str], list[str]]:
    """Dates that may hold a key of the batch, by the filters, and dates that do, by the hashes."""
    refresh(spark, root, zone, table, keys)
    folder = _folder(root, zone, table)
    if not date_folders(spark, f"{folder}/bloom"):
        return [], []
    bloom = spark.read.parquet(f"{folder}/bloom")
    asked = batch.select(F.xxhash64(*keys).alias("h")).distinct()
    sizes = [r.buckets for r in bloom.select("buckets").distinct().collect()]  # powers of two
    placed = asked.withColumn("buckets", F.explode(F.array(*[F.lit(n).cast("bigint") for n in sizes]))).withColumn("bucket", F.pmod("h", "buckets"))

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) != 0

    hit = bloom.join(placed, ["buckets", "bucket"])
    for bit in _bits(F.col("h")):
        hit = hit.filter(is_set(bit))
    may = sorted(str(r.date) for r in hit.select("date").distinct().collect())
    if not may:
        return [], []
    hashes = spark.read.parquet(f"{folder}/hashes").filter(F.col("date").isin([F.lit(d).cast("date") for d in may]))
    found = hashes.join(asked, "h", "left_semi").select("date").distinct().collect()
    return may, sorted(str(r.date) for r in found)
