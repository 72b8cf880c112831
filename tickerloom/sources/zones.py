"""Raw, clean and feature zones: Parquet partitioned by date, safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.dedupe import keep_last_in_batch
from tickerloom.session import stored
from tickerloom.sources import locator

ZONES = ("raw", "clean", "features")


def write_zone(
    df: DataFrame, root: str, zone: str, table: str, ts: str, sort: list[str] | None = None, mode: str = "replace"
) -> str:
    """Write rows by date. ``replace`` replaces the dates present in ``df`` and leaves the others as they are;
    ``append`` adds the rows to whatever the dates hold.

    Rows are rebalanced by date, so that Spark cuts a heavy day into tasks of its usual partition size and packs
    light ones, and sorted so that row-group statistics can skip.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"no such mode: {mode}")
    if zone not in ZONES:
        raise ValueError(f"no such zone: {zone}")
    path = f"{root.rstrip('/')}/{zone}/{table}"
    if locator.exists(df.sparkSession, root, zone, table):
        df = stored(df, "zone-rows")
        dates = [str(r.date) for r in df.select(F.to_date(ts).alias("date")).distinct().collect()]
        locator.forget(df.sparkSession, root, zone, table, dates)
    _write(df, path, ts, sort or [], "append" if mode == "append" else "overwrite")
    return path


def _write(df: DataFrame, path: str, ts: str, sort: list[str], mode: str) -> None:
    dated = df.withColumn("date", F.to_date(ts))
    (
        dated.hint("rebalance", "date")
        .sortWithinPartitions("date", *sort, ts)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read_zone(spark: SparkSession, root: str, zone: str, table: str, start=None, end=None) -> DataFrame:
    """Read a zone table; bounds prune whole date folders."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{zone}/{table}")
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def drop_dates(spark: SparkSession, root: str, zone: str, table: str, before=None, dates: list | None = None) -> list[str]:
    """Delete whole date folders, those before a date or those listed, without reading a row; gives what went."""
    jvm, path = spark.sparkContext._jvm, f"{root.rstrip('/')}/{zone}/{table}"
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    wanted, gone = {str(d) for d in dates or []}, []
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        date = name.removeprefix("date=")
        if name.startswith("date=") and (date in wanted or (before is not None and date < str(before))):
            fs.delete(status.getPath(), True)
            gone.append(date)
    locator.forget(spark, root, zone, table, gone)
    return sorted(gone)


def upsert_zone(df: DataFrame, root: str, zone: str, table: str, ts: str, keys: list[str], seq: list[str]) -> str:
    """Upsert by key, whatever the date: a key that changes its date leaves its old one.

    The summaries of ``locator`` say which dates hold keys of the batch; only these and the batch's own dates are read and
    written again. A run that breaks off may be repeated.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{zone}/{table}"
    new = stored(keep_last_in_batch(df.withColumn("date", F.to_date(ts)), keys, seq), "zone-upsert")
    _, holding = locator.dates_holding(spark, root, zone, table, keys, new)
    touched = sorted({*holding, *(str(r.date) for r in new.select("date").distinct().collect())})
    old = spark.read.schema(new.schema).parquet(path).filter(F.col("date").isin([F.lit(d).cast("date") for d in touched]))
    kept = old.join(new.select(*keys), keys, "left_anti")
    merged = stored(kept.unionByName(new).drop("date"), "zone-merged")
    left = {str(r.date) for r in merged.select(F.to_date(ts).alias("date")).distinct().collect()}
    locator.forget(spark, root, zone, table, touched)
    _write(merged, path, ts, keys, "overwrite")
    # A date whose rows have all moved away isn't written, so its folder goes.
    drop_dates(spark, root, zone, table, dates=[d for d in touched if d not in left])
    locator.refresh(spark, root, zone, table, keys)
    return path
