"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders taken from ``work_dir`` and not yet released.
_OWNED: list[str] = []


def pin_session(spark: SparkSession) -> SparkSession:
    """Settings every job relies on; sizes and parallelism stay the cluster's choice."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    A session without that setting gets a local folder if its master is local; on a cluster that is an error, as
    executors would write to disks that the others can't read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tickerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _OWNED.append(path)
    return path


def release_work(spark: SparkSession) -> int:
    """Delete every folder that this process took from ``work_dir``, and say how many there were.

    For the end of a job: frames that still read from such a folder can't be used afterwards.
    """
    count = len(_OWNED)
    while _OWNED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_OWNED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several branches of a job read, so that it is computed once and outlives executors."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
