"""Reading tables, bounded Arrow batches, and Arrow helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.session import stored

#: Rows and bytes that Spark puts into one Arrow batch; a batch of long texts ends by its bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

Batches = Iterator[pa.RecordBatch]


def pin_batches(spark: SparkSession) -> SparkSession:
    """Bound the memory of a Python worker: a batch ends at so many rows or bytes, whichever comes first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def release_memory() -> None:
    """Give back to the system what a worker has freed; workers serve many stages, and each would add to what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Batches], Batches], after: Callable[[], None] | None = None) -> Callable[[Batches], Batches]:
    """``run`` for a task, and its memory released when the task ends; ``after`` drops what the worker remembers."""

    def tidied(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            release_memory()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of the texts of a batch, null as empty."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def fold_number(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds if doc_id is not None else 0


def numbered(df: DataFrame, label: str = "numbered") -> tuple[DataFrame, str]:
    """The rows, written once, with a column of distinct numbers under a name that the frame doesn't have yet.

    Numbers given while a table is scanned follow how its files are cut, and that follows the live executors; so they
    are only good if they are written with the rows and read again.
    """
    name = "_row"
    while name in df.columns:
        name = "_" + name
    return stored(df.withColumn(name, F.monotonically_increasing_id()), label), name


def spread_lookup(rows: DataFrame, found: DataFrame, key: str, number: str, shares: int = 4096) -> DataFrame:
    """``rows`` left-joined with ``found``, which has one row for each of some values of ``key``.

    A value may be in very many rows, so they don't meet under it but under it and a share, given by ``number``; what is
    looked up is first copied for the shares of a value that occur, at most ``shares``. Null values find nothing. Suits
    wide rows, which aren't sorted.
    """
    share = F.pmod(F.xxhash64(number), F.lit(shares)).cast("int")
    own = rows.withColumn("_share", share)
    there = own.select(key, "_share").distinct().join(found, key)
    return own.join(there.hint("shuffle_hash"), [key, "_share"], "left").drop("_share")
