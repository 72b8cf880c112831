"""A corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

Two stages number their rows to find them again; they write the numbered rows once and read only those."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import toxicity
from tickerloom.llm.byte_bpe import encode_decode
from tickerloom.llm.common import numbered, pin_batches, table
from tickerloom.llm.decontaminate import without_items
from tickerloom.llm.exact_dedup import exact_duplicates
from tickerloom.llm.simhash import near_duplicates
from tickerloom.session import pin_session, stored, work_dir

#: No stage with a learned score, a fingerprint by XXH64 or a tokenizer can be written in SQL.
ORACLE_SQL = None


def _pinned(spark: SparkSession) -> SparkSession:
    """Smaller batches than a single operator takes: executors go on from stage to stage and keep the buffers of each."""
    pin_batches(pin_session(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled documents, doesn't reject."""
    _pinned(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    _pinned(spark)
    rows, row = numbered(docs, "pipeline-rows")
    copies = exact_duplicates(rows, row_col=row).filter(~F.col("kept")).select(row)
    return rows.join(stored(copies, "pipeline-copies"), row, "left_anti").drop(row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component (3-word shingles, at most 2 bits apart): the one with the smallest id, a null id
    last, then the first row."""
    _pinned(spark)
    rows, row = numbered(docs, "pipeline-rows")
    own = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("id"), "text")
    copies = near_duplicates(own, id_col="id").filter("id <> component_id").select(F.col("id.row").alias(row))
    return rows.join(stored(copies, "pipeline-near-copies"), row, "left_anti").drop(row)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _pinned(spark)
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, how many they are, and digests of the ids and the decoded bytes."""
    _pinned(spark)
    return encode_decode(
        docs,
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"),
        memory=(120_000, 60_000),  # beside what earlier stages left in the executors
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again before the next stage."""
    _pinned(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
