"""Byte-level BPE over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.byte_bpe import encode_decode
from tickerloom.llm.common import table
from tickerloom.llm.registry import query

RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every whole text and of the bytes decoded from them."""
    return encode_decode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )
