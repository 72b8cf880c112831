"""A block join for work over all members of a group, when the group may be huge or tiny.

Every key's rows are cut into blocks of a set size on both sides. Each pair of blocks meets in its own
task call, where the kernel reduces it to at most a few rows per left row. So no task ever holds more than
one block of each side, whatever the size of the group, and no pair of rows is emitted. Keys that fit one
block are bundled to about one block per call, as a call per tiny key would cost more than its work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame]


def _blocks(n: str, block_rows: int) -> Column:
    return F.ceil(F.col(n) / F.lit(block_rows)).cast("int")


def same_key(left: pd.DataFrame, right: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Which (left row, right row) cells of the meeting share their key."""
    both = pd.concat([left[keys], right[keys]])
    codes = both.groupby(keys, sort=False).ngroup().to_numpy()
    return codes[: len(left), None] == codes[None, len(left) :]


def block_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: str,
    right_id: str,
    kernel: Kernel,
    schema: str,
    block_rows: int = 2048,
) -> DataFrame:
    sizes = (
        left.groupBy(*keys)
        .agg(F.count("*").alias("_n_left"))
        .join(right.groupBy(*keys).agg(F.count("*").alias("_n_right")), keys)
        .withColumn("_left_blocks", _blocks("_n_left", block_rows))
        .withColumn("_right_blocks", _blocks("_n_right", block_rows))
        .withColumn("_small", (F.col("_left_blocks") == 1) & (F.col("_right_blocks") == 1))
    )
    small_rows = sizes.filter("_small").agg(F.coalesce(F.sum(F.greatest("_n_left", "_n_right")), F.lit(0))).scalar()
    bundles = F.greatest(F.ceil(F.col("_small_rows") / F.lit(block_rows)), F.lit(1))
    cells = sizes.withColumn("_small_rows", small_rows).select(
        *keys,
        "_left_blocks",
        "_right_blocks",
        F.when(F.col("_small"), F.pmod(F.xxhash64(*keys), bundles)).alias("_bundle"),
    )

    def cut(df: DataFrame, own: str, other: str, id_col: str) -> DataFrame:
        """Put each row into one block of its own side and into a copy for each block of the other side."""
        return (
            df.join(cells, keys)
            .withColumn(f"_{own}", F.pmod(F.xxhash64(id_col), F.col(f"_{own}_blocks")).cast("int"))
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_{other}_blocks") - 1)))
            .withColumn("_key", F.when(F.col("_bundle").isNull(), F.struct(*keys)))
            .drop("_left_blocks", "_right_blocks")
        )

    # Both sides often come from one frame; fresh aliases keep their columns apart.
    cut_left, cut_right = (
        df.select(*[F.col(c).alias(c) for c in df.columns])
        for df in (cut(left, "left", "right", left_id), cut(right, "right", "left", right_id))
    )
    meet = ["_bundle", "_key", "_left", "_right"]
    return cut_left.groupBy(*meet).cogroup(cut_right.groupBy(*meet)).applyInPandas(
        lambda a, b: kernel(a, b, same_key(a, b, keys)), schema
    )
