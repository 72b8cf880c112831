"""Pruned meetings of unit vectors by their angles to a few pivots.

The angles of two vectors to a pivot differ by no more than the angle between them. Vectors are put into cells by their
nearest pivot and a band of the angle to it; a cell is described by the range of its members' angles to every pivot, and a vector
needs to meet only the cells that may hold something more similar than what it has found already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a band, in radians; what rounding may take from an angle.
BAND, SLACK = 0.1, 1e-5


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length 1, in double precision whatever they are shipped in."""
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, pivots: int = 16, sample_rows: int = 2048) -> np.ndarray:
    """Far-apart unit vectors from ``sample_rows`` of the rows at most, those that hash lowest (``embedding``)."""
    rows = vectors.select(F.xxhash64("embedding").alias("h"), "embedding").distinct().orderBy("h").limit(sample_rows).collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    picked, nearest = [0], x @ x[0]
    while len(picked) < min(pivots, len(x)):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    return x[picked]


def with_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``angles`` to the pivots and ``cell``, the nearest pivot and the band around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                angles = np.arccos(np.clip(unit_rows(batch["embedding"]) @ pivots.T, -1, 1))
                near = angles.argmin(axis=1)
                band = (angles.min(axis=1) / BAND).astype(int)
                yield batch.assign(angles=list(angles), cell=(near * 64 + band).astype("int32"))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{ddl}, angles array<double>, cell int")


def cell_ranges(rows: DataFrame, keys: list[str], pivots: int) -> DataFrame:
    """Per cell of a key: its members' least and largest angle to each pivot, their first and last time, and their number."""
    ranges = [f(F.col("angles")[i]).alias(f"_{n}{i}") for i in range(pivots) for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(*keys, "cell").agg(
        *ranges, F.min("first_us").alias("_earliest"), F.max("last_us").alias("_latest"), F.count("*").alias("members")
    )


def least_angle(pivots: int) -> Column:
    """Of a vector's ``angles`` and a cell's ranges: an angle below which no member can be."""
    gaps = [F.greatest(F.col(f"_lo{i}") - F.col("angles")[i], F.col("angles")[i] - F.col(f"_hi{i}")) for i in range(pivots)]
    gap = gaps[0] if pivots == 1 else F.greatest(*gaps)
    return F.greatest(gap - SLACK, F.lit(0.0))


def meetings(left: DataFrame, ranges: DataFrame, keys: list[str], pivots: int, found: DataFrame) -> DataFrame:
    """``left`` rows with each further ``cell`` that may hold something more similar than ``found`` says (head, key, sim).

    Cells whose members all lie outside of the row's look-back are left out as well.
    """
    known = left.withColumnRenamed("cell", "_own").join(found.withColumnRenamed("sim", "_sim"), ["head", *keys], "left")
    own_slot = F.col("slot") == F.col("own_slot")
    in_time = F.when(own_slot, F.col("_earliest") < F.col("first_us")).otherwise(F.col("_latest") >= F.col("since_us"))
    may = F.cos(least_angle(pivots)) > F.coalesce("_sim", F.lit(-2.0))
    return known.join(ranges, keys).filter((F.col("cell") != F.col("_own")) & in_time & may).select(*left.columns, "members")

