"""Collapse repeated articles: exact by key, near by title SimHash."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.keys import word_hash
from tickerloom.functions.text import words
from tickerloom.session import stored

_BITS, _BLOCK, _DISTANCE = 60, 10, 3
_BLOCKS = range(_BITS // _BLOCK)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key. Spark prunes to one row per key before it shuffles, so a hot key is cheap."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_last_in_batch(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """A later row of one batch replaces an earlier one."""
    return keep_first(df, keys, [F.desc_nulls_last(c) for c in seq])


def dedupe_exact(articles: DataFrame, tie: str = "id") -> DataFrame:
    """One article per canonical URL, then one per title-and-host hash (rows without a hash stay)."""
    order = [F.asc("published_at"), F.asc(tie)]
    by_url = keep_first(articles, ["url"], order)
    # An absent hash is no key at all: such rows get a key of their own.
    own_key = F.when(F.coalesce("hash", F.lit("")) == "", F.concat(F.lit("url "), F.col("url"))).otherwise(F.col("hash"))
    return keep_first(by_url.withColumn("_key", own_key), ["_key"], order).drop("_key")


@F.pandas_udf(T.LongType())
def _majority_bits(hashes: pd.Series) -> pd.Series:
    """Per row, the number whose bits are those that more than half of the hashes have."""
    n = hashes.map(len).to_numpy()
    out = np.zeros(len(n), dtype="int64")
    if n.sum():
        every = np.concatenate(hashes.to_numpy())
        starts = np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
        # One bit at a time: a batch of very long titles takes a few numbers per word, not one per word and bit.
        for bit in range(_BITS):
            ones = np.add.reduceat((every >> bit) & 1, starts)
            out[n > 0] |= (2 * ones > n[n > 0]).astype("int64") << bit
    return pd.Series(out)


def simhash(title: Column) -> Column:
    """60-bit SimHash of the words of a title. Never null, so that Spark needs no filter that computes it again."""
    hashes = F.coalesce(F.transform(words(title), word_hash), F.array().cast("array<bigint>"))
    return F.coalesce(_majority_bits(hashes), F.lit(0).cast("bigint"))


def _pack(sig: Column, blocks: tuple[int, ...]) -> Column:
    """The chosen blocks of a signature, side by side."""
    packed = F.lit(0).cast("bigint")
    for b in blocks:
        part = F.shiftright(sig, b * _BLOCK).bitwiseAND(F.lit((1 << _BLOCK) - 1))
        packed = F.shiftleft(packed, _BLOCK).bitwiseOR(part)
    return packed


def _flips(max_bits: int) -> Column:
    """Masks that flip at most ``max_bits`` of the 30 bits a block key leaves free."""
    free = range(_BITS // 2)
    masks = [sum(1 << b for b in c) for n in range(max_bits + 1) for c in combinations(free, n)]
    return F.expr(f"array({', '.join(f'{m}L' for m in masks)})")


def signature_keys(sigs: DataFrame) -> DataFrame:
    """``sig``, ``first``, ``key``, ``rest``: the twenty keys of each signature, and the bits that the key leaves free."""
    combos = list(combinations(_BLOCKS, _DISTANCE))
    parts = F.array(
        *[
            F.struct(
                (_pack(F.col("sig"), c) + F.lit(i << (_BITS // 2))).alias("key"),
                _pack(F.col("sig"), tuple(b for b in _BLOCKS if b not in c)).alias("rest"),
            )
            for i, c in enumerate(combos)
        ]
    )
    return sigs.select("sig", "first", F.explode(parts).alias("p")).select("sig", "first", "p.key", "p.rest")


def near_first(sigs: DataFrame, hot_rows: int = 256) -> DataFrame:
    """For each distinct signature the earliest ``first`` among signatures within three bits of it.

    Two signatures at most three bits apart agree on at least three of their six 10-bit blocks, so they
    meet under one of twenty 30-bit keys. A key shared by few signatures is joined directly. A key shared
    by many is resolved by neighbourhood instead: sources are spread to the values one flip away, reduced
    to their earliest there, and looked up from two flips away. That is linear in the group and just as exact.

    The joins are by sorting. Stored keys take many times the size of their files in memory, so that Spark, going by the files,
    would send whole sides through the driver.
    """
    keyed = signature_keys(sigs)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    # Most keys belong to one signature and end here; what is left is read several times.
    shared = stored(keyed.join(sizes.hint("merge"), "key"), "simhash-keys")

    few = shared.filter(F.col("members") <= hot_rows)
    other = few.select("key", F.col("rest").alias("other_rest"), F.col("first").alias("other_first"))
    direct = few.join(other.hint("merge"), "key").filter(F.bit_count(F.col("rest").bitwiseXOR(F.col("other_rest"))) <= _DISTANCE)

    many = shared.filter(F.col("members") > hot_rows)
    spread = (
        many.select("key", "rest", "first", F.explode(_flips(1)).alias("flip"))
        .groupBy("key", F.col("rest").bitwiseXOR(F.col("flip")).alias("near"))
        .agg(F.min("first").alias("other_first"))
    )
    looked_up = many.select(
        "sig", "key", F.explode(F.transform(_flips(2), lambda m: m.bitwiseXOR(F.col("rest")))).alias("near")
    ).join(spread.hint("merge"), ["key", "near"])

    found = direct.select("sig", "other_first").union(looked_up.select("sig", "other_first"))
    own = sigs.select("sig", F.col("first").alias("other_first"))
    return found.union(own).groupBy("sig").agg(F.min("other_first").alias("first"))


def _worded(title: str) -> Column:
    return F.coalesce(F.col(title).rlike(r"[\p{L}\p{Nd}]"), F.lit(False))


def title_signatures(articles: DataFrame) -> DataFrame:
    """Add ``simhash`` of the title, null for a title without a word."""
    return articles.withColumn("simhash", F.when(_worded("title"), simhash(F.col("title"))))


def dedupe_simhash(articles: DataFrame, id_col: str = "id", hot_rows: int = 256) -> DataFrame:
    """Add ``simhash`` and ``dup_of``, the id of the earliest near copy (null for the earliest itself).

    Copies of one title share a signature and collapse before any comparison.
    """
    worded = _worded("title")

    # The filter asks for a word and not for a signature, which Spark would compute for the filter alone.
    sigs = (
        articles.filter(worded)
        .groupBy(simhash(F.col("title")).alias("sig"))
        .agg(F.min(F.struct("published_at", id_col)).alias("first"))
    )
    first = near_first(stored(sigs, "simhash"), hot_rows).select(F.col("sig").alias("simhash"), F.col(f"first.{id_col}").alias("_first"))
    return (
        articles.withColumn("simhash", F.when(worded, simhash(F.col("title"))))
        .join(first.hint("merge"), "simhash", "left")
        .withColumn("dup_of", F.when(F.col("_first") != F.col(id_col), F.col("_first")))
        .drop("_first")
    )
