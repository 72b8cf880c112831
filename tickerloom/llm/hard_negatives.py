"""Hard negatives: for an anchor and a positive, the best rows of other labels that score well below the positive.

Candidates are cut into blocks of bounded size, each with a cover tree. Every block of queries meets every tree in a
step of its own and returns a few rows for each query, so nothing grows but the number of meetings. Equal queries, and
equal candidates beyond what a result can hold, are searched once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, spread_lookup
from tickerloom.llm.cover_tree import CoverTree
from tickerloom.session import stored


@dataclass(frozen=True)
class Mining:
    """What is mined; ``tree_bytes`` bounds the vectors under a tree, ``query_bytes`` those of a block of queries."""

    positives: int = 5
    negatives: int = 3
    scale: int = 256
    every: int = 50
    #: A negative's score lies between these hundredths of the positive's.
    low: int = 50
    high: int = 95
    tree_bytes: int = 4 << 20
    query_bytes: int = 1 << 20

    def window(self, positive: int) -> tuple[int, int]:
        return -(-self.low * positive // 100), self.high * positive // 100


def usable(embeds: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Distinct ``id``, ``label``, ``vec`` of the rows that take part, in whole numbers.

    A component becomes floor(scale * x); beyond 64 bits it is the largest or smallest such number.
    """
    vec = embeds[vec_col]
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeds.filter(embeds[label_col].isNotNull() & embeds[id_col].isNotNull() & vec.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    whole = F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    own = rows.select(rows[id_col].cast("long").alias("id"), rows[label_col].cast("long").alias("label"), whole.alias("vec"))
    # A row is found again by its id, so one that is repeated as a whole counts once.
    return own.dropDuplicates(["id", "label", "vec"])


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(width: int, build: bool):
    """One row for a block: its cover tree, or its queries."""

    def run(table: pa.Table) -> pa.Table:
        vectors = _matrix(table.column("vec").to_pylist(), width)
        if build:
            data = CoverTree(vectors, table.column("id").to_numpy(), table.column("label").to_numpy()).state()
        else:
            data = (vectors, *(table.column(c).to_pylist() for c in ("query", "label", "scores")))
        return pa.table({"block": table.column("block")[:1], "data": pa.array([pickle.dumps(data)], pa.binary())})

    return run


def _blocks(rows: DataFrame, width: int, size: int, key: Column, build: bool) -> tuple[DataFrame, int]:
    per_block = max(64, size // (8 * max(1, width)))
    n = max(1, -(-rows.count() // per_block))
    placed = rows.withColumn("block", F.pmod(key, F.lit(n)).cast("int"))
    return stored(placed.groupBy("block").applyInArrow(_packed(width, build), "block int, data binary"), "negatives-blocks"), n


_FOUND = pa.schema([("query", pa.string()), ("positive_score", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
_LARGEST = (1 << 63) - 1


def _meeting(mining: Mining, positives: bool):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        block, asked = None, None
        for batch in batches:
            for index, data in zip(batch.column("index").to_pylist(), batch.column("data"), strict=True):
                if index != block:
                    # The queries come before the tree that they meet.
                    block, asked = index, pickle.loads(data.as_buffer())
                    continue
                tree, out = CoverTree.of(pickle.loads(data.as_buffer())), []
                for vector, query, label, scores in zip(*asked, strict=True):
                    if positives:
                        own = sum(x * x for x in vector.tolist())
                        windows, k = {min(_LARGEST, own): (-float("inf"), float("inf"))}, mining.positives + 1
                    else:
                        windows, k = {s: w for s in scores if (w := mining.window(s))[0] <= w[1]}, mining.negatives
                    low, high = [w[0] for w in windows.values()], [w[1] for w in windows.values()]
                    found, _ = tree.search(vector, label, positives, low, high, k)
                    for of, rows in zip(windows, found, strict=True):
                        out += [(query, of, max(-_LARGEST - 1, min(_LARGEST, s)), i) for s, i in rows]
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def _met(trees: DataFrame, n_trees: int, queries: DataFrame, n_queries: int, mining: Mining, positives: bool) -> DataFrame:
    """What every query finds under every tree."""
    a = queries.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("t"), F.lit(0).alias("kind"), "data")
    b = trees.select(F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), F.col("block").alias("t"), F.lit(1).alias("kind"), "data")
    index = F.col("t").cast("long") * n_queries + F.col("q")
    both = a.unionByName(b).select(index.alias("index"), "kind", "data")
    # A meeting is little data and much work: meetings are dealt out by number.
    tasks = min(n_trees * n_queries, 100_000)
    dealt = both.repartitionById(tasks, F.pmod("index", F.lit(tasks)).cast("int")).sortWithinPartitions("index", "kind")
    return dealt.mapInArrow(_meeting(mining, positives), "query string, positive_score long, score long, id long")


def mine(
    embeds: DataFrame,
    mining: Mining | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``mining.every``. A score is the inner product of the whole-numbered vectors;
    higher scores come first, then smaller ids. An anchor's positives are its first other rows of the same label. For each, rank 1
    and on are the first rows of other labels whose scores lie between the given hundredths of the positive's, so a
    negative score of a positive has none. Rows without id, label or vector, or with a component that is null or not finite, take no
    part; a row repeated as a whole counts once; a row isn't its own positive; a shorter vector goes on with zeros; scores beyond 64 bits are given as the largest or smallest number. Other columns are ignored; an empty table
    gives no rows.
    """
    mining = mining or Mining()
    own = stored(usable(embeds, mining.scale, id_col, vec_col, label_col), "negatives-rows")
    width = own.agg(F.max(F.size("vec"))).first()[0] or 0
    # Of equal vectors of a label, no more can be in a result than it has places, and one for the anchor itself.
    places = max(mining.positives + 1, mining.negatives)
    order = W.partitionBy("label", "vec").orderBy("id")
    first = own.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= places).drop("n")
    trees, n_trees = _blocks(first, width, mining.tree_bytes, F.xxhash64("id", "label"), build=True)
    text = F.concat_ws(",", F.col("label").cast("string"), F.concat_ws(",", F.col("vec").cast("array<string>")))
    anchors = own.filter(F.col("id") % mining.every == 0).withColumn("query", F.sha2(text, 256))
    queries = stored(anchors.dropDuplicates(["query"]).select("query", "label", "vec"), "negatives-queries")
    no_scores = queries.withColumn("scores", F.array().cast("array<long>"))
    blocks, n_queries = _blocks(no_scores, width, mining.query_bytes, F.xxhash64("query"), build=False)
    near = _met(trees, n_trees, blocks, n_queries, mining, positives=True)
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    near = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= mining.positives + 1)
    ordered = F.sort_array(F.collect_list(F.struct("n", "id", "score")))
    ordered, norm = ordered.alias("positives"), F.first("positive_score").alias("norm")
    positives = stored(near.groupBy("query").agg(ordered, norm), "negatives-positives")
    scored = queries.join(positives, "query").withColumn("scores", F.array_distinct(F.col("positives.score"))).drop("positives", "norm")
    blocks, n_queries = _blocks(scored, width, mining.query_bytes, F.xxhash64("query"), build=False)
    far = _met(trees, n_trees, blocks, n_queries, mining, positives=False)
    best = W.partitionBy("query", "positive_score").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= mining.negatives)
    negatives = far.groupBy("query").agg(F.collect_list(F.struct("positive_score", "rank", "id", "score")).alias("negatives"))
    answers = stored(positives.join(negatives, "query"), "negatives-found")
    met = spread_lookup(anchors.select("id", "query"), answers, "query", "id").filter("negatives IS NOT NULL")
    others = F.filter("positives", lambda p: (p["id"] != F.col("id")) | (p["score"] != F.col("norm")))
    of_each = met.select("id", F.explode(F.slice(others, 1, mining.positives)).alias("p"), "negatives")
    of = F.filter("negatives", lambda x: x["positive_score"] == F.col("p.score"))
    return of_each.select("id", "p", F.explode(of).alias("x")).select(
        F.col("id").alias("anchor_id"),
        F.col("p.id").alias("positive_id"),
        F.col("x.rank").cast("int").alias("rank"),
        F.col("x.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("x.score").alias("negative_score"),
    )
