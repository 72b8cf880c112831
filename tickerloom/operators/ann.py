"""Approximate neighbours by an inverted file with product-quantised residuals.

Centres and codebooks are fitted on a bounded sample; every vector is indexed by its nearest cell and a short code of what is
left of it there. A query compares codes in its nearest cells by tables of partial products, and the best of them
exactly. How many cells that takes is measured on the sample, so that a wanted share of the true neighbours is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions.blocks import block_join
from tickerloom.functions.vectors import dot, unit

#: Vectors that centres and codebooks are fitted on, and the most cells: both bound what the driver holds and sends out.
SAMPLE_ROWS, MAX_LISTS = 32_768, 1024
#: Vectors that are compared with all cells, or with all codes of a block, at a time: bounds the memory of a task.
_AT_ONCE = 256


@dataclass(frozen=True)
class AnnModel:
    """``centres`` of the cells, ``codebooks`` for each share of the dimensions, and ``probes``, the cells a query visits."""

    centres: np.ndarray
    codebooks: tuple[np.ndarray, ...]
    probes: int

    @property
    def cuts(self) -> list[int]:
        """Where the shares of the dimensions begin, and the end."""
        return np.cumsum([0, *(b.shape[1] for b in self.codebooks)]).tolist()

    def nearest(self, vecs: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector, nearest first."""
        own, out = (self.centres**2).sum(axis=1), np.empty((len(vecs), min(n, len(self.centres))), dtype="int64")
        for i in range(0, len(vecs), _AT_ONCE):
            out[i : i + _AT_ONCE] = np.argsort(own - 2 * vecs[i : i + _AT_ONCE] @ self.centres.T, axis=1, kind="stable")[:, :n]
        return out

    def codes(self, vecs: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """One byte for each share of what a vector differs from its cell's centre by."""
        left, cuts = vecs - self.centres[cells], self.cuts
        return np.stack([_nearest(left[:, a:b], book) for a, b, book in zip(cuts, cuts[1:], self.codebooks, strict=False)], axis=1).astype("uint8")

    def rough(self, queries: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of queries and coded vectors, summed up from a table for each share."""
        out, cuts = queries @ self.centres[cells].T, self.cuts
        for j, (a, b, book) in enumerate(zip(cuts, cuts[1:], self.codebooks, strict=False)):
            out += (queries[:, a:b] @ book.T)[:, codes[:, j]]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)])


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's centres, from the first ``k`` rows; a centre that loses all its rows stays."""
    centres = x[:k].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        size = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def lists_for(rows: int, per_list: int = 1000, least: int = 16) -> int:
    """Cells for so many vectors; beyond ``MAX_LISTS`` cells grow instead, and are worked off in blocks."""
    return min(MAX_LISTS, max(least, -(-rows // per_list)))


def _probes(centres: np.ndarray, sample: np.ndarray, k: int, target: float, queries: int = 512) -> int:
    """The fewest cells that hold a share ``target`` of the ``k`` true neighbours of sampled queries."""
    asked = sample[:queries]
    sims = asked @ sample.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    true = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort((centres**2).sum(axis=1) - 2 * asked @ centres.T, axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, _nearest(sample, centres)[true], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def fit_index(
    embeds: DataFrame, lists: int, k: int = 10, target: float = 0.97, parts: int = 16, sample_rows: int = SAMPLE_ROWS
) -> AnnModel:
    """Fit on the unit vectors of at most ``sample_rows`` articles, those whose ids hash lowest.

    Without any vector there is one cell at the origin, of no dimensions.
    """
    vecs = embeds.select(F.sha1(F.col("article_id").cast("string")).alias("h"), unit(F.col("embedding")).alias("vec"))
    rows = vecs.filter("vec is not null").orderBy("h").limit(sample_rows).collect()
    if not rows:
        return AnnModel(np.zeros((1, 0)), (), 1)
    sample = np.array([r.vec for r in rows])
    centres = _kmeans(sample, min(lists, MAX_LISTS, len(sample)))
    left = sample - centres[_nearest(sample, centres)]
    shares = np.array_split(left, min(parts, left.shape[1]), axis=1)
    books = tuple(_kmeans(s, min(256, len(s))) for s in shares)
    return AnnModel(centres, books, _probes(centres, sample, k, target))


def index_rows(embeds: DataFrame, model: AnnModel) -> DataFrame:
    """``article_id``, ``cell`` and ``code`` of every vector that has a length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vecs = np.stack(batch["vec"].to_numpy())
                cells = model.nearest(vecs, 1)[:, 0]
                codes = [c.tobytes() for c in model.codes(vecs, cells)]
                yield pd.DataFrame({"article_id": batch["article_id"], "cell": cells.astype("int32"), "code": codes})

    vecs = embeds.select("article_id", unit(F.col("embedding")).alias("vec")).filter("vec is not null")
    return vecs.mapInPandas(run, "article_id bigint, cell int, code binary")


def _asked(queries: DataFrame, model: AnnModel) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cells=list(model.nearest(np.stack(batch["vec"].to_numpy()), model.probes).astype("int32")))

    vecs = queries.select("query_id", unit(F.col("embedding")).alias("vec")).filter("vec is not null")
    return vecs.mapInPandas(run, "query_id bigint, vec array<double>, cells array<int>")


def _rough_kernel(model: AnnModel, keep: int):
    def kernel(left: pd.DataFrame, right: pd.DataFrame, same_key: np.ndarray) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            codes = np.frombuffer(b"".join(right["code"]), "uint8").reshape(len(right), -1)
            ids, cells = right["article_id"].to_numpy(), right["cell"].to_numpy()
            for at in range(0, len(left), _AT_ONCE):
                part = left.iloc[at : at + _AT_ONCE]
                queries = part["query_id"].to_numpy()
                sims = model.rough(np.stack(part["vec"].to_numpy()), cells, codes)
                sims[~same_key[at : at + _AT_ONCE] | (ids[None, :] == queries[:, None])] = -np.inf
                best = np.argpartition(-sims, min(keep, len(right)) - 1, axis=1)[:, :keep]
                rough = np.take_along_axis(sims, best, axis=1)
                q, j = np.nonzero(np.isfinite(rough))
                found.append((queries[q], ids[best[q, j]], rough[q, j]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "article_id", "rough"), columns, strict=True))).astype(
            {"query_id": "int64", "article_id": "int64", "rough": "float64"}
        )

    return kernel


def ann_topk(
    index: DataFrame,
    embeds: DataFrame,
    queries: DataFrame,
    model: AnnModel,
    k: int = 10,
    threshold: float = 0.7,
    keep: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """Approximate top k of every row of ``queries`` (query_id, embedding): query_id, article_id, similarity, rank.

    Codes alone meet the queries, cell by cell and block by block; the ``keep`` best of a query by its tables (20 k by default) are
    then compared exactly, with vectors looked up by id. An article never matches itself.
    """
    keep = keep or 20 * k
    asked = _asked(queries, model)
    left = asked.select("query_id", "vec", F.explode("cells").alias("cell"))
    schema = "query_id bigint, article_id bigint, rough double"
    found = block_join(left, index, ["cell"], "query_id", "article_id", _rough_kernel(model, keep), schema, block_rows)
    by_rough = W.partitionBy("query_id").orderBy(F.desc("rough"), "article_id")
    few = found.withColumn("_n", F.row_number().over(by_rough)).filter(F.col("_n") <= keep).select("query_id", "article_id")
    vecs = embeds.select("article_id", unit(F.col("embedding")).alias("_a"))
    own = queries.select("query_id", unit(F.col("embedding")).alias("_q"))
    exact = few.join(vecs, "article_id").join(own, "query_id").select("query_id", "article_id", dot(F.col("_q"), F.col("_a")).alias("similarity"))
    best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "article_id")
    ranked = exact.filter(F.col("similarity") > threshold).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k)
