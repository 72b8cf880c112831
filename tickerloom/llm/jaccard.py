"""Near copies by the exact Jaccard similarity of word shingles.

Sampled minima of a text's shingle hashes, several together, make its keys; texts as similar as wanted share a key almost
surely. Texts of a key are candidates, and the shingles themselves decide. A small group of a key is compared in pairs; in
a large one all are compared with the first of them, copies leave, and the rest goes on without the first, until no group
is left. So a large group of copies costs one comparison for each, and no group is cut. Each unlike text that leads a
group costs a round, which suits the bounded samples that models are learned on, and not a whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, bytes_of, tidy
from tickerloom.llm.simhash import SEED, shingles
from tickerloom.session import stored

#: Keys of a text, and minima in each: at similarity 0.8 a pair shares none of its keys in 7 of 100,000 cases.
KEYS, MINIMA = 24, 5
#: Members of a key's group up to which all pairs are compared at once.
PAIRED = 8

_PRIME = np.uint64(0xD6E8FEB86659FD93)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd, shift = rng.integers(0, 1 << 63, (2, KEYS * MINIMA), dtype=np.uint64)
    return odd * np.uint64(2) + np.uint64(1), shift


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _PRIME
    return (x ^ (x >> np.uint64(29))) * _PRIME


def keys_of(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The keys of a text with these shingle hashes, at least one."""
    odd, shift = factors
    least = np.full(len(odd), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1024):  # bounded memory for a long text
        np.minimum(least, (odd[:, None] * hashes[at : at + 1024] + shift[:, None]).min(axis=1), out=least)
    key = np.arange(KEYS, dtype=np.uint64)
    for own in least.reshape(KEYS, MINIMA).T:
        key = _mixed(key ^ own)
    return key.view(np.int64)


def _sketcher(words: int):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        digest, factors = xxhash.xxh64_intdigest, _factors()
        for batch in batches:
            keys, sets = [], []
            for text in bytes_of(batch):
                own = set(shingles(text, words))
                hashes = np.fromiter((digest(s, SEED) for s in own), np.uint64, len(own))
                keys.append(keys_of(hashes, factors) if len(own) else np.zeros(0, np.int64))
                sets.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sets, pa.list_(pa.int32())),
                ],
                names=["id", "size", "keys", "shingles"],
            )

    return run


def _verifier(similarity: float):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for one, other in zip(batch.column("one"), batch.column("other"), strict=True):
                a, b = one.values.to_numpy(), other.values.to_numpy()
                shared = len(np.intersect1d(a, b, assume_unique=True))
                same.append(shared >= similarity * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("b").filter(pa.array(same, pa.bool_()))], names=["id"])

    return run


def later_copies(
    docs: DataFrame, id_col: str = "id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``id`` of the rows to leave out so that no two rows left are similar; ids must be distinct.

    Similar means a Jaccard similarity of at least ``similarity`` between the sets of ``words``-word shingles (lower-cased;
    hashed to 32 bits). Each row left out is similar to one with a smaller id, left or left out itself. A text without words, or
    null, is similar to none.
    """
    kind = dict(docs.dtypes)[id_col]
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kind}, size int, keys array<long>, shingles array<int>"
    sketch = stored(picked.mapInArrow(tidy(_sketcher(words)), schema), "near-sketches")
    live = sketch.select("id", "size", F.explode("keys").alias("key"))
    found = []
    while True:
        groups = live.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "size")).alias("first"))
        # What is alone under a key is done with there.
        live = stored(live.join(groups.filter("n > 1"), "key"), "near-groups")
        if live.isEmpty():
            break
        few = live.filter(F.col("n") <= PAIRED).select("key", "id", "size")
        paired = few.select("key", F.col("id").alias("a"), F.col("size").alias("size_a")).join(
            few.select("key", F.col("id").alias("b"), "size"), "key"
        )
        led = live.filter(F.col("n") > PAIRED)
        pairs = paired.select("a", "size_a", "b", "size").union(led.select("first.id", "first.size", "id", "size")).filter("a < b")
        alike = F.least("size", "size_a") >= similarity * F.greatest("size", "size_a")
        pairs = stored(pairs.filter(alike).select("a", "b").distinct(), "near-pairs")
        used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = stored(sketch.select("id", "shingles").join(used, "id", "left_semi"), "near-sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("other")), "b"
        )
        copies = stored(both.select("b", "one", "other").mapInArrow(tidy(_verifier(similarity)), f"id {kind}").distinct(), "near-copies")
        found.append(copies)
        live = led.filter("id <> first.id").select("id", "size", "key").join(copies, "id", "left_anti")
    out = docs.sparkSession.createDataFrame([], f"id {kind}")
    for copies in found:
        out = out.union(copies)
    return out.distinct()
