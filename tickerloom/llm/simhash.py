"""Near-duplicate texts by SimHash and a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, bytes_of, tidy
from tickerloom.llm.components import components
from tickerloom.llm.gray_index import GrayForest
from tickerloom.session import stored

#: Bits in which two fingerprints may differ to be linked.
LIMIT = 2
#: Fingerprints that one tree of the index may hold.
TREE_ROWS = 4096
SEED = 42

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)
_BIT_ORDER = np.argsort([8 * lane + shift for shift in range(8) for lane in range(8)])


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles of the lower-cased text, repeats included; of fewer words, the whole sequence; of none, none."""
    w = text.translate(_LOWER).split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``sizes`` hashes: bit i is set if it is set in over half of the run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    size = sizes[full]
    # Runs are cut into pieces of at most 255 hashes, whose votes fit the eight byte lanes of a word.
    pieces = -(-size // 255)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(full)), pieces)
    start = first[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    votes = np.empty((len(start), 64), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, start)
        votes[:, 8 * shift : 8 * shift + 8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    votes = np.add.reduceat(votes[:, _BIT_ORDER], np.cumsum(pieces) - pieces, axis=0)
    bits = (2 * votes > size[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprinter(words: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            parts, sizes = [], []
            for text in bytes_of(batch):
                own = shingles(text, words)
                sizes.append(len(own))
                parts.append(np.fromiter((digest(s, SEED) for s in own), np.uint64, len(own)))
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            found = fingerprints(hashes, np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(mask: int, parts: int) -> list[int]:
    """Masks that add, each, one of ``parts`` shares of the bits that ``mask`` leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _upper_nodes(rows: DataFrame, masks: list[int], limit: int) -> tuple[DataFrame, list[int]]:
    """Put each fingerprint under the nodes of the next level: one more share of its free bits is held fixed.

    Fingerprints that differ in ``limit`` bits agree in one of ``limit + 1`` shares at least, so a close pair
    meets under one of the nodes.
    """
    below = {m: _split(m, limit + 1) for m in masks}
    own: Column = F.array().cast("array<bigint>")
    for mask, subs in below.items():
        own = F.when(F.col("mask") == _signed(mask), F.array(*[F.lit(_signed(s)) for s in subs])).otherwise(own)
    spread = rows.select("fp", F.explode(own).alias("mask"))
    return spread.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))), sorted({s for v in below.values() for s in v})


def _tree_links(limit: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.repeat(np.arange(len(sizes)), sizes)
            root = GrayForest(group, codes.view(np.uint64)).roots(limit)
            apart = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[root[apart]]), pa.array(codes[apart])], names=["a", "b"]
            )

    return run


def close_links(fps: DataFrame, limit: int = LIMIT, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that connect what chains of close pairs connect.

    The upper nodes of the index hold a third of the bits fixed each, and a node with more fingerprints than a tree
    may hold gets nodes below it; this is dealt out by Spark. Under a node that is small enough, a tree in Gray order
    finds the close pairs. A tree gives links to one member of each connected set instead of all its pairs.
    """
    rows, masks, found = fps.select("fp", F.lit(0).cast("long").alias("mask")), [0], None
    while masks:
        spread, masks = _upper_nodes(rows, masks, limit)
        sized = spread.groupBy("mask", "key").count().filter("count > 1")
        fits = F.col("count") <= tree_rows
        few = spread.join(sized.filter(fits), ["mask", "key"])
        trees = few.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        links = trees.mapInArrow(tidy(_tree_links(limit)), "a long, b long")
        found = links if found is None else found.union(links)
        hot = stored(sized.filter(~fits), "simhash-hot")
        if hot.isEmpty():
            break
        rows = spread.join(hot.select("mask", "key"), ["mask", "key"]).select("fp", "mask")
        masks = [m for m in masks if m != (1 << 64) - 1]
    return found


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    limit: int = LIMIT,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id for every row.

    Fingerprints at most ``limit`` bits apart are linked; component_id is the smallest id that links reach. Equal
    fingerprints are one node. A text without words, or null, has fingerprint zero and is linked like any other. A
    null id is never a component_id unless its component has no other id. Repeated rows give repeated rows, other
    columns are ignored, and an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    own = stored(picked.mapInArrow(tidy(_fingerprinter(words)), f"id {kind}, fp long"), "simhash-fingerprints")
    nodes = own.groupBy("fp").agg(F.min("id").alias("least"))
    labels = components(close_links(nodes, limit, tree_rows)).select(F.col("node").alias("fp"), "label")
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stored(named, "simhash-labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(least, "label").select("fp", "component_id")
    return own.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
