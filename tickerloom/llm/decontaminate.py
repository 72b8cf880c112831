"""Benchmark items in documents, by CGK embedding, bit-sampling LSH and exact edit distance.

A CGK embedding walks through a string: at each step it writes the character under a pointer, and a random bit of character
and step moves the pointer on or not. Where one of two strings is edited the pointers part, and soon fall back into
step, so that strings a few edits apart differ in few places of their embeddings. Sampled places of the walk that begins at every
few characters of a document are looked up among those of the walks from every character of an item; the samples have the
length that suits the item, and are drawn several times. Edits leave a known share of such samples equal, so a place of an
item's size that has enough of them, in the item's order, is a candidate. The edit distance between the item and the
best-fitting part of the text around it decides.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, bytes_of, tidy

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Left out before texts are compared.
_PUNCTUATION = b".,;:!?\"'()[]"


@dataclass(frozen=True)
class Shape:
    """How items from a length in characters on are searched for.

    A walk begins at every ``stride`` characters of a document and counts once if any of the ``samples``, each of ``places`` out of
    its first ``reach`` steps, is that of an item. One for each ``each`` characters of the item makes a candidate; items at the
    least similarity have more, as the tests measure.
    """

    least: int
    reach: int
    places: int
    samples: int
    stride: int
    each: int


#: From the longest items to the shortest. An embedding takes two steps for a character, so a reach of 30 sees fifteen of them.
SHAPES = (
    Shape(64, 30, 14, 3, 4, 42),
    Shape(40, 20, 10, 3, 1, 8),
    Shape(20, 16, 8, 3, 1, 6),
    Shape(8, 12, 6, 3, 1, 5),
    Shape(1, 4, 2, 2, 1, 8),
)


@dataclass(frozen=True)
class Search:
    """Similarity that counts, and what a search holds at once."""

    similarity: float = 0.8  # 1 - edits / characters of the item
    chunk_bytes: int = 1 << 20  # text embedded at once
    block_bytes: int = 4 << 20  # item text searched for in one pass over the documents
    shapes: tuple[Shape, ...] = SHAPES


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER, _PUNCTUATION).split()


_PRIME = np.uint64(0xD6E8FEB86659FD93)


def _walk(shape: Shape) -> tuple[np.ndarray, list[set[int]]]:
    """Which characters move the pointer on at each step, and the steps that each sample takes."""
    rng = np.random.default_rng((shape.reach, shape.places, 7))
    moves = rng.integers(0, 2, (shape.reach, 256), dtype=np.int32)
    return moves, [set(rng.choice(shape.reach, shape.places, replace=False).tolist()) for _ in range(shape.samples)]


def embed_keys(text: np.ndarray, start: np.ndarray, shape: Shape) -> np.ndarray:
    """The sampled characters, hashed, of the walks from ``start``; a row for each sample.

    The text must go on for ``reach`` bytes after the last start.
    """
    moves, taken = _walk(shape)
    keys = np.zeros((len(taken), len(start)), np.uint64)
    for at in range(0, len(start), 1 << 15):
        part = slice(at, at + (1 << 15))
        place = start[part].astype(np.int32)
        for step, move in enumerate(moves):
            now = text[place]
            for i, steps in enumerate(taken):
                if step in steps:
                    keys[i, part] = (keys[i, part] ^ now) * _PRIME
            place += move[now]
    return keys


def padded(text: bytes, reach: int) -> np.ndarray:
    return np.frombuffer(text + bytes(reach + 1), np.uint8)


class _Table:
    """Sampled walks of the items of one shape.

    Equal samples of an item within half a bin of each other are one entry, so that an item that repeats itself has a few.
    """

    def __init__(self, shape: Shape, items: np.ndarray, texts: list[bytes], similarity: float):
        self.shape, self.items = shape, items
        size = np.array([len(t) for t in texts], np.int64)
        # Edits that add or leave out characters shift what follows, at most by all the edits allowed.
        self.half = np.maximum(8, np.ceil((1 - similarity) * size / 2)).astype(np.int64)
        self.enough = np.maximum(1, size // shape.each)
        self.length = size
        # A walk that leaves the item sees what follows it, which documents don't share.
        count = np.maximum(1, size - shape.reach // 2 + 1)
        item = np.repeat(np.arange(len(texts)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = np.cumsum(size + shape.reach + 1) - (size + shape.reach + 1)
        joined = padded(b"".join(t + bytes(shape.reach + 1) for t in texts), shape.reach)
        bin_ = place // self.half[item]
        self.rows = []
        for keys in embed_keys(joined, first[item] + place, shape):
            order = np.lexsort((bin_, item, keys))
            k, i, b = keys[order], item[order], bin_[order]
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            bits = np.uint64(64 - max(16, (16 * len(k)).bit_length()))
            known = np.zeros(1 << (64 - int(bits)), bool)
            known[self._slot(k, bits)] = True
            self.rows.append((k[fresh], i[fresh], b[fresh], known, bits))

    @staticmethod
    def _slot(keys: np.ndarray, bits: np.uint64) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * _PRIME) >> bits

    def places(self, joined: np.ndarray, size: int, first: np.ndarray, slice_rows: int = 1 << 18) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, begin, end) in bytes of the joined documents, which begin at ``first``, of the candidates."""
        start = np.arange(0, size, self.shape.stride)
        margin = 2 * (self.length // self.half + 2)
        slots = size // int(self.half.min()) + 2 * int(margin.max()) + 2
        found = []
        for keys, (sorted_keys, item_of, bin_of, known, bits) in zip(embed_keys(joined, start, self.shape), self.rows, strict=True):
            at = np.flatnonzero(known[self._slot(keys, bits)])
            own = keys[at]
            low = np.searchsorted(sorted_keys, own, "left")
            count = np.searchsorted(sorted_keys, own, "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            ends = np.cumsum(count)
            begin = 0
            while begin < len(at):
                # Bounded memory, however often a text repeats what an item holds.
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + slice_rows)))
                n = count[begin:end]
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low[begin:end], n)
                window = np.repeat(at[begin:end], n)
                item = item_of[entry]
                doc = np.searchsorted(first, start[window], "right") - 1
                # Where the item would begin, in halves of its bin and counted from some before the document.
                slot = (start[window] - first[doc]) // self.half[item] - bin_of[entry] + margin[item]
                found.append(np.unique((window * len(self.items) + item) * slots + slot))
                begin = end
        if not found:
            return
        # A window counts once for an item and slot, whichever sample it has.
        window, slot = np.divmod(np.unique(np.concatenate(found)), slots)
        window, item = np.divmod(window, len(self.items))
        doc = np.searchsorted(first, start[window], "right") - 1
        # Three neighbouring slots hold what belongs together: entries are known to half a bin, and edits shift by one.
        around = ((doc * len(self.items) + item) * slots + slot)[:, None] + np.array([-1, 0, 1])
        around, hits = np.unique(around, return_counts=True)
        pair, slot = np.divmod(around, slots)
        doc, item = np.divmod(pair, len(self.items))
        good = hits >= self.enough[item]
        doc, item, slot = doc[good], item[good], slot[good]
        half, length = self.half[item], self.length[item]
        middle = first[doc] + (slot - margin[item]) * half
        # The slot's item begins within two halves before or after; edits may add as much again.
        yield from zip(doc.tolist(), self.items[item].tolist(), (middle - 3 * half).tolist(), (middle + length + 5 * half).tolist(), strict=True)


class ItemIndex:
    """The items of one block, by the shape that suits their length."""

    def __init__(self, items: list[tuple], search: Search):
        self.search = search
        self.ids = [i for i, _ in items]
        joined = [b" ".join(words_of(t)) for _, t in items]
        self.text = [t.decode("utf-8", "replace") for t in joined]
        self.tables = []
        longer = math.inf
        for shape in search.shapes:
            own = [i for i, t in enumerate(joined) if shape.least <= len(t) < longer]
            longer = shape.least
            if own:
                self.tables.append(_Table(shape, np.array(own), [joined[i] for i in own], search.similarity))

    def spans(self, words: list[list[bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, word after the last) of the candidates."""
        texts = [b" ".join(w) for w in words]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        whole = b"\n".join(texts)
        joined = padded(whole, max([t.shape.reach for t in self.tables], default=0))
        ends: dict[int, np.ndarray] = {}
        for table in self.tables:
            for doc, item, begin, end in table.places(joined, len(whole), first):
                if doc not in ends:
                    ends[doc] = first[doc] + np.cumsum([len(w) + 1 for w in words[doc]])
                a = int(np.searchsorted(ends[doc], begin, "right"))
                b = int(np.searchsorted(ends[doc], end, "right")) + 1
                if a < len(words[doc]):
                    yield doc, item, a, min(b, len(words[doc]))

    def hits(self, texts: list[bytes]) -> list[list[tuple]]:
        """For each text (item id, edits, similarity, first and last word of the region that holds it)."""
        words = [words_of(t) for t in texts]
        places: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for doc, item, a, b in self.spans(words):
            places[doc, item].append((a, b))
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for pair, spans in places.items():
            known = regions[pair] = []
            for a, b in sorted(spans):
                if known and a <= known[-1][1]:
                    known[-1][1] = max(b, known[-1][1])
                else:
                    known.append([a, b])
        out: list[list[tuple]] = [[] for _ in texts]
        for (doc, item), spans in regions.items():
            text = self.text[item]
            most = math.floor((1 - self.search.similarity) * len(text) + 1e-9)
            best = None
            for a, b in spans:
                edits = fitting_distance(text, b" ".join(words[doc][a:b]).decode("utf-8", "replace"))
                if edits <= most and (best is None or edits < best[0]):
                    best = (edits, a, b)
            if best:
                edits, a, b = best
                out[doc].append((self.ids[item], edits, 1 - edits / max(1, len(text)), a, b))
        return out


def fitting_distance(pattern: str, text: str) -> int:
    """Fewest edits between the pattern and any part of the text (bit-parallel over the pattern)."""
    if pattern in text:
        return 0
    m = len(pattern)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    get = where.get
    for c in text:
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
    return best


def _chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


_INDEXES: dict[bytes, ItemIndex] = {}


def _index(packed: bytes) -> ItemIndex:
    """The index of a block, built once in a worker; the last two stay."""
    key = hashlib.sha256(packed).digest()
    if key not in _INDEXES:
        while len(_INDEXES) > 1:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[key] = ItemIndex(*pickle.loads(packed))
    return _INDEXES[key]


def _all_hits(packed: bytes, batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, list[tuple]]]:
    index = _index(packed)
    for at, texts in _chunks(bytes_of(batch, text_col), index.search.chunk_bytes):
        for i, found in enumerate(index.hits(texts)):
            yield at + i, found


def _blocks(items: DataFrame, id_col: str, text_col: str, search: Search) -> list:
    """Items in broadcast blocks of bounded bytes, so that any number of items can be searched for."""
    picked = items.select(items[id_col].alias("id"), items[text_col].alias("text")).filter(F.trim("text") != "")
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // search.block_bytes))
    sc, out = items.sparkSession.sparkContext, []
    for block in range(count):
        rows = picked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).distinct().collect()
        rows = sorted(((r.id, r.text.encode("utf-8", "replace")) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            out.append(sc.broadcast(pickle.dumps((rows, search))))
    return out


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    search: Search = Search(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item that it holds: ids, edits, similarity, first_word and last_word.

    Letters A-Z are lower-cased, runs of white space are one space, and some punctuation is left out before texts are
    compared. The words are those of the searched region around the best-fitting part. Null and empty texts hold nothing
    and are no items; null ids are kept; repeated documents give repeated rows, repeated items count once; other columns
    are ignored. Documents are read once for each block of items and never shuffled.
    """
    kinds = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kinds[0]}, item {kinds[1]}, edits int, similarity double, first_word int, last_word int"

    def search_in(block) -> DataFrame:
        def run(batches: Batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, *hit) for i, hits in _all_hits(block.value, batch, "text") for hit in hits]
                columns = list(zip(*found, strict=True)) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], _ARROW.get(kinds[1])),
                        pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.float64()),
                        pa.array(columns[4], pa.int32()),
                        pa.array(columns[5], pa.int32()),
                    ],
                    names=["id", "item", "edits", "similarity", "first_word", "last_word"],
                )

        return picked.mapInArrow(tidy(run), schema)

    out = None
    for block in _blocks(items, item_col, item_text_col, search):
        found = search_in(block)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def without_items(
    docs: DataFrame,
    items: DataFrame,
    search: Search = Search(),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold none of the items; see ``contaminated``."""
    for block in _blocks(items, item_col, item_text_col, search):

        def run(batches: Batches, block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not found for _, found in _all_hits(block.value, batch, text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
