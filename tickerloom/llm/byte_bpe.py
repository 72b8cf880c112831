"""Byte-level BPE by monoid tree reduction.

A text is cut by the tokenizer's pattern; each match is encoded alone. The encodings of byte strings form a
monoid: ``join(encode(a), encode(b)) == encode(a + b)``. So a match is cut into halves down to small leaves, the
leaves are merged directly, and neighbours are joined up the tree. A join keeps both sides if their touching tokens
are stable together, and otherwise re-encodes a window over the boundary that grows until its edges are stable.

Why that is right: merging picks the lowest rank first and the leftmost on ties. Suppose that every two neighbours of a
token sequence, encoded together, come out as themselves. The first merge of the whole string that crossed a
boundary would also be the first choice within its two tokens alone, which contradicts that. So no merge crosses a
boundary, and the sequence is the encoding of the whole.

Decoding concatenates the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickerloom.llm.common import Batches, texts_of, tidy

_NEVER = 1 << 62

#: Longest byte string that is merged directly without halving it.
LEAF_BYTES = 4
#: Entries of one generation of a worker's memories, of whole pieces and of leaves and windows.
MEMORY = 200_000, 100_000
#: Tokens that are decoded without halving them.
LEAF_TOKENS = 1024
#: A rank file beyond this size isn't sent to the workers.
MAX_RANK_BYTES = 64 << 20


class Memory:
    """Two generations of entries: when the young one is full it becomes the old one, and what isn't asked for again goes."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        known = self.young.get(key)
        if known is None and (known := self.old.get(key)) is not None:
            self.put(key, known)
        return known

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, rank_file: bytes, pattern: str, leaf_bytes: int = LEAF_BYTES, memory: tuple[int, int] = MEMORY):
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.cut = regex.compile(pattern).findall
        self.leaf_bytes, self.memory = max(1, leaf_bytes), memory
        self.forget()

    def forget(self) -> None:
        """Empty the memories."""
        self._pieces, self._parts = map(Memory, self.memory)

    def part(self, data: bytes) -> list[int]:
        """Direct encoding of a leaf or window. These are short and repeat much more than whole words do."""
        known = self._parts.get(data)
        if known is None:
            known = self.merge(data)
            if len(data) <= 32:
                self._parts.put(data, known)
        return known

    def merge(self, data: bytes) -> list[int]:
        """Direct encoding: merge the neighbours of lowest rank until none has a rank."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], _NEVER) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != _NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _NEVER)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _NEVER)
        return [self.ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """Whether two neighbours, encoded together, come out as themselves."""
        return self.part(self.tokens[left] + self.tokens[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two encoded neighbours together."""
        if not left or not right:
            return left + right
        before = after = 1
        while True:
            start, end = max(0, len(left) - before), min(len(right), after)
            window = self.part(b"".join([self.tokens[i] for i in left[start:] + right[:end]]))
            fits_left = start == 0 or self.stable(left[start - 1], window[0])
            fits_right = end == len(right) or self.stable(window[-1], right[end])
            if fits_left and fits_right:
                return left[:start] + window + right[end:]
            before, after = before * (1 if fits_left else 2), after * (1 if fits_right else 2)

    def encode_bytes(self, data: bytes) -> list[int]:
        """Halves first, then the join; a depth of the logarithm of the length."""
        if len(data) <= self.leaf_bytes:
            return self.part(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """A whole piece that is a token is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode_bytes(data)

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def encode(self, text: str) -> list[int]:
        """Each match of the pattern on its own; repeated ones are remembered."""
        cut = self.cut(text)
        found = list(map(self._pieces.young.get, cut))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self._piece(cut[i])
        return list(chain.from_iterable(found))

    def _piece(self, piece: str) -> tuple[int, ...]:
        known = self._pieces.get(piece)
        if known is None:
            known = tuple(self.encode_piece(piece.encode("utf-8", "replace")))
            if len(piece) <= 256:
                self._pieces.put(piece, known)
        return known

    def written(self, ids: Sequence[int]) -> bytes:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids)).encode()


_CODECS: dict[tuple, Codec] = {}


def codec(rank_file: bytes, pattern: str, memory: tuple[int, int] = MEMORY) -> Codec:
    """The codec of this worker, built once."""
    key = (hashlib.sha256(rank_file).digest(), pattern, memory)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern, memory=memory)
    return _CODECS[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return data


#: What ``encode_decode`` can return besides the id column.
OUTPUTS = {
    "ids": pa.list_(pa.int32()),
    "n_tokens": pa.int64(),
    "decoded": pa.string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
_SQL = {"ids": "array<int>", "n_tokens": "long", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    outputs: Sequence[str] = ("ids", "n_tokens", "decoded"),
    id_col: str = "doc_id",
    text_col: str = "text",
    memory: tuple[int, int] = MEMORY,
) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them.

    ``outputs`` picks from ``OUTPUTS``; the digests are of the decimal ids joined by commas and of the decoded bytes.
    A null text counts as empty and has no tokens; a null id is kept; repeated rows each give a row; other columns are
    ignored. One pass without a shuffle; a worker holds one batch and its bounded ``memory`` of pieces and their parts.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    outputs = list(outputs)
    reads = any(name.startswith("decoded") for name in outputs)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern, memory)
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in outputs}
            for text in texts_of(batch):
                ids = own.encode(text)
                raw = own.decode(ids) if reads else b""
                for name in outputs:
                    columns[name].append(_OUT[name](own, ids, raw))
            arrays = [batch.column("id"), *(pa.array(columns[n], OUTPUTS[n]) for n in outputs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *outputs])

    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"id {kind}", *(f"{n} {_SQL[n]}" for n in outputs)])
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(tidy(run, lambda: codec(ranks.value, pattern, memory).forget()), schema).withColumnRenamed("id", id_col)


_OUT = {
    "ids": lambda own, ids, raw: np.array(ids, np.int32),
    "n_tokens": lambda own, ids, raw: len(ids),
    "decoded": lambda own, ids, raw: raw.decode("utf-8", "replace"),
    "ids_sha256": lambda own, ids, raw: hashlib.sha256(own.written(ids)).hexdigest(),
    "decoded_sha256": lambda own, ids, raw: hashlib.sha256(raw).hexdigest(),
}
