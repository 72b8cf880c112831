"""Exact duplicates by Grace hashing.

A map pass folds equal texts of a task, so that a text that a third of all rows share leaves each task once. The
distinct texts are spilled into buckets by a hash of their content. A task reads one bucket into an open-addressing
table that compares complete contents and takes no more than its bytes; what doesn't fit is spilled again, under
another hash, until nothing is left over. No task holds more than one table, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import BATCH_BYTES, Batches, texts_of, tidy
from tickerloom.session import stored

#: Deleted before texts are compared.
WHITE_SPACE = b" \t\n\x0b\x0c\r"

#: Bytes of distinct texts that a map task folds before it passes them on, and that one bucket's table takes.
FOLD_BYTES, BUCKET_BYTES = 32 << 20, 64 << 20


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, content: bytes) -> tuple[int, int]:
        """Entry of the content or -1, and the slot where the search ended."""
        code = xxhash.xxh3_64_intdigest(content)
        last = len(self.slots) - 1
        at = code & last
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == code and self.contents[entry] == content:
                return entry, at
            at = (at + 1) & last
        return -1, at

    def add(self, content: bytes, at: int) -> int:
        entry = len(self.contents)
        self.slots[at] = entry
        self.hashes.append(xxhash.xxh3_64_intdigest(content))
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        last = 4 * len(self.slots) - 1
        self.slots = array("q", [-1]) * (last + 1)
        for entry, code in enumerate(self.hashes):
            at = code & last
            while self.slots[at] >= 0:
                at = (at + 1) & last
            self.slots[at] = entry


def spread(content: bytes, level: int) -> int:
    """The hash that deals contents to buckets; each level has its own."""
    return xxhash.xxh64_intdigest(content, level + 1) >> 1


def better(a: tuple, b: tuple) -> tuple:
    """Of two (points, id, row), the one that stays: more code points, then the smaller id (null last), then the row."""
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    return min(a, b, key=lambda x: (x[1] is None, x[1] if x[1] is not None else 0, x[2]))


_CONTENT = [("content", pa.binary()), ("spread", pa.int64()), ("points", pa.int64()), ("size", pa.int64())]


def _fold_schema(kind: pa.DataType) -> pa.Schema:
    """A row with a content stands for a folded group; one without stands for a document."""
    own = [("row", pa.int64()), ("id", kind), ("local", pa.int64()), ("text_sha256", pa.string())]
    return pa.schema(own + _CONTENT)


def _bucket_schema(kind: pa.DataType) -> pa.Schema:
    """A row with a content didn't fit; one without is a group with its row that stays."""
    return pa.schema([("local", pa.int64()), ("row", pa.int64()), ("id", kind)] + _CONTENT)


class _Out:
    """Rows collected into Arrow batches of bounded bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def put(self, **row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += 100 + len(row.get("content") or b"")
        if self.bytes >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.bytes = [], 0


def _folder(fold_bytes: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        out, table, best, sizes, first = None, ContentTable(), [], [], []
        # Numbers of this task's own groups: no other task has them, and a repeated task gives the same.
        local = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def pass_on() -> Iterator[pa.RecordBatch]:
            for entry, content in enumerate(table.contents):
                points, doc, row = best[entry]
                yield from out.put(
                    row=row, id=doc, local=first[entry], content=content, spread=spread(content, 0), points=points,
                    size=sizes[entry],
                )

        for batch in batches:
            out = out or _Out(_fold_schema(batch.schema.field("id").type))
            rows, ids = batch.column("row").to_pylist(), batch.column("id").to_pylist()
            for row, doc, text in zip(rows, ids, texts_of(batch), strict=True):
                content = text.encode("utf-8", "replace").translate(None, WHITE_SPACE)
                entry, at = table.find(content)
                mine = (len(text), doc, row)
                if entry < 0:
                    if table.bytes and table.bytes + len(content) > fold_bytes:
                        yield from pass_on()
                        table, best, sizes, first = ContentTable(), [], [], []
                        entry, at = table.find(content)
                    entry = table.add(content, at)
                    best.append(mine)
                    sizes.append(0)
                    first.append(local)
                    local += 1
                best[entry] = better(best[entry], mine)
                sizes[entry] += 1
                digest = hashlib.sha256(content).hexdigest()
                yield from out.put(row=row, id=doc, local=first[entry], text_sha256=digest)
        if out is not None:
            yield from pass_on()
            yield from out.flush()

    return run


def _matcher(bucket_bytes: int, level: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        out, table, best, sizes = None, ContentTable(), [], []
        members: list[tuple[int, int]] = []
        for batch in batches:
            out = out or _Out(_bucket_schema(batch.schema.field("id").type))
            for r in batch.to_pylist():
                content = r["content"]
                entry, at = table.find(content)
                mine = (r["points"], r["id"], r["row"])
                if entry < 0:
                    if table.bytes and table.bytes + len(content) > bucket_bytes:
                        # The table only grows, so every copy of this content is refused too and meets the others later.
                        yield from out.put(**r | {"spread": spread(content, level + 1)})
                        continue
                    entry = table.add(content, at)
                    best.append(mine)
                    sizes.append(0)
                best[entry] = better(best[entry], mine)
                sizes[entry] += r["size"]
                members.append((r["local"], entry))
        for local, entry in members:
            if sizes[entry] > 1:
                points, doc, row = best[entry]
                yield from out.put(local=local, row=row, id=doc, points=points, size=sizes[entry])
        if out is not None:
            yield from out.flush()

    return run


def _ddl(kind: str, first: str) -> str:
    return f"{first}, content binary, spread long, points long, size long".replace("KIND", kind)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    fold_bytes: int = FOLD_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256, and ``row_col`` if given.

    Texts are equal if they are after ``WHITE_SPACE`` is deleted; a null text counts as empty, and empty texts form a
    group. Of a group the row with the most code points stays, then the smallest id (a null id comes last); of rows
    that repeat both, exactly one stays. ``row_col`` names a column of distinct numbers by which a caller finds the
    rows again; without it, rows are numbered here. Other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    row = docs[row_col] if row_col else F.monotonically_increasing_id()
    picked = docs.select(row.alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    folded = stored(
        picked.mapInArrow(
            tidy(_folder(fold_bytes)), _ddl(kind, "row long, id KIND, local long, text_sha256 string")
        ),
        "exact-folded",
    )
    left, done, level = folded.filter("content IS NOT NULL"), [], 0
    while True:
        total = left.agg(F.sum(F.octet_length("content"))).first()[0]
        if total is None:
            break
        # Buckets are planned at half of what a table takes.
        buckets = max(2 * -(-total // bucket_bytes), docs.sparkSession.sparkContext.defaultParallelism)
        spilled = left.select("local", "row", "id", "content", "spread", "points", "size").repartitionById(
            buckets, F.pmod("spread", F.lit(buckets)).cast("int")
        )
        matched = stored(
            spilled.mapInArrow(tidy(_matcher(bucket_bytes, level)), _ddl(kind, "local long, row long, id KIND")),
            f"exact-level{level}",
        )
        done.append(matched.filter("content IS NULL").select("local", "row", "id", "size"))
        left, level = matched.filter("content IS NOT NULL"), level + 1
    members = folded.filter("content IS NULL").select("row", "id", "local", "text_sha256").alias("m")
    if not done:
        groups = folded.limit(0).select("local", "row", "id", "size").alias("g")
    else:
        groups = done[0]
        for more in done[1:]:
            groups = groups.union(more)
        groups = groups.alias("g")
    # A task's own groups are the join keys: none has more members than the task read.
    alone = F.col("g.size").isNull()
    return members.join(groups, F.col("m.local") == F.col("g.local"), "left").select(
        *([F.col("m.row").alias(row_col)] if row_col else []),
        F.col("m.id").alias(id_col),
        F.when(alone, F.col("m.id")).otherwise(F.col("g.id")).alias("keep_id"),
        F.coalesce("g.size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("m.row") == F.col("g.row"))).alias("kept"),
        F.col("m.text_sha256"),
    )
