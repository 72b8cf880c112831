"""WARC archives of pages: Zstandard with a dictionary in front, each record compressed on its own, and repeats as revisits.

An archive is one file. It begins with a skippable frame that holds a dictionary, built from the archive's own records, and
goes on with one Zstandard frame for each record, so that a reader needs nothing but the file and may start at any record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, bytes_of, spread_lookup, to_batch
from tickerloom.session import stored, work_dir

#: Begins the skippable frame of a dictionary in WARC files.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    """``archive_bytes``: records before compression, after which an archive ends. ``sample_bytes``: of these records, spread over
    the whole archive, the dictionary is built, and ``sample_record`` of each at most."""

    archive_bytes: int = 32 << 20
    dictionary_bytes: int = 64 << 10
    sample_bytes: int = 4 << 20
    sample_record: int = 128 << 10
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that all tasks share, and the path within it."""
    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


def record_id(page_id: object, row: int) -> str:
    return f"urn:page:{row}" + ("" if page_id is None else f":{quote(str(page_id), safe='')}")


def page_of(name: str) -> str | None:
    """The page id, as text, in a record's name."""
    parts = name.strip("<>").split(":")
    return unquote(parts[3]) if len(parts) > 3 else None


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, row: int, url: str | None, payload: bytes, first: tuple | None, settings: Settings) -> bytes:
    """A response, or a revisit of the record that ``first`` (page id, row) names.

    Control characters and spaces of the URL are written percent-encoded; without a URL the record's own name stands for it.
    """
    name = record_id(page_id, row)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", settings.date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
    ]
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(*first)}>")]
    else:
        block += payload
    fields += [
        ("WARC-Block-Digest", f"sha1:{_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes], settings: Settings) -> zstandard.ZstdCompressionDict:
    """A dictionary from records all over an archive; of too few records, one that is their beginning."""
    step = max(1, -(-sum(min(len(r), settings.sample_record) for r in records) // settings.sample_bytes))
    samples = [r[: settings.sample_record] for r in records[::step]]
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, samples, k=1024, d=8)
    except zstandard.ZstdError:
        start = b"".join(samples[:8])[: settings.dictionary_bytes]
        return zstandard.ZstdCompressionDict(start, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_of(records: list[bytes], settings: Settings) -> tuple[list[bytes], list[int]]:
    """The frames of an archive, the dictionary's first, and where each record's begins."""
    dictionary = dictionary_of(records, settings)
    data = dictionary.as_bytes()
    frames, at = [struct.pack("<II", DICTIONARY_FRAME, len(data)) + data], []
    place = len(frames[0])
    packer = zstandard.ZstdCompressor(level=settings.level, dict_data=dictionary, write_checksum=True)
    for r in records:
        frames.append(packer.compress(r))
        at.append(place)
        place += len(frames[-1])
    return frames, at


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an open archive."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_FRAME:
        raise ValueError("an archive begins with its dictionary")
    dictionary = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", head)[1]))
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record begins with its version")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a record is damaged, its fields are cut")
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha1:{_digest(block)}" != fields["warc-block-digest"]:
            raise ValueError(f"record {fields['warc-record-id']} is damaged")
        yield fields, block


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("record_bytes", pa.int64()), ("file_bytes", pa.int64())])
_MANIFEST_DDL = "path string, records long, record_bytes long, file_bytes long"


def _writer(folder: str, settings: Settings):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        # The name holds the attempt: what a lost attempt has written is not in the list of archives.
        task, number = TaskContext.get(), 0
        files, base = filesystem(folder)
        held, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal number
            name = f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
            frames, _ = archive_of(held, settings)
            files.create_dir(base, recursive=True)
            with files.open_output_stream(f"{base}/{name}") as out:
                for frame in frames:
                    out.write(frame)
            number += 1
            row = {"path": f"{folder}/{name}", "records": len(held), "record_bytes": size, "file_bytes": sum(map(len, frames))}
            return to_batch({k: [v] for k, v in row.items()}, _MANIFEST)

        for batch in batches:
            ids, rows, urls, firsts = (batch.column(c).to_pylist() for c in ("id", "row", "url", "first"))
            for page, row, url, payload, first in zip(ids, rows, urls, bytes_of(batch, "html"), firsts, strict=True):
                first = (first["id"], first["row"]) if first and first["row"] != row else None
                held.append(record(page, row, url, payload, first, settings))
                size += len(held[-1])
                if size >= settings.archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    settings: Settings | None = None,
) -> DataFrame:
    """Write a record for every page, and return the list of archives: path, records, record_bytes, file_bytes.

    Of pages whose payloads, the HTML in UTF-8 (null: empty), are equal and have at least ``min_bytes`` bytes, the one with
    the smallest id (a null id last; of repeated rows exactly one) becomes a response and all others revisit it. Smaller ones become
    responses. Other columns are ignored; an empty table gives no archive. ``folder`` must be one that all tasks share; by
    default it is a new one below ``spark.checkpoint.dir``. What a payload's first record is, is found by digest and length, and
    looked up by digest and a share of the rows, so that a payload of very many pages is no hot key.
    """
    spark = pages.sparkSession
    settings = settings or Settings()
    html = F.coalesce(pages[html_col], F.lit(""))
    read = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), html.alias("html"))
    rows = work_dir(spark, "warc-rows")
    numbered = read.withColumns({"row": F.monotonically_increasing_id(), "digest": F.sha2("html", 256)})
    # Numbers are good only where they are written, and so are the payloads that go with them.
    numbered.write.option("compression", "zstd").parquet(rows)
    own = spark.read.parquet(rows)
    large = own.filter(F.octet_length("html") >= min_bytes) if min_bytes > 0 else own
    none = F.col("id").isNull()
    groups = large.groupBy("digest").agg(F.min(F.struct(none.alias("none"), "id", "row")).alias("first"), F.count("*").alias("n"))
    firsts = groups.filter("n > 1").select("digest", F.struct("first.id", "first.row").alias("first"))
    planned = spread_lookup(own, firsts, "digest", "row").select("id", "row", "url", "html", "first")
    if min_bytes > 0:
        planned = planned.withColumn("first", F.when(F.octet_length("html") >= min_bytes, F.col("first")))
    folder = folder or work_dir(spark, "warc")
    return stored(planned.mapInArrow(_writer(folder, settings), _MANIFEST_DDL), "warc-archives")


_RECORDS = pa.schema(
    [("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())]
    + [("refers", pa.string()), ("url", pa.string()), ("payload", pa.binary())]
)


def _reader(payloads: bool, rows: int = 500):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                files, name = filesystem(path)
                with files.open_input_stream(name) as source:
                    for fields, block in read_archive(source):
                        records -= 1
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
                        revisit = fields["warc-type"] == "revisit"
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (len(payload), _digest(payload)) != (n, digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                        name, url = fields["warc-record-id"], fields["warc-target-uri"]
                        held.append(
                            {
                                "page": page_of(name),
                                "payload_bytes": n,
                                "payload_digest": digest,
                                "record_type": fields["warc-type"],
                                "refers": page_of(fields["warc-refers-to"]) if revisit else None,
                                "url": None if url == name.strip("<>") else url,
                                "payload": payload if payloads and not revisit else None,
                            }
                        )
                        size += len(payload) if payloads else 0
                        if len(held) >= rows or size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                            held, size = [], 0
                if records:
                    raise ValueError(f"{path} has {records} records fewer than were written")
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)

    return run


def read_archives(archives: DataFrame, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """A row per record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Digests are computed again, of whole payloads, and a difference is an error, as is an archive with other than its number
    of records. The payload is null unless it is asked for,
    and for revisits; these have the length and digest of the payload that they refer to.
    """
    n, cores = archives.count(), archives.sparkSession.sparkContext.defaultParallelism
    # A row stands for a whole archive, so tasks are dealt out by number and not by size.
    dealt = archives.select("path", "records").repartition(max(1, min(n, 4 * cores), n // 64))
    ddl = "page string, payload_bytes long, payload_digest string, record_type string, refers string, url string, payload binary"
    return dealt.mapInArrow(_reader(payloads), ddl).select(
        F.col("page").cast(id_type).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers").cast(id_type).alias("refers_to"),
        "url",
        "payload",
    )
