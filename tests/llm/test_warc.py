"""Archives: round trips, revisits, and the form of the files."""

import base64
import hashlib
import random
import struct
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from tickerloom.llm import warc
from tickerloom.llm.common import pin_batches

ODD = [
    (5, "http://a.org/x", "<p>a"), (5, "http://a.org/x", "<p>a"), (3, "http://a.org/y z\n", "<p>a"), (None, None, "<p>a"),
    (7, None, None), (8, "", ""), (None, "", ""), (9, "http://é.org/", "é" * 70_000), (10, "u", "\r\n\r\nWARC/1.1\r\n\x00"),
    (11, "u", "x" * 3_000_000), (12, "u", "x" * 3_000_000), (None, "u", "alone"), (-4, "u", "negative"),
]


def _digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _want(rows, min_bytes):
    groups = defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        groups[html or ""].append((page is None, page or 0, i))
    out = Counter()
    for html, members in groups.items():
        data = html.encode()
        least = min(members)
        for none, page, i in members:
            same = (none, page, i) == least or len(data) < min_bytes
            first = None if same or least[0] else least[1]
            out[None if none else page, len(data), _digest(data), "response" if same else "revisit", first] += 1
    return out


@pytest.mark.parametrize("min_bytes", [0, 5])
@pytest.mark.parametrize("archive_bytes", [400, 32 << 20])
def test_round_trip(spark, tmp_path, min_bytes, archive_bytes):
    pin_batches(spark)
    rng = random.Random(1)
    rows = ODD + [(100 + i, f"http://b.org/{i}", rng.choice(["one page", "another page", f"<p>{rng.random()} of its own</p>"])) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for clash in ("id", "row", "first", "digest", "n", "path", "_share"):
        pages = pages.withColumn(clash, F.lit("x"))
    archives = warc.write_archives(pages, str(tmp_path / "out"), min_bytes, settings=warc.Settings(archive_bytes=archive_bytes))
    got = warc.read_archives(archives, payloads=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == _want(rows, min_bytes)
    texts = Counter((page, html or "") for page, _, html in rows)
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload).decode()) in texts
        else:
            assert r.payload is None
    assert {r.url for r in got if r.page_id == 3} == {"http://a.org/y%20z%0A"} and {r.url for r in got if r.page_id == 7} == {None}
    listed = archives.collect()
    assert sum(r.records for r in listed) == len(rows)
    if archive_bytes == 400:
        assert len(listed) > 20


def test_form_of_an_archive():
    settings = warc.Settings(dictionary_bytes=4096)
    rng = random.Random(2)
    pages = [f"<html><body><nav>Home News Sports</nav><p>{' '.join(rng.choices('abcdefgh', k=30))}</p></body></html>".encode() for _ in range(300)]
    records = [warc.record(i, i, f"http://a.org/{i}", p, (1, 1) if i == 7 else None, settings) for i, p in enumerate(pages)]
    frames, at = warc.archive_of(records, settings)
    data = b"".join(frames)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and magic & 0xFFFFFFF0 == 0x184D2A50 and data[8:12] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    # Each record is one frame, and can be read alone with the dictionary in front.
    for i in (0, 7, 299):
        frame = data[at[i] : (at + [len(data)])[i + 1]]
        assert frame[:4] == b"\x28\xb5\x2f\xfd"
        assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame) == records[i]
    assert records[7].startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and b"WARC-Refers-To: <urn:page:1:1>" in records[7]
    assert pages[7] not in records[7] and pages[8] in records[8]
    plain = sum(len(zstandard.ZstdCompressor(level=settings.level).compress(r)) for r in records)
    assert len(data) < 0.8 * plain


def test_few_records_and_damage():
    import io

    for records in ([warc.record(None, 0, None, b"", None, warc.Settings())], [warc.record("a:b", 0, None, b"x", None, warc.Settings())] * 2):
        data = b"".join(warc.archive_of(records, warc.Settings())[0])
        got = list(warc.read_archive(io.BytesIO(data)))
        assert len(got) == len(records)
        assert {warc.page_of(f["warc-record-id"]) for f, _ in got} == ({None} if len(records) == 1 else {"a:b"})
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"")))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[8:])))


def test_a_cut_archive_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>page {i}") for i in range(50)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, str(tmp_path / "cut"))
    path = archives.first().path
    with open(path, "rb") as file:
        data = file.read()
    for cut in (len(data) - 40, len(data) // 2):
        with open(path, "wb") as file:
            file.write(data[:cut])
        with pytest.raises(Exception, match="fewer than were written|damaged|version|Truncated"):
            warc.read_archives(archives).collect()


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, str(tmp_path / "none"))).count() == 0


def test_lookup_of_a_hot_key(spark):
    from tickerloom.llm.common import spread_lookup

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    found = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, v int")
    got = spread_lookup(rows, found, "k", "id")
    assert got.columns == ["k", "id", "v"] and got.count() == 5000
    assert {(r.v, r["count"]) for r in got.groupBy("v").count().collect()} == {(1, 1667), (2, 1), (None, 3332)}
