"""Readers, zones and streaming over landed files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import dedupe as dd
from tickerloom.operators import features as ft
from tickerloom.session import work_dir
from tickerloom.sources import locator
from tickerloom.sources import readers as rd
from tickerloom.sources import zones as zn
from tickerloom.streaming import jobs
from tickerloom.streaming import neardup as near

ITEM = {
    "source": "gdelt", "source_id": "1", "url": "https://e.com/a?utm_source=x", "published_at": "2023-12-01T12:00:00Z",
    "retrieved_at": "2023-12-01T07:05:00-05:00", "title": "T", "text": "$AAPL up", "lang": "EN", "meta": {"form": "8-K"},
}


def test_read_and_map(spark, tmp_path):
    naive = {**ITEM, "source_id": "2", "published_at": "2023-12-01T12:00:00", "text": "none", "meta": {"form": "S-1"}}
    (tmp_path / "a.json").write_text("\n".join([json.dumps(ITEM), json.dumps(naive), '{"source": "gd']))
    landed = rd.read_raw_json(spark, str(tmp_path))
    rows = {r.source_id: r for r in rd.map_news_items(landed).collect()}
    assert rows["1"].published_at == dt.datetime(2023, 12, 1, 12) and rows["1"].retrieved_at == dt.datetime(2023, 12, 1, 12, 5)
    assert rows["1"].lang == "en" and rows["1"].author is None
    assert rows["2"].published_at is None
    assert landed.filter(F.col("_corrupt").isNotNull() & F.col("source_id").isNull()).count() == 1
    assert [r.source_id for r in rd.map_filings(landed).collect()] == ["1"]
    assert [r.source_id for r in rd.map_posts(landed).collect()] == ["1"]


def test_disabled_sources_are_left_out(spark):
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(2)
    assert rd.union_sources({"a": a, "b": b}, {"a": True}).count() == 1
    assert rd.union_sources({"a": a, "b": b}, {"a": True, "b": True}).columns == ["id", "x"]
    with pytest.raises(ValueError):
        rd.union_sources({"a": a}, {})


def test_zone_overwrites_only_written_dates(spark):
    root = work_dir(spark, "zone")
    day = lambda d, x: spark.createDataFrame([(x, dt.datetime(2024, 1, d))], "x int, ts timestamp")
    zn.write_zone(day(1, 1).union(day(2, 2)), root, "features", "t", "ts")
    zn.write_zone(day(2, 9), root, "features", "t", "ts")
    assert sorted(r.x for r in zn.read_zone(spark, root, "features", "t").collect()) == [1, 9]
    assert [r.x for r in zn.read_zone(spark, root, "features", "t", end="2024-01-01").collect()] == [1]
    with pytest.raises(ValueError):
        zn.write_zone(day(1, 1), root, "other", "t", "ts")


def test_zone_append_upsert_and_drop(spark):
    root = work_dir(spark, "zone")
    day = lambda d, *ks: spark.createDataFrame([(k, x, dt.datetime(2024, 1, d)) for k, x in ks], "k int, x int, ts timestamp")
    read = lambda: sorted((r.k, r.x) for r in zn.read_zone(spark, root, "clean", "t").collect())
    zn.write_zone(day(1, (1, 1)), root, "clean", "t", "ts")
    zn.write_zone(day(1, (2, 2)).union(day(2, (3, 3))), root, "clean", "t", "ts", mode="append")
    assert read() == [(1, 1), (2, 2), (3, 3)]
    zn.upsert_zone(day(1, (2, 8), (2, 9), (4, 4)), root, "clean", "t", "ts", ["k"], ["x"])
    assert read() == [(1, 1), (2, 9), (3, 3), (4, 4)]
    assert zn.drop_dates(spark, root, "clean", "t", before="2024-01-02") == ["2024-01-01"] and read() == [(3, 3)]
    with pytest.raises(ValueError):
        zn.write_zone(day(1, (1, 1)), root, "clean", "t", "ts", mode="merge")


def test_work_folder_needs_a_shared_one_on_clusters():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        work_dir(session, "x")


def test_ingest_keeps_what_it_turns_away(spark, tmp_path):
    from tickerloom.streaming import jobs

    good = '{"source":"sec","source_id":"1","url":"https://a.b/c","published_at":"2024-01-01T00:00:00Z","retrieved_at":"2024-01-01T00:01:00Z","title":"t","text":"x","lang":"en"}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([good, good.replace("sec", "none").replace('"1"', '"2"'), '{"broken']) + "\n")
    root = str(tmp_path / "out")
    log = jobs.ingest_articles(spark, str(tmp_path / "in"), root)
    assert jobs.read_log(spark, log, ["url"]).count() == 1
    rows = {r.source_id: (r.errors, r._corrupt) for r in spark.read.parquet(f"{root}/quarantine").collect()}
    assert rows == {"2": (["source"], None), None: (["unreadable"], '{"broken')}


MENTION = "ticker string, ts timestamp"


def _land_mentions(spark, path, days=6):
    """One file per day, landed in order; most mentions belong to one ticker."""
    rng = random.Random(1)
    rows = []
    for day in range(days):
        day_rows = [
            (rng.choice("HHHHAB"), dt.datetime(2024, 1, 1 + day) + dt.timedelta(minutes=rng.randint(0, 1439))) for _ in range(120)
        ]
        spark.createDataFrame(day_rows, MENTION).coalesce(1).write.mode("append").parquet(path)
        rows += day_rows
    return spark.createDataFrame(rows, MENTION)


def _stream(spark, path):
    return jobs.file_stream(spark, path, spark.read.parquet(path).schema, "parquet", maxFilesPerTrigger=1)


def test_hourly_and_velocity_streams_match_batch(spark):
    path = work_dir(spark, "landed")
    batch = _land_mentions(spark, path)
    log = jobs.run_to_log(jobs.hourly_mentions(_stream(spark, path), "3 hours"), work_dir(spark, "h"), "update")
    counts = ft.mention_counts(batch)
    keyed = lambda df, v: {(r.ticker, r.hour): r[v] for r in df.collect()}
    assert keyed(jobs.read_log(spark, log, ["ticker", "hour"]), "mentions") == keyed(counts, "mentions")

    jobs.use_rocksdb_state(spark)
    log = jobs.run_to_log(jobs.running_velocity(_stream(spark, path), 2, "3 hours"), work_dir(spark, "v"), "append")
    got = keyed(jobs.read_log(spark, log, ["ticker", "hour"]), "velocity")
    want = keyed(ft.velocity(counts, 2), "velocity")
    assert spark.read.parquet(log).select("batch").distinct().count() > 3
    assert len(got) > 0.9 * len(want)
    for key, z in got.items():
        assert z == pytest.approx(want[key])


def test_late_data_is_dropped(spark):
    path = work_dir(spark, "late")
    for day in (5, 6, 1):
        spark.createDataFrame([("A", dt.datetime(2024, 1, day))] * 2, MENTION).coalesce(1).write.mode("append").parquet(path)
    log = jobs.run_to_log(jobs.hourly_mentions(_stream(spark, path), "1 hour"), work_dir(spark, "l"), "update")
    assert sorted(r.hour.day for r in jobs.read_log(spark, log, ["ticker", "hour"]).collect()) == [5, 6]


def test_ingest_is_idempotent_and_last_wins(spark, tmp_path):
    landed, root = tmp_path / "in", work_dir(spark, "ingest")
    landed.mkdir()
    (landed / "1.json").write_text(json.dumps(ITEM))
    log = jobs.ingest_articles(spark, str(landed), root)
    first = jobs.read_log(spark, log, ["url"]).collect()
    assert [(r.url, r.title) for r in first] == [("https://e.com/a", "T")]
    jobs.ingest_articles(spark, str(landed), root)
    assert jobs.read_log(spark, log, ["url"]).collect() == first
    (landed / "2.json").write_text(json.dumps({**ITEM, "title": "New"}) + "\n" + json.dumps({**ITEM, "source": "bad", "url": "https://e.com/b"}))
    jobs.ingest_articles(spark, str(landed), root)
    now = jobs.read_log(spark, log, ["url"]).collect()
    assert [(r.id, r.title) for r in now] == [(first[0].id, "New")]
    target = jobs.compact_log(spark, log, ["url"], work_dir(spark, "compact"))
    assert spark.read.parquet(target).count() == 1


def test_repeats_across_batches(spark):
    path = work_dir(spark, "repeat")
    for _ in range(2):
        spark.createDataFrame([("u", dt.datetime(2024, 1, 1)), ("u", dt.datetime(2024, 1, 1, 1))], "url string, published_at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.file_stream(spark, path, spark.read.parquet(path).schema, "parquet", maxFilesPerTrigger=1)
    log = jobs.run_to_log(jobs.first_by_url(stream), work_dir(spark, "d"), "append")
    assert spark.read.parquet(log).count() == 1


def test_silent_tickers_leave_no_state(spark):
    """Timers drop a ticker's counts and first hour once the watermark has passed its look-back; the runs end by themselves."""
    jobs.use_rocksdb_state(spark)
    root = work_dir(spark, "silent")
    start = dt.datetime(2024, 1, 1)

    def run(hours):
        rows = [(start + dt.timedelta(hours=h), t) for h, t in hours]
        spark.createDataFrame(rows, "ts timestamp, ticker string").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("ts timestamp, ticker string").parquet(f"{root}/in")
        log = jobs.run_to_log(jobs.running_velocity(stream, days=2), root, "append")
        options = {"path": f"{root}/checkpoint", "operatorId": 0}
        held = {
            name: [r.key[0] for r in spark.read.format("statestore").options(stateVarName=name, **options).load().collect()]
            for name in ("first", "counts")
        }
        return held, {(r.ticker, r.hour): r.velocity for r in jobs.read_log(spark, log, ["ticker", "hour"]).collect()}

    held, _ = run([(h, "A") for h in range(5)] + [(1, "B")])
    assert set(held["first"]) == {"A", "B"} and len(held["counts"]) >= 4
    held, _ = run([(30, "B")])
    assert set(held["first"]) == {"A", "B"}
    held, got = run([(60, "C")])
    # A's last hour is 4, and 48 hours after it nothing can look back at it.
    assert set(held["first"]) == {"B"} and set(held["counts"]) == {"B"}
    assert got["B", start + dt.timedelta(hours=30)] > 0
    held, got = run([(300, "D"), (300, "A")])
    assert held == {"first": [], "counts": []}
    assert len(got) == 8


def test_upsert_by_key_whatever_the_date(spark):
    """Keys that change their date leave one row, and only folders that hold a key are written again."""
    root = work_dir(spark, "moves")
    start = dt.datetime(2024, 1, 1)
    rows = [(f"u{d}-{i}", start + dt.timedelta(days=d, hours=i % 24), 0) for d in range(20) for i in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, "url string, ts timestamp, x int")
    path = zn.write_zone(frame(rows), root, "clean", "t", "ts", ["url"])
    files = lambda: {r.date: r.f for r in spark.read.parquet(path).select("date", F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    batch = [("u3-7", start + dt.timedelta(days=9), 1), ("u3-8", start + dt.timedelta(days=3), 1), ("new", start + dt.timedelta(days=30), 1)]
    may, holding = locator.dates_holding(spark, root, "clean", "t", ["url"], frame(batch))
    assert holding == ["2024-01-04"] and len(may) <= 3
    # Every date is found for its own keys, and few others are.
    for d in (0, 7, 19):
        some = [(f"u{d}-{i}", start, 0) for i in range(50)]
        may, holding = locator.dates_holding(spark, root, "clean", "t", ["url"], frame(some))
        assert holding == [str((start + dt.timedelta(days=d)).date())] and len(may) <= 12
    assert locator.dates_holding(spark, root, "clean", "t", ["url"], frame([]))[1] == []
    for _ in range(2):  # again: a repeated batch changes nothing
        zn.upsert_zone(frame(batch), root, "clean", "t", "ts", ["url"], ["x"])
        got = {r.url: (r.ts, r.x) for r in spark.read.parquet(path).collect()}
        assert len(got) == spark.read.parquet(path).count() == 1001
        assert got["u3-7"] == (start + dt.timedelta(days=9), 1) and got["new"][1] == 1
    changed = {d for d, f in files().items() if before.get(d) != f}
    assert {str(d) for d in changed} == {"2024-01-04", "2024-01-10", "2024-01-31"}
    # A date that loses its last row loses its folder, and a rewritten date its summaries.
    zn.upsert_zone(frame([("new", start, 2)]), root, "clean", "t", "ts", ["url"], ["x"])
    assert "2024-01-31" not in locator.date_folders(spark, path)
    zn.write_zone(frame([("only", start, 3)]), root, "clean", "t", "ts", ["url"])
    assert locator.dates_holding(spark, root, "clean", "t", ["url"], frame([("only", start, 0)]))[1] == ["2024-01-01"]
    assert locator.dates_holding(spark, root, "clean", "t", ["url"], frame([("new", start, 0)]))[1] == []


def test_filters_of_many_keys(spark):
    root = work_dir(spark, "many")
    rows = spark.range(40_000).select("id", F.timestamp_seconds(F.lit(1704067200) + F.pmod("id", F.lit(4)) * 86400).alias("ts"))
    zn.write_zone(rows, root, "clean", "t", "ts")
    locator.refresh(spark, root, "clean", "t", ["id"])
    bloom = spark.read.parquet(f"{root}/clean/t.keys/bloom")
    assert {r.buckets for r in bloom.select("buckets").distinct().collect()} == {4}
    for n in (8, 5000, 39_999):
        may, holding = locator.dates_holding(spark, root, "clean", "t", ["id"], spark.createDataFrame([(n,)], "id bigint"))
        assert holding == [f"2024-01-0{n % 4 + 1}"] and set(holding) <= set(may)
    strangers = spark.range(10**6, 10**6 + 20)
    assert locator.dates_holding(spark, root, "clean", "t", ["id"], strangers)[1] == []


def test_near_duplicates_across_batches(spark):
    """Batches in any order, one of them repeated: the marks are those of all articles at once."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        title = " ".join(rng.choices(words, k=12))
        for _ in range(rng.choice([1, 1, 3])):
            t = title.split()
            if rng.random() < 0.5:
                t[rng.randrange(12)] = rng.choice(words)
            rows.append((len(rows), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(20_000)), " ".join(t)))
    rows += [(9000 + i, dt.datetime(2024, 1, 5), "the same title") for i in range(30)] + [(9100, dt.datetime(2024, 1, 2), "..."), (9101, dt.datetime(2024, 1, 2), None)]
    rng.shuffle(rows)
    articles = spark.createDataFrame(rows, "id bigint, published_at timestamp, title string")
    root, path = work_dir(spark, "near"), work_dir(spark, "landed")
    for part in (rows[:100], rows[100:220], rows[220:]):
        spark.createDataFrame(part, articles.schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, articles.schema, "parquet", maxFilesPerTrigger=1)
        near.mark_near_duplicates(stream, root, horizon_days=60)
    want = {r.id: (r.simhash, r.dup_of) for r in dd.dedupe_simhash(articles).collect()}
    got = lambda: {r.id: (r.simhash, r.dup_of) for r in near.read_marked(spark, root).collect()}
    assert got() == want and sum(d is not None for _, d in want.values()) > 60
    near.settle_batch(spark.createDataFrame(rows[100:220], articles.schema), 1, root, 60)
    assert got() == want and near.read_marked(spark, root).count() == len(rows)
    folders = {str(r.date) for r in spark.read.parquet(f"{root}/keys").select("date").distinct().collect()}
    assert len(folders) > 10


def test_velocity_state_takes_few_messages():
    """A ticker of many hours costs as many calls of its states as one of few, and only the look-back is kept."""
    from collections import Counter
    from types import SimpleNamespace

    import pandas as pd

    calls = Counter()

    class Held:
        def __init__(self, name, *_):
            self.name, self.rows = name, {}

        def __getattr__(self, call):
            def counted(*args):
                calls[call] += 1
                if call in ("put", "update"):
                    self.rows = args[0]
                return {"get": self.rows or None if self.name == "first" else iter(self.rows), "iterator": iter(self.rows), "exists": bool(self.rows)}.get(call)

            return counted

    handle = SimpleNamespace(
        getValueState=Held, getMapState=Held, getListState=Held, listTimers=lambda: [], registerTimer=lambda t: None, deleteTimer=lambda t: None
    )
    processor = jobs.VelocityProcessor(2)
    processor.init(handle)
    hours = pd.date_range("2024-01-01", periods=500, freq="h")
    out = pd.concat(processor.handleInputRows(("A",), iter([pd.DataFrame({"ticker": "A", "hour": hours, "mentions": range(500)})]), None))
    assert len(out) == 500 and sum(calls.values()) < 10
    assert [n for _, n in processor.counts.rows] == list(range(451, 500))
