"""Operators on small frames: literal cases, and brute force where a clever plan could go wrong."""

import datetime as dt
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ann
from tickerloom.operators import backtest as bt
from tickerloom.operators import dedupe as dd
from tickerloom.operators import features as ft
from tickerloom.operators import linking as ln
from tickerloom.operators import lookup as lk
from tickerloom.operators import maintenance as mt
from tickerloom.operators import normalize as nm
from tickerloom.operators import quality as ql
from tickerloom.operators import scoring as sc
from tickerloom.operators import similarity as sim
from tickerloom.operators import stats as st
from tickerloom.operators import topics as tp
from tickerloom.params import ScoreParams
from tickerloom.schemas import RAW_ITEM
from tickerloom.session import stored
from tickerloom.sources import views

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_normalize_whole_item(spark):
    row = (
        "gdelt", "20231201120000-1234567890",
        "https://www.reuters.com/business/finance/apple-stock-rises-earnings-beat-expectations?utm_source=google&utm_medium=cpc#section1",
        T0, T0, "<h1>Apple Stock Rises After Earnings Beat Expectations</h1>", "<p>Apple Inc. (AAPL)</p><p>x</p>", "en",
        "Reuters", "Reuters Staff", {},
    )
    got = nm.normalize_articles(spark.createDataFrame([row], RAW_ITEM)).first()
    assert got.url == "https://www.reuters.com/business/finance/apple-stock-rises-earnings-beat-expectations"
    assert got.title == "Apple Stock Rises After Earnings Beat Expectations"
    assert (got.text, got.lang, got.credibility) == ("Apple Inc. (AAPL)x", "en", 80.0)
    assert got.hash == "adffa9ce463ab2277974c43fd2b9883351d1a862"


def test_boilerplate_keeps_order_and_blank_lines(spark):
    docs = spark.createDataFrame(
        [(i, "s", f"one {i}\n\nSubscribe now \ntwo {i}") for i in range(4)] + [(9, "t", "Subscribe now")],
        "id int, source string, text string",
    )
    got = {r.id: r.text for r in nm.strip_boilerplate(docs, 0.5).collect()}
    assert got[2] == "one 2\n\ntwo 2" and got[9] == "Subscribe now"


# Deduplication

def test_dedupe_exact(spark):
    rows = [(1, "u1", "h1"), (2, "u1", "h2"), (3, "u2", "h1"), (4, "u3", ""), (5, "u4", None)]
    df = spark.createDataFrame([(i, u, h, hours(i)) for i, u, h in rows], "id bigint, url string, hash string, published_at timestamp")
    assert sorted(r.id for r in dd.dedupe_exact(df).collect()) == [1, 4, 5]


@pytest.mark.parametrize("hot_rows", [0, 3, 10_000])
def test_near_first_against_brute_force(spark, hot_rows):
    """Clusters of signatures, spread bits anywhere; the hot path alone, mixed, and the direct path alone."""
    rng = random.Random(5)
    centers = [rng.getrandbits(60) for _ in range(6)]
    sigs = {c ^ sum(1 << b for b in rng.sample(range(60), rng.randint(0, 5))) for c in centers for _ in range(25)}
    rows = [(s, i) for i, s in enumerate(sorted(sigs, key=lambda _: rng.random()))]
    df = spark.createDataFrame(rows, "sig bigint, id bigint").select("sig", F.struct(F.lit(0).alias("published_at"), "id").alias("first"))
    got = {r.sig: r["first"].id for r in dd.near_first(df, hot_rows).collect()}
    want = {s: min(j for o, j in rows if bin(s ^ o).count("1") <= 3) for s, _ in rows}
    assert got == want


def test_near_first_sends_no_side_through_the_driver(spark):
    """Stored keys look small to Spark by their files, and must not be broadcast for that."""
    sigs = spark.range(200).select(F.xxhash64("id").bitwiseAND(F.lit((1 << 60) - 1)).alias("sig"), F.struct(F.lit(0).alias("published_at"), "id").alias("first"))
    plan = dd.near_first(sigs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    articles = spark.range(50).select("id", F.concat(F.lit("title "), "id").alias("title"), F.timestamp_seconds("id").alias("published_at"))
    assert "Broadcast" not in dd.dedupe_simhash(articles)._jdf.queryExecution().executedPlan().toString()


def test_simhash_copies(spark):
    rows = [(1, "Alpha beta gamma delta"), (2, "alpha BETA gamma, delta!"), (3, "something else entirely"), (4, None), (5, "...")]
    df = spark.createDataFrame([(i, t, hours(i)) for i, t in rows], "id bigint, title string, published_at timestamp")
    got = {r.id: (r.simhash, r.dup_of) for r in dd.dedupe_simhash(df).collect()}
    assert got[2][1] == 1 and got[1][1] is None and got[3][1] is None
    assert got[4] == (None, None) and got[5] == (None, None)


# Lookups

def test_find_by(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    assert lk.find_by(df, name=None).count() == 2
    assert lk.find_by(df, id=1, name="x").count() == 1
    with pytest.raises(ValueError):
        lk.find_by(df, nothing=1)


def test_alias_and_active(spark):
    rows = [("AAPL", ["Apple", "AAPL", "Apple Inc"], None, None), ("GOOGL", ["Google", "GOOGL"], None, dt.date(2023, 12, 31)),
            ("ZZZ", None, dt.date(2024, 6, 1), None)]
    tickers = spark.createDataFrame(rows, "symbol string, aliases array<string>, valid_from date, valid_to date")
    asked = spark.createDataFrame([("Apple",), ("apple",)], "alias string")
    assert [tuple(r) for r in lk.find_by_alias(tickers, asked).collect()] == [("Apple", "AAPL")]
    assert sorted(r.symbol for r in lk.active_tickers(tickers).collect()) == ["AAPL", "ZZZ"]
    assert sorted(r.symbol for r in lk.active_tickers(tickers, "2023-12-30").collect()) == ["AAPL", "GOOGL"]
    assert sorted(r.symbol for r in lk.active_tickers(tickers, "2023-12-31").collect()) == ["AAPL"]
    assert lk.alias_map(tickers).count() == 2


def test_nested_articles_and_signals(spark):
    articles = spark.createDataFrame([(1,), (2,)], "id bigint")
    links = spark.createDataFrame([(1, "GOOGL", 0.7, "dict"), (1, "AAPL", 0.9, "cashtag")], "article_id bigint, ticker string, confidence double, method string")
    got = {r.id: [t.ticker for t in r.tickers] for r in lk.articles_with_tickers(articles, links).collect()}
    assert got == {1: ["AAPL", "GOOGL"], 2: []}
    contribs = spark.createDataFrame([(1, 10, None), (1, 11, 2), (1, 12, 1)], "signal_id bigint, article_id bigint, rank int")
    got = {r.id: [c.article_id for c in r.contributions] for r in lk.signals_with_contribs(articles, contribs).collect()}
    assert got == {1: [12, 11, 10], 2: []}


def test_tags_and_page(spark):
    df = spark.createDataFrame(
        [(i, "T", hours(i // 2), ["a", "b"] if i % 2 else ["a"]) for i in range(10)],
        "id bigint, ticker string, ts timestamp, event_tags array<string>",
    )
    assert lk.signals_by_tags(df, ["a", "b"]).count() == 5
    assert lk.signals_by_tags(df, []).count() == 10
    seen, after = [], None
    for _ in range(4):
        page = lk.signals_page(df, after=after, page=3).collect()
        seen += [r.id for r in page]
        after = (page[-1].ts, page[-1].id) if page else after
    assert seen == [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]


def test_recent_embeddings_do_not_multiply(spark):
    embeds = spark.createDataFrame([(1, "m")], "article_id bigint, model string")
    articles = spark.createDataFrame([(1, hours(1))], "id bigint, published_at timestamp")
    links = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C")], "article_id bigint, ticker string")
    assert lk.recent_embeddings_for_ticker(embeds, articles, links, "A", T0).count() == 1


# Prices

BARS = [("AAPL", T0, 150.0, 155.0, 149.0, 153.0, 1000000, "1d"), ("AAPL", hours(24), 153.0, 157.0, 152.0, 156.0, 1200000, "1d")]
BAR_SCHEMA = "ticker string, ts timestamp, o double, h double, l double, c double, v bigint, timeframe string"


def test_price_stats(spark):
    got = st.price_stats(spark.createDataFrame(BARS, BAR_SCHEMA), hours(48)).first()
    assert (got.current_price, got.price_change, got.min_price, got.max_price) == (156.0, 3.0, 153.0, 156.0)
    assert got.price_change_pct == pytest.approx(1.9608, abs=1e-4)
    assert (got.avg_volume, got.total_volume, got.data_points) == (1100000.0, 2200000, 2)
    assert st.price_stats(spark.createDataFrame(BARS, BAR_SCHEMA), T0 - dt.timedelta(days=1)).count() == 0


def test_latest_and_ohlcv(spark):
    bars = spark.createDataFrame(BARS, BAR_SCHEMA)
    assert lk.latest_per_ticker(bars).first().c == 156.0
    assert [r.close for r in lk.ohlcv(bars, "AAPL", T0, hours(24)).collect()] == [153.0, 156.0]
    assert st.roll_up_bars(bars, "1mo", "month").first()[2:7] == (150.0, 157.0, 149.0, 156.0, 2200000)


@pytest.mark.parametrize("chunk", [1800, 7200, 10**9])
def test_next_bar_against_brute_force(spark, chunk):
    rng = random.Random(3)
    minutes = lambda: T0 + dt.timedelta(minutes=30 * rng.randint(0, 60))
    signals = [(i, rng.choice("AAAB"), minutes()) for i in range(150)]
    bars = sorted({(rng.choice("AABC"), minutes()) for _ in range(40)})
    s = spark.createDataFrame(signals, "id int, ticker string, ts timestamp")
    b = spark.createDataFrame([(t, x, float(i)) for i, (t, x) in enumerate(bars)], "ticker string, ts timestamp, c double")
    got = {r.id: r.entry_ts for r in bt.next_bar(s, b, ["c"], chunk_seconds=chunk).collect()}
    want = {i: min((x for t, x in bars if t == k and x > at), default=None) for i, k, at in signals}
    assert got == want


def test_ranks_and_backtest(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"date": np.repeat(["a", "b"], 40), "score": rng.integers(0, 12, 80) / 10, "forward_return": rng.integers(-9, 9, 80) / 100})
    df = spark.createDataFrame(pdf)
    got = bt.cross_rank(df, "date", "score", "r").toPandas()
    assert np.allclose(got["r"], got.groupby("date")["score"].rank())
    ic = {r.date: r.ic for r in bt.information_coefficient(df).collect()}
    for date, part in pdf.groupby("date"):
        assert ic[date] == pytest.approx(part["score"].rank().corr(part["forward_return"].rank()))
    report = bt.backtest_report(df.withColumn("ticker", F.lit("A")), spark.createDataFrame([("A",)], "ticker string")).first()
    assert report.hit_rate == pytest.approx((np.sign(pdf.score) == np.sign(pdf.forward_return)).mean())
    assert report.mean_ic == pytest.approx(sum(ic.values()) / 2)


# Features

def test_velocity_against_dense_series(spark):
    rng = random.Random(9)
    rows = sorted({(t, h): rng.randint(1, 5) for t in "AB" for h in rng.sample(range(120), 30)}.items())
    counts = spark.createDataFrame([(t, hours(h), n) for (t, h), n in rows], "ticker string, hour timestamp, mentions bigint")
    got = {(r.ticker, r.hour): r.velocity for r in ft.velocity(counts, days=2).collect()}
    for ticker in "AB":
        series = {h: n for (t, h), n in rows if t == ticker}
        first = min(series)
        for h, n in series.items():
            back = [series.get(x, 0) for x in range(max(first, h - 48), h)]
            std = np.std(back, ddof=1) if len(back) > 1 else 0
            assert got[ticker, hours(h)] == pytest.approx((n - np.mean(back)) / std if std > 0 else 0.0)


@pytest.mark.parametrize(("block_rows", "pivot_rows"), [(1, 4096), (7, 4096), (4096, 4096), (7, 8), (4096, 3)])
def test_novelty_against_brute_force(spark, block_rows, pivot_rows):
    """Repeated vectors, equal times, a zero vector, a hot ticker, and the exact ends of the look-back."""
    rng = np.random.default_rng(4)
    pool = [v.tolist() for v in rng.normal(size=(12, 4)).round(1)] + [[0.0] * 4]
    rows = []
    for i in range(120):
        rows.append((i, "H" if i % 3 else "C", T0 + dt.timedelta(minutes=int(rng.integers(0, 300)) * 20), pool[rng.integers(0, len(pool))]))
    rows += [(900, "E", T0, pool[0]), (901, "E", hours(24), pool[0]), (902, "E", hours(24) + dt.timedelta(seconds=1), pool[1])]
    df = spark.createDataFrame(rows, "article_id bigint, ticker string, published_at timestamp, embedding array<float>")
    got = {r.article_id: r.novelty for r in ft.novelty(df, 24, block_rows, pivot_rows).collect()}
    assert len(got) == len(rows)

    def cos(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return a @ b / size if size > 0 else None

    for i, t, at, x in rows:
        sims = [cos(x, y) for _, u, when, y in rows if u == t and at - dt.timedelta(hours=24) <= when < at]
        sims = [s for s in sims if s is not None]
        assert got[i] == pytest.approx(1 - max(sims) if sims else 1.0, abs=1e-9), i


def test_novelty_leaves_out_far_cells(spark):
    """On clustered vectors a fifth of all comparisons, and the same similarities."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    vecs = np.repeat(centres, 60, axis=0) + rng.normal(size=(2400, 16)) * 0.05
    minutes = rng.integers(0, 2 * 1440, len(vecs))
    rows = [(i, "H", T0 + dt.timedelta(minutes=int(m)), x.tolist()) for i, (m, x) in enumerate(zip(minutes, vecs, strict=True))]
    df = spark.createDataFrame(rows, "article_id bigint, ticker string, published_at timestamp, embedding array<float>")
    plain = {r.head: r.sim for r in ft.nearest_earlier(df, 24).collect()}
    got = {r.head: r.sim for r in ft.nearest_earlier(df, 24, pivot_rows=100).collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-12 for k in plain)
    groups = stored(ft._vector_groups(df, 24), "groups")
    slots = groups.select("ticker", "slot").distinct()
    _, met = ft.pruned_meetings(groups, slots, 24, 2048)
    sizes = {r.slot: r["count"] for r in groups.groupBy("slot").count().collect()}
    pairs = sum(n * (n + sizes.get(slot - 1, 0)) for slot, n in sizes.items())
    assert met.agg(F.sum("members")).first()[0] <= 0.2 * pairs


def test_sentiment(spark):
    df = spark.createDataFrame([(1, "Profit up", "loss"), (2, None, "...")], "id bigint, title string, text string")
    got = {r.id: r for r in ft.lexicon_sentiment(df).collect()}
    assert got[1].sentiment == pytest.approx(1 / 3) and got[1].prob_neu == pytest.approx(0.0)
    assert (got[2].prob_neu, got[2].sentiment) == (1.0, 0.0)


def test_models_plug_in(spark):
    df = spark.createDataFrame([(1, "t", "good"), (2, "t", "bad")], "id bigint, title string, text string")

    def load_scorer():
        def score(texts):
            pos = (texts == "good").astype(float)
            return pd.DataFrame({"prob_pos": pos, "prob_neg": 1 - pos, "prob_neu": 0.0})
        return score

    got = {r.article_id: r.score for r in ft.model_sentiment(df, load_scorer, "id", "text", "m", "1").collect()}
    assert got == {1: 1.0, 2: -1.0}
    embedded = ft.model_embeddings(df, lambda: lambda texts: np.ones((len(texts), 3)), 10, "m").collect()
    assert all(r.dims == 3 and r.embedding == [1.0, 1.0, 1.0] for r in embedded)
    hashed = ft.hashed_embeddings(df, 8, 10).collect()
    assert all(sum(x * x for x in r.embedding) == pytest.approx(1) for r in hashed)


def test_event_tags(spark):
    rows = [(1, "Q3 earnings beat", "guidance raised", None), (2, "x", "merger", "8-K"), (3, None, None, "10-K")]
    df = spark.createDataFrame(rows, "id int, title string, text string, form string")
    got = {r.id: r.event_tags for r in ft.tag_events(df, form="form").collect()}
    assert got == {1: ["earnings", "guidance"], 2: ["guidance", "mna"], 3: ["earnings"]}


# Scores

@pytest.mark.parametrize(("tags", "want"), [(["earnings", "guidance"], 0.92), (["earnings", "guidance", "earnings"], 0.92), ([], 0.62), (None, 0.62)])
def test_score(spark, tags, want):
    df = spark.createDataFrame([(0.5, 0.4, 1.0, tags)], "sentiment double, novelty double, velocity double, event_tags array<string>")
    assert sc.score(df, ScoreParams()).first().score == pytest.approx(want)


def test_contributors(spark):
    rows = [(i, "A", T0, s, 1.0) for i, s in enumerate([0.1, -0.9, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "article_id bigint, ticker string, ts timestamp, sentiment double, confidence double")
    got = sorted((r["rank"], r.article_id, round(r.weight, 3)) for r in sc.contributors(df, ScoreParams()).collect())
    assert got == [(1, 1, 0.45), (2, 2, 0.25)]


# Similarity

def _vectors(spark, n=200, dims=8):
    m = np.random.default_rng(2).normal(size=(n, dims)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "article_id bigint, embedding array<float>")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    return df, u @ u.T


@pytest.mark.parametrize("block_rows", [16, 100_000])
def test_topk_against_brute_force(spark, block_rows):
    df, sims = _vectors(spark)
    queries = df.filter("article_id < 20").withColumnRenamed("article_id", "query_id")
    got = {}
    for r in sim.similar_topk(df, queries, 5, 0.3, block_rows).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.article_id
    for q in range(20):
        order = [j for j in np.argsort(-sims[q], kind="stable") if j != q and sims[q, j] > 0.3][:5]
        assert [got.get(q, {})[i + 1] for i in range(len(order))] == order


def test_parallel_vectors(spark):
    rows = [(i, [0.1 + 0.1 * i] * 384) for i in range(3)]
    df = spark.createDataFrame(rows, "article_id bigint, embedding array<float>")
    hits = sim.similar_to_vector(df, [0.1] * 384, threshold=0.5).collect()
    assert len(hits) == 3 and all(r.similarity == pytest.approx(1) for r in hits)
    assert {r.article_id for r in sim.similar_to_article(df, 1, threshold=0.5).collect()} == {0, 2}
    assert sim.similar_to_article(df, 77).count() == 0


@pytest.mark.parametrize("lists", [16, 64, 200])
def test_ann_recall_of_the_registered_index(spark, lists):
    """On real tables, with the parameters of the registered query, however many cells there are."""
    embeds = views.embeddings(spark, "/root/testdata/sf0.1")
    queries = embeds.filter("article_id % 5 = 0").select(F.col("article_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.article_id) for r in sim.similar_topk(embeds, queries, 5, 0.3).collect()}
    model = ann.fit_index(embeds, lists, k=5)
    index = stored(ann.index_rows(embeds, model), "index")
    assert len(model.centres) == lists and model.probes < lists and index.count() == embeds.count()
    found = {(r.query_id, r.article_id) for r in ann.ann_topk(index, embeds, queries, model, 5, 0.3).collect()}
    assert len(found & exact) >= 0.9 * len(exact) > 1000


def test_comparisons_take_bounded_memory():
    """Full blocks whose rows are all alike: a task holds a few hundred rows of a matrix at a time."""
    import tracemalloc
    from types import SimpleNamespace

    import pandas as pd

    vecs = np.ones((4096, 8)) / np.sqrt(8)
    model = ann.AnnModel(np.zeros((1024, 8)), (np.zeros((1, 8)),), 4)
    left = pd.DataFrame({"query_id": np.arange(4096), "vec": list(vecs), "cell": 0})
    right = pd.DataFrame({"article_id": np.arange(4096), "cell": 0, "code": [b"\0"] * 4096})
    articles = pd.DataFrame({"article_id": np.arange(4096), "vec": list(vecs)})
    block = SimpleNamespace(value=(np.arange(4096), vecs))
    same = np.ones((4096, 4096), bool)
    steps = {
        "codes": lambda: len(ann._rough_kernel(model, 5)(left, right, same)),
        "exact": lambda: sum(map(len, sim._topk_of_block(block, 5, 0.7)(iter([articles])))),
        "cells": lambda: 5 * len(model.nearest(vecs, 4)),
    }
    for name, run in steps.items():
        tracemalloc.start()
        assert run() == 5 * 4096
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert most < 100, (name, most)
    (found,) = sim._topk_of_block(block, 5, 0.7)(iter([articles.iloc[::-1]]))
    assert found[found["query_id"] == 2]["article_id"].tolist() == [0, 1, 3, 4, 5]


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_ann_with_every_cell_and_code_is_exact(spark, block_rows):
    df, _ = _vectors(spark, 400)
    odd = spark.createDataFrame([(1000, [0.0] * 8), (1001, None)], "article_id bigint, embedding array<float>")
    queries = df.withColumnRenamed("article_id", "query_id")
    exact = {(r.query_id, r.article_id, r["rank"]) for r in sim.similar_topk(df, queries, 5, 0.3).collect()}
    model = ann.fit_index(df, 10, k=5, target=1.0, parts=3)
    model = replace(model, probes=10)
    index = ann.index_rows(df.union(odd), model)
    got = ann.ann_topk(index, df, queries, model, 5, 0.3, keep=400, block_rows=block_rows).collect()
    assert {(r.query_id, r.article_id, r["rank"]) for r in got} == exact
    none = df.limit(0)
    model = ann.fit_index(none, 4)
    assert ann.index_rows(none, model).count() == 0


def test_rough_products_follow_the_codes():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 10))
    centres = ann._kmeans(x, 6)
    left = x - centres[ann._nearest(x, centres)]
    model = ann.AnnModel(centres, tuple(ann._kmeans(s, 64) for s in np.array_split(left, 4, axis=1)), 6)
    cells = model.nearest(x, 1)[:, 0]
    codes = model.codes(x, cells)
    back = centres[cells] + np.hstack([b[codes[:, j]] for j, b in enumerate(model.codebooks)])
    assert np.allclose(model.rough(x[:20], cells, codes), x[:20] @ back.T)
    assert ((x - back) ** 2).sum() < 0.3 * ((x - centres[cells]) ** 2).sum()


# Topics

def test_drifting_topics_keep_their_names(spark):
    """Three topics turn a little every day, one ends, one begins later, and a fifth returns after a break as a new one."""
    rng = np.random.default_rng(8)
    base = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    lives = {0: range(0, 12), 1: range(0, 6), 2: range(4, 12), 3: [*range(0, 3), *range(8, 12)]}
    rows = []
    for topic, days in lives.items():
        for day in days:
            turn = 0.25 * day  # radians: after twelve days it looks nothing like it did
            centre = np.cos(turn) * base[2 * topic] + np.sin(turn) * base[2 * topic + 1]
            for _ in range(30):
                v = centre + rng.normal(size=24) * 0.04
                rows.append((len(rows), topic, day, v.tolist()))
    df = spark.createDataFrame(rows, "article_id bigint, planted int, day int, embedding array<double>")
    stamped = df.withColumn("published_at", F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400 + F.pmod("article_id", F.lit(80000))))
    got = tp.topics(stamped.withColumn("topic", F.lit("x")), per_day=4, least=0.8, sample_rows=25).collect()
    assert len(got) == len(rows)
    names = {}
    for r in got:
        names.setdefault((r.planted, r.day > 5 if r.planted == 3 else None), set()).add(r.topic)
    assert len(names) == 5 and all(len(own) == 1 for own in names.values())
    assert len(set.union(*names.values())) == 5
    firsts = {k: next(iter(own)).split("/")[0] for k, own in names.items()}
    assert firsts == {(0, None): "2024-01-01", (1, None): "2024-01-01", (2, None): "2024-01-05", (3, False): "2024-01-01", (3, True): "2024-01-09"}


def test_topics_without_vectors(spark):
    df = spark.createDataFrame([(1, None, None), (2, [0.0], None)], "article_id bigint, embedding array<double>, published_at timestamp")
    assert tp.topics(df).count() == 0


# Linking

TICKERS = [("AAPL", "Apple", ["Apple", "AAPL", "Apple Inc"]), ("GOOGL", "Google", None), ("A", "Agilent", [])]


def test_linker(spark):
    tickers = spark.createDataFrame(TICKERS, "symbol string, name string, aliases array<string>")
    texts = [(1, "$AAPL up, says Apple Inc. (Apple)"), (2, "Google and apple"), (3, "$NOPE"), (4, None)]
    articles = spark.createDataFrame(texts, "id bigint, text string")
    got = {(r.article_id, r.ticker): r for r in ln.link_tickers(articles, tickers).collect()}
    assert set(got) == {(1, "AAPL"), (2, "GOOGL")}
    best = got[1, "AAPL"]
    assert (best.method, best.confidence, best.matched_terms) == ("cashtag", 0.95, ["$AAPL", "Apple", "Apple Inc"])
    assert got[2, "GOOGL"].method == "synonym"
    spans = ln.cashtag_spans(spark.createDataFrame([(1, "x $AAPL y $AAPL")], "id bigint, text string"), tickers).first()
    assert [(s.start, s.end) for s in spans.char_spans] == [(2, 7), (10, 15)]


@pytest.mark.parametrize("max_heads", [0, 5000])
def test_phrases_begin_at_first_words(spark, max_heads):
    """Terms of one to four words with common first words, against all runs of words."""
    rng = random.Random(11)
    words = ["Big", "Blue", "Sky", "Oil", "Co", "#1", "x"]
    names = {" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4]))) for _ in range(25)}
    tickers = spark.createDataFrame(
        [(f"T{chr(65 + i)}", n, [f"{n} Inc", "Oil"] if i % 3 else None) for i, n in enumerate(sorted(names))],
        "symbol string, name string, aliases array<string>",
    )
    marks = [" ", ", ", " - ", " (", ") "]
    texts = ["".join(w + rng.choice(marks) for w in rng.choices([*words, "Inc", "TA", "$TB", "other"], k=40)) for _ in range(60)] + [None, "", "Oil"]
    articles = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    terms = {(r.term, r.ticker) for r in ln.alias_terms(tickers).collect()}
    import re

    want = set()
    for i, text in enumerate(texts):
        tokens = re.findall(r"[\w$#]\S*[\w#]|[\w#]", text or "")
        runs = {" ".join(tokens[a : a + n]) for n in range(1, 6) for a in range(len(tokens) - n + 1)}
        want |= {(i, ticker, term) for term, ticker in terms if term in runs and not term.startswith("$")}
    got = ln.mentions(articles, tickers, cashtags=False, max_heads=max_heads).select("article_id", "ticker", "term").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 100
    both = ln.mentions(articles, tickers, max_heads=max_heads).filter("method = 'cashtag'").select("article_id").distinct().count()
    assert both == sum("$TB" in (t or "") for t in texts)


@pytest.mark.parametrize("max_heads", [0, 4, 12])
def test_large_dictionary_moves_no_text(spark, max_heads):
    """First words too many for the plan: whatever stands for them, the links are the same and no text is joined with its words."""
    names = ["Big Oil", "Big Blue Sky", "Bigger", "Ball", "Supply Co 1", "Supply", "Zed #1", "$Cash Co"]
    rows = [(f"T{chr(65 + i)}{chr(65 + j)}", f"{n} {j}", [n]) for i, n in enumerate(names) for j in range(3)]
    tickers = spark.createDataFrame(rows, "symbol string, name string, aliases array<string>")
    texts = ["Big Oil 2, Bigger Ball (Big Blue Sky)", "Supply Co 1 2 Zed #1 1 TAA", "$Cash Co 1 Big $TAB Bi B", "", None]
    articles = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    shown = lambda most: sorted(map(tuple, ln.mentions(articles, tickers, max_heads=most).collect()))
    assert shown(max_heads) == shown(5000) and len(shown(5000)) > 10
    rows = ln._phrase_rows(articles, ln.term_heads(ln.alias_terms(tickers)), max_heads)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1


def test_cashtag_boundaries(spark):
    tickers = spark.createDataFrame([("AAPL", "x", None), ("BRK.B", "y", None), ("A", "z", None)], "symbol string, name string, aliases array<string>")
    cases = {
        "buy $AAPL.": {"AAPL"}, "$AAPL-related": {"AAPL"}, "($BRK.B)": {"BRK.B"}, "$BRK.B.": {"BRK.B"}, "costs $.50 or $-5": set(),
        "x$AAPL": set(), "$$AAPL": set(), "$AAPLE": set(), "$AAPLx": set(), "$A, $AAPL!": {"A", "AAPL"}, "$ABCDEFGHIJKLM": set(),
    }
    articles = spark.createDataFrame(list(enumerate(cases)), "id bigint, text string")
    got = ln.link_cashtags(articles, tickers).groupBy("article_id").agg(F.collect_set("ticker").alias("t")).collect()
    found = {r.article_id: set(r.t) for r in got}
    assert {text: found.get(i, set()) for i, text in enumerate(cases)} == cases


def test_spans_of_every_method(spark):
    tickers = spark.createDataFrame(TICKERS, "symbol string, name string, aliases array<string>")
    text = "Apple Inc, $AAPL. Apple pie; Apples. 😀 Apple  Inc"
    articles = spark.createDataFrame([(1, text)], "id bigint, text string")
    row = ln.with_spans(ln.link_tickers(articles, tickers), articles).first()
    assert row.matched_terms == ["$AAPL", "Apple", "Apple Inc"]
    assert [text[s.start : s.end] for s in row.char_spans] == ["Apple Inc", "$AAPL", "Apple", "Apple  Inc"]


def test_linker_precision_on_labelled_documents(spark):
    from tickerloom.sources import views

    sf = "/root/testdata/sf0.001"
    links = ln.link_tickers(views.linker_articles(spark, sf), views.linker_tickers(spark, sf))
    assert ql.linker_precision(links, views.linker_truth(spark, sf)).first().value >= 0.9


def test_no_look_ahead(spark):
    signal = spark.createDataFrame([(1, "A", hours(10))], "id int, ticker string, ts timestamp")
    bars = [("A", hours(10) + dt.timedelta(minutes=m), "1m", float(m)) for m in (1, 30, 59, 60, 61)]
    df = spark.createDataFrame(bars, "ticker string, ts timestamp, timeframe string, c double")
    sound = bt.signal_returns(signal, df, "1m")
    assert sound.first().entry_ts == hours(11) and bt.look_ahead_rows(sound).count() == 0
    early = bt.signal_returns(signal, df, "1m", signal_seconds=0).withColumn("known_at", F.lit(hours(11)))
    assert bt.look_ahead_rows(early).count() == 1


def test_market_sessions(spark):
    utc = lambda *a: dt.datetime(*a)
    cases = {
        utc(2024, 1, 5, 14, 29): False, utc(2024, 1, 5, 14, 30): True, utc(2024, 1, 5, 20, 59): True, utc(2024, 1, 5, 21, 0): False,
        utc(2024, 7, 5, 13, 30): True, utc(2024, 7, 5, 13, 29): False, utc(2024, 7, 5, 20, 0): False,
        utc(2024, 1, 6, 15, 0): False, utc(2024, 1, 7, 15, 0): False, utc(2024, 3, 11, 13, 30): True, utc(2024, 3, 8, 13, 30): False,
    }
    df = spark.createDataFrame([(t,) for t in cases], "ts timestamp")
    got = {r.ts: r.ok for r in df.select("ts", bt.in_session(F.col("ts")).alias("ok")).collect()}
    assert got == cases


def test_tags_without_boost_stay(spark):
    from tickerloom.operators import scoring
    from tickerloom.params import ScoreParams

    rows = [(1, "A", T0, 0.5, ["regulatory", "earnings"]), (2, "A", T0, 0.5, ["earnings"]), (3, "A", T0, 0.5, None)]
    df = spark.createDataFrame(rows, "article_id int, ticker string, ts timestamp, sentiment double, event_tags array<string>")
    assert scoring.assemble_signals(df, None, ScoreParams()).first().event_tags == ["earnings", "regulatory"]


# Maintenance

def test_upsert_is_idempotent(spark):
    url = "https://example.com/test1"
    batch = spark.createDataFrame([(url, "test", 80.0, T0), (url, None, 81.0, hours(1))], "url string, source string, credibility double, published_at timestamp")
    empty = spark.createDataFrame([], "id bigint, url string, url_canonical string, source string, credibility double, published_at timestamp, retrieved_at timestamp")
    once = mt.upsert_articles(empty, batch, hours(2), ["published_at"])
    twice = mt.upsert_articles(once, batch, hours(2), ["published_at"])
    assert once.collect() == twice.collect()
    row = twice.first()
    assert twice.count() == 1 and row.id > 0 and row.source is None and row.credibility == 81.0
    assert row.url_canonical == url and row.retrieved_at == hours(2)


def test_replace_links(spark):
    schema = "article_id bigint, ticker string"
    old = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], schema)
    new = spark.createDataFrame([(1, "D")], schema)
    assert sorted(tuple(r) for r in mt.replace_links(old, new).collect()) == [(1, "D"), (2, "C")]
    assert mt.replace_links(old, new.limit(0)).count() == 3


def test_append(spark):
    old, new = spark.createDataFrame([(1, "o")], "k int, x string"), spark.createDataFrame([(1, "n"), (2, "n")], "k int, x string")
    assert sorted(tuple(r) for r in mt.append(old, new, ["k"], "ignore").collect()) == [(1, "o"), (2, "n")]
    assert sorted(tuple(r) for r in mt.append(old, new, ["k"], "replace").collect()) == [(1, "n"), (2, "n")]
    with pytest.raises(ValueError):
        mt.append(old, new, ["k"])
    assert mt.append(old, new.filter("k = 2"), ["k"]).count() == 2
    twice = spark.createDataFrame([(1, "p"), (2, "b"), (2, "a")], "k int, x string")
    assert sorted(tuple(r) for r in mt.append(old, twice, ["k"], "ignore").collect()) == [(1, "o"), (2, "a")]
    assert sorted(tuple(r) for r in mt.append(old, twice, ["k"], "replace").collect()) == [(1, "p"), (2, "b")]


def test_update_sets_nulls_and_takes_the_last(spark):
    table = spark.createDataFrame([("A", "x", "p"), ("B", "y", "q")], "k string, name string, other string")
    updates = [("A", "n1", None, 1, ["name"]), ("A", "n2", None, 2, ["name"]), ("B", None, None, 1, ["name", "other"])]
    df = spark.createDataFrame(updates, "k string, name string, other string, no int, fields array<string>")
    got = sorted(tuple(r) for r in mt.update_by_key(table, df, "k", ["no"], "fields").collect())
    assert got == [("A", "n2", "p"), ("B", None, None)]


def test_updates_and_aliases(spark):
    tickers = spark.createDataFrame([("A", "x", ["p"]), ("B", "y", None)], "symbol string, name string, aliases array<string>")
    updates = spark.createDataFrame([("A", "new", 1), ("Z", "z", 1)], "symbol string, name string, nothing int")
    assert {r.symbol: r.name for r in mt.update_by_key(tickers, updates, "symbol").collect()} == {"A": "new", "B": "y"}
    edits = spark.createDataFrame([("A", "q", None), ("B", None, "p"), ("Z", "q", None)], "symbol string, add string, remove string")
    got = {r.symbol: (r.aliases, r.changed) for r in mt.edit_aliases(tickers, edits).collect()}
    assert got == {"A": (["p", "q"], True), "B": ([], False), "Z": (None, False)}


def test_cascades_and_retention(spark):
    articles = spark.createDataFrame([(1, hours(0)), (2, hours(5)), (3, None)], "id bigint, published_at timestamp")
    child = spark.createDataFrame([(1,), (1,), (2,)], "article_id bigint")
    kept = mt.delete_old_articles(articles, {"embed": child}, hours(5))
    assert sorted(r.id for r in kept["article"].collect()) == [2, 3] and kept["embed"].count() == 1
    signals = spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, ticker string")
    contribs = spark.createDataFrame([(1, 5), (2, 5)], "signal_id bigint, article_id bigint")
    s, c = mt.delete_signals_cascade(signals, contribs, F.col("ticker") == "A")
    assert (s.count(), c.first().signal_id) == (1, 2)
    assert mt.retain(articles, "published_at", 1, hours(26)).count() == 1


# Quality

def test_quality(spark):
    df = spark.createDataFrame([("u", "en", T0), ("u", "en", T0), ("w", "fr", hours(3)), ("x", "fr", hours(3))], "url string, lang string, published_at timestamp")
    assert ql.duplicate_share(df, "url").first().value == 25.0
    hashes = spark.createDataFrame([("",), ("",), (None,), (None,), ("h",), ("h",)], "hash string")
    assert ql.duplicate_share(hashes, "hash").first().value == pytest.approx(100 / 6)
    assert ql.language_drift(df, hours(1)).first().value == 1.0
    posts = spark.createDataFrame([("a", "T", T0)] * 3 + [("b", "T", T0)], "author string, ticker string, ts timestamp")
    assert [r.author for r in ql.drop_bursts(posts, 2).collect()] == ["b"]
    links = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "article_id bigint, ticker string")
    truth = spark.createDataFrame([(1, "A")], "article_id bigint, ticker string")
    assert ql.linker_precision(links, truth).first().value == 0.5


def test_stability_index(spark):
    df = spark.createDataFrame([(float(i % 100), i >= 1000) for i in range(2000)], "x double, late boolean")
    same = ql.population_stability(df, "x", F.col("late")).agg(F.sum("psi")).first()[0]
    moved = ql.population_stability(df.withColumn("x", F.col("x") + F.when(F.col("late"), 50).otherwise(0)), "x", F.col("late"))
    assert same == pytest.approx(0, abs=1e-9) and moved.agg(F.sum("psi")).first()[0] > 1
