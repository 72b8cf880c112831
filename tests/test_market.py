"""The market calendar, validity intervals, stored sketches, rings and graphs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.functions.graph import components
from tickerloom.operators import market as mk
from tickerloom.operators import quality as ql
from tickerloom.operators.validity import apply_intervals

D = dt.date


def test_holidays_by_rule():
    """Published closing days of the market."""
    assert mk.market_holidays(2024) == {
        D(2024, 1, 1), D(2024, 1, 15), D(2024, 2, 19), D(2024, 3, 29), D(2024, 5, 27), D(2024, 6, 19), D(2024, 7, 4),
        D(2024, 9, 2), D(2024, 11, 28), D(2024, 12, 25),
    }
    assert mk.half_days(2024) == {D(2024, 7, 3), D(2024, 11, 29), D(2024, 12, 24)}
    assert {D(2021, 7, 5), D(2021, 12, 24), D(2021, 4, 2)} <= mk.market_holidays(2021) and D(2021, 6, 18) not in mk.market_holidays(2021)
    assert D(2021, 12, 31) not in mk.market_holidays(2021) | mk.market_holidays(2022) and D(2023, 1, 2) in mk.market_holidays(2023)
    assert mk.half_days(2021) == {D(2021, 11, 26)} and mk._easter(2000) == D(2000, 4, 23) and mk._easter(2038) == D(2038, 4, 25)


def _bars(spark, times):
    rows = [("A", t, 100.0 + i, "1m") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, c double, timeframe string")


def test_returns_in_sessions(spark):
    """Around Thanksgiving 2024: a holiday, a half day, a weekend, and a session without a bar of the ticker."""
    calendar = mk.sessions(spark, D(2024, 11, 25), D(2024, 12, 6), early={D(2024, 12, 5)})
    got = {r.session: (r.ordinal, r.opens, r.closes) for r in calendar.collect()}
    assert D(2024, 11, 28) not in got and got[D(2024, 11, 27)][0] + 1 == got[D(2024, 11, 29)][0]
    assert got[D(2024, 11, 29)][2] == dt.datetime(2024, 11, 29, 18) and got[D(2024, 12, 5)][2] == dt.datetime(2024, 12, 5, 18)
    at = lambda d, h, m=0: dt.datetime(2024, *d, h, m)
    times = [
        at((11, 27), 15), at((11, 27), 20, 59), at((11, 28), 15),  # the holiday
        at((11, 29), 15), at((11, 29), 17, 59), at((11, 29), 18),  # after the early close
        at((11, 30), 15), at((12, 3), 20, 59), at((12, 3), 21),
    ]
    bars = _bars(spark, times)
    inside = [times.index(r.ts) for r in mk.in_sessions(bars, calendar).orderBy("ts").collect()]
    assert inside == [0, 1, 3, 4, 7]
    signals = spark.createDataFrame([(1, "A", at((11, 27), 13)), (2, "A", at((11, 28), 10)), (3, "A", at((11, 29), 17)), (4, "A", at((12, 4), 1))], "id int, ticker string, ts timestamp")
    rows = {r.id: r for r in mk.session_returns(signals, bars, calendar, 1).collect()}
    assert rows[1].entry_ts == times[0] and rows[1].session_return == pytest.approx(104 / 100 - 1)
    assert rows[2].entry_ts == times[3] and rows[2].entry_session == D(2024, 11, 29)
    # The next market session, Monday, has no bar of this ticker.
    assert rows[2].session_return is None and rows[3].entry_ts == times[7] and rows[4].entry_ts is None
    assert {r.id: r.session_return for r in mk.session_returns(signals, bars, calendar, 2).collect()}[2] == pytest.approx(107 / 103 - 1)


def test_intervals_against_days(spark):
    rng = random.Random(5)
    start = D(2024, 1, 1)
    day = lambda n: start + dt.timedelta(days=n)
    old, updates = [], []
    for k in range(40):
        cuts = sorted(rng.sample(range(60), 4))
        old += [(f"k{k}", rng.choice("ab"), None if rng.random() < 0.2 else day(cuts[0]), day(cuts[1])), (f"k{k}", rng.choice("ab"), day(cuts[2]), day(cuts[3]) if k % 3 else None)]
        for n in range(rng.randrange(6)):
            a, b = rng.randrange(60), rng.randrange(60)
            updates.append((f"k{rng.randrange(44)}", rng.choice(["a", "b", "c", None]), day(a), None if rng.random() < 0.2 else day(b), 1000 * k + n))
    schema = "symbol string, exchange string, valid_from date, valid_to date"
    got = apply_intervals(spark.createDataFrame(old, schema), spark.createDataFrame(updates, schema + ", no int"), "symbol", ["exchange"], "no").collect()

    def covers(a, b, d):
        return (a is None or a <= d) and (b is None or b > d)

    for key in {r[0] for r in old + updates}:
        own = sorted((r for r in got if r.symbol == key), key=lambda r: r.valid_from or D.min)
        for a, b in zip(own, own[1:], strict=False):
            assert a.valid_to <= b.valid_from and (a.valid_to < b.valid_from or a.exchange != b.exchange)
        for n in range(-3, 65):
            d = day(n)
            rows = [(0, 0, r[2] or D.min, r[1]) for r in old if r[0] == key and covers(r[2], r[3], d)]
            rows += [(1, r[4], r[2], r[1]) for r in updates if r[0] == key and covers(r[2], r[3], d)]
            want = max(rows, key=lambda r: r[:3])[3] if rows else None
            assert [r.exchange for r in own if covers(r.valid_from, r.valid_to, d)] == ([want] if want else [])


def test_drift_from_day_sketches(spark):
    """Any two periods from the days' sketches, within 0.01 of the index over all rows."""
    day = F.pmod("id", F.lit(8))
    value = F.randn(3) + F.when(day >= 5, 0.6).otherwise(0.0)
    ts = F.timestamp_seconds(F.lit(1704067200) + day * 86400)
    rows = spark.range(80_000).select(value.alias("x"), ts.alias("ts"))
    days = ql.day_sketches(rows.unionByName(spark.createDataFrame([(None, dt.datetime(2024, 1, 1))], "x double, ts timestamp")), "x")
    assert days.count() == 8
    for split in ("2024-01-04", "2024-01-06"):
        got = ql.stability_of_sketches(ql.period_sketch(days, end=split), ql.period_sketch(days, start=split))
        exact = ql.population_stability(rows, "x", F.col("ts") >= F.lit(split).cast("timestamp"), 10, 100000)
        a, b = (df.agg(F.sum("psi")).first()[0] for df in (got, exact))
        assert abs(a - b) < 0.01 < a and got.count() == 10
        assert got.agg(F.sum("late")).first()[0] == pytest.approx(1)
    none = ql.period_sketch(days, start="2030-01-01")
    assert ql.stability_of_sketches(none, none).count() == 0


def test_planted_ring(spark):
    """Authors who never post more than twice an hour, tied by texts that pairs of them share; others repeat alone or later."""
    start = dt.datetime(2024, 1, 1)
    at = lambda h, m=0: start + dt.timedelta(hours=h, minutes=m)
    posts = [("r1", "one", at(1)), ("r2", "one", at(1, 50)), ("r3", "one", at(2, 40)), ("r3", "two", at(30)), ("r4", "two", at(30, 10))]
    posts += [("solo", "mine", at(h)) for h in range(5)] + [("late", "one", at(9)), ("p", "pair", at(3)), ("q", "pair", at(3))]
    posts += [(None, "one", at(1)), ("r1", None, at(1)), ("r1", "x", None)] + [(f"h{i}", "hot", at(50)) for i in range(300)]
    df = spark.createDataFrame(posts, "author string, text string, ts timestamp")
    assert ql.drop_bursts(df.withColumn("ticker", F.lit("A")).filter("author like 'r%'"), 2).count() == 7
    got = {r.author: (r.ring, r.authors, r.texts) for r in ql.coordinated_groups(df, "text").collect()}
    assert got == {a: ("r1", 4, 2) for a in ("r1", "r2", "r3", "r4")}
    wide = {r.author: (r.ring, r.authors) for r in ql.coordinated_groups(df, "text", least_authors=2, least_texts=1).collect()}
    assert len(wide) == 4 + 2 + 300 and wide["q"] == ("p", 2) and wide["h7"] == ("h0", 300)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges for n in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
