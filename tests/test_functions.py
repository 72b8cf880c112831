"""Literal cases of the scalar functions."""

import html
import random
import re
from urllib.parse import parse_qs, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickerloom.functions import fields as fl
from tickerloom.functions import text as tx
from tickerloom.functions import vectors as vec
from tickerloom.functions.keys import letters, stable_id, ticker_ok


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


URLS = {
    "https://example.com/article?utm_source=google&utm_medium=cpc&param=value": "https://example.com/article?param=value",
    "https://example.com/article#section1": "https://example.com/article",
    "https://example.com/article?utm_source=google#section1": "https://example.com/article",
    "https://e.com/a?b=1&a=&b=2&q=x%20y": "https://e.com/a?b=1&q=x y",
    "https://e.com/a?b": "https://e.com/a",
    "https://e.com/a?": "https://e.com/a",
    "https://e.com/a?q=1=2": "https://e.com/a?q=1=2",
    "https://e.com/a?q=100%": "https://e.com/a?q=100%",
    "https://e.com/a?q=x+y": "https://e.com/a?q=x y",
    "https://E.com/A?UTM_SOURCE=x": "https://E.com/A?UTM_SOURCE=x",
    "HTTPS://e.com/a": "https://e.com/a",
    "https://e.com/a?utm_sourced=1&utm_source=2": "https://e.com/a?utm_sourced=1",
}


def test_canonical_url(spark):
    assert values(spark, URLS, tx.canonical_url) == list(URLS.values())


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.text("ab%2 +", max_size=3), st.text("xy%41&=+", max_size=4)), max_size=5), min_size=60, max_size=60))
def test_query_strings_follow_the_standard_library(spark, queries):
    urls = ["https://h/p?" + "&".join(f"{k}={v}" for k, v in q) for q in queries]
    want = []
    for u in urls:
        got = parse_qs(urlsplit(u).query)
        text = "&".join(f"{k}={v[0]}" for k, v in got.items())
        want.append("https://h/p" + (f"?{text}" if text else ""))
    assert values(spark, urls, tx.canonical_url) == want


TEXTS = {
    "<p>This is <b>bold</b> text</p>": "This is bold text",
    "Apple &amp; Microsoft": "Apple & Microsoft",
    "  Multiple    spaces  ": "Multiple spaces",
    "<p>a.</p><p>b</p>": "a.b",
    "x &lt;b&gt;y": "x y",
    "": None,
    "<br>": None,
    None: None,
    "a  b\x1cc\u0085d": "a b c d",
    "&eacute;&#233;&#xe9;&ampx&notit;": html.unescape("&eacute;&#233;&#xe9;&ampx&notit;"),
    "<a\nhref='x'>y</a>": "y",
    "1 < 2": "1 < 2",
}


def test_clean_text(spark):
    assert values(spark, TEXTS, tx.clean_text) == list(TEXTS.values())


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab<>&;#39 ltamp\n\t  é"), max_size=14), min_size=150, max_size=150))
def test_clean_text_follows_the_standard_library(spark, texts):
    want = [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", html.unescape(t))).strip() or None for t in texts]
    assert values(spark, texts, tx.clean_text) == want


def test_hash(spark):
    rows = [
        ("Test Article", "https://example.com/article"),
        ("Test Article", "https://example.com/different-path"),
        ("Test Article", "https://EXAMPLE.com/x"),
        ("", "https://example.com/article"),
        ("Test", ""),
        (None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, u string")
    h = tx.article_hash(F.col("t"), tx.clean_text(F.col("t")), F.col("u"))
    got = [r.h for r in df.select("i", h.alias("h")).orderBy("i").collect()]
    assert got == ["bf54e4bcffd175641ec701ced933bd029e407c31"] * 3 + [""] * 3


def test_validated_url(spark):
    cases = {
        "https://Example.COM": "https://example.com/",
        "https://Example.COM?q=1": "https://example.com/?q=1",
        "HTTP://user@Example.com:80/Path": "http://user@example.com/Path",
        "https://a.com:8443/x": "https://a.com:8443/x",
        "https://a.com:443/x": "https://a.com/x",
    }
    assert values(spark, cases, tx.validated_url) == list(cases.values())


def test_credibility(spark):
    rows = [
        (0, "sec", "a", "l", "https://x", 100.0),
        (1, "gdelt", None, None, "http://x", 70.0),
        (2, "gdelt", "a", "l", "https://x", 80.0),
        (3, "stocktwits", "", "", "http://x", 40.0),
        (4, "twitter", None, None, "https://x", 37.0),
        (5, "reddit", "a", None, "http://x", 35.0),
        (6, "else", None, None, "http://x", 50.0),
    ]
    df = spark.createDataFrame(rows, "i int, s string, a string, l string, u string, want double")
    c = fl.credibility(*[F.col(x) for x in "salu"])
    assert df.filter(c != F.col("want")).count() == 0


def test_format_timestamp(spark):
    cases = {
        "2023-01-01T12:00:00Z": "2023-01-01T12:00:00+00:00",
        "2023-01-01T12:00:00+02:00": "2023-01-01T12:00:00+02:00",
        "2023-01-01T12:00:00": "2023-01-01T12:00:00",
        "2023-01-01 12:00:00.250000": "2023-01-01T12:00:00.250000",
        "not a time": "not a time",
        "": "",
    }
    assert values(spark, cases, fl.iso_from_text) == list(cases.values())
    assert values(spark, [1672574400.0, 0.5], fl.iso_from_epoch, "double") == [
        "2023-01-01T12:00:00+00:00",
        "1970-01-01T00:00:00.500000+00:00",
    ]


def test_json_object(spark):
    cases = ['{"key": "value", "number": 42}', '{"key": "value", "number": 42', "[1]", "3", "null", "", None]
    got = values(spark, cases, lambda c: fl.json_object(c).isNotNull())
    assert got == [True] + [False] * 6


def test_drop_null_values(spark):
    df = spark.sql("select map('key1', 'value1', 'key2', null, 'key3', 'value3', 'key4', null) m")
    assert df.select(fl.drop_null_values(F.col("m")).alias("m")).first().m == {"key1": "value1", "key3": "value3"}


def test_change_pct(spark):
    df = spark.createDataFrame([(153.0, 156.0), (0.0, 5.0)], "a double, b double")
    got = [r.p for r in df.select(fl.change_pct(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got[0] == pytest.approx(1.9608, abs=1e-4) and got[1] == 0.0


def test_ticker_format(spark):
    good = ["AAPL", "TSLA", "BRK.A", "BRK-B", "A", "A" * 10]
    bad = ["aapl", "invalid", "AAPL!", "AAPL@", "AAPL#", "AAPL$", "A" * 11, "", "A1", "AAPL\n", None]
    assert values(spark, good + bad, ticker_ok) == [True] * len(good) + [False] * len(bad)


def test_letters_and_ids(spark):
    assert values(spark, [0, 15, 149], letters, "bigint") == ["A", "BF", "BEJ"]
    ids = values(spark, ["a", "b"], stable_id)
    assert all(i > 0 for i in ids) and ids == values(spark, ["a", "b"], stable_id)


def test_time_zones(spark):
    got = values(
        spark, ["2024-01-01T12:00:00-05:00", "2024-01-01T12:00:00", "bad"],
        lambda c: F.date_format(fl.as_utc(c), "yyyy-MM-dd HH:mm:ss"),
    )
    assert got == ["2024-01-01 17:00:00", "2024-01-01 12:00:00", None]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(vec.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


def test_listed_values(spark):
    cases = ['{"aliases": ["Apple", "AAPL"]}', '{"aliases": null}', "{}", None]
    assert values(spark, cases, lambda c: fl.listed_values(c, "aliases")) == [["Apple", "AAPL"], [], [], []]


def test_only_references_go_to_python(spark):
    """The text around character references stays in Spark, and the result is Python's."""
    rng = random.Random(3)
    parts = ["&", "&amp;", "&amp", "&#65;", "&#x41", "&#0;", "&#xD800;", "&#99999999;", "&notit;", "&acE;", "&;", ";", "#", " ", "<b>", "é😀", "x" * 40, "\n", "\r", "\f", "&&", "&CounterClockwiseContourIntegral;"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)] + [None, "", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    shown = df.select("id", "text", tx.unescape_html(F.col("text")).alias("plain"))
    for r in shown.collect():
        assert r.plain == (None if r.text is None else html.unescape(r.text)), r.text
    sent = [line for line in shown._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in line]
    assert sent and all("regexp_extract_all" in line for line in sent)
