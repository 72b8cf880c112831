"""Literal cases of the row validators."""

from pyspark.sql import functions as F

from tickerloom.operators import validate as vd


def errors(checked):
    return [r.errors for r in checked.orderBy("i").select("errors").collect()]


def test_raw_items(spark):
    good = ("gdelt", "https://e.com/a", "t" * 512, "x" * 20000, "EN")
    rows = [
        good,
        ("invalid_source", *good[1:]),
        (good[0], "no url", *good[2:]),
        (*good[:2], "t" * 513, *good[3:]),
        (*good[:3], "x" * 20001, good[4]),
        (*good[:4], "e"),
        (*good[:4], "too-long"),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source string, url string, title string, text string, lang string")
    df = df.withColumn("published_at", F.lit("2024-01-01").cast("timestamp")).withColumn("retrieved_at", F.col("published_at"))
    checked = vd.check_raw_items(df)
    assert errors(checked) == [
        [], ["source"], ["url"], ["title"], ["text"], ["lang"], ["lang"], ["source", "url", "title", "text", "lang"]
    ]
    assert vd.valid_rows(checked).select("lang").first().lang == "en"
    assert vd.quarantined_rows(checked).count() == 7


def test_links(spark):
    rows = [(0, 1, "AAPL", 0.85, "dict"), (1, 1, "aapl", 1.5, "other"), (2, 1, "A", None, None), (3, None, "A", 0.1, "ner")]
    df = spark.createDataFrame(rows, "i int, article_id bigint, ticker string, confidence double, method string")
    df = df.withColumn("matched_terms", F.array(F.lit("x")))
    assert errors(vd.check_links(df)) == [[], ["ticker", "confidence", "method"], [], ["article_id"]]
    assert errors(vd.check_links(df, linker_output=True))[2] == ["confidence", "method"]


def test_sentiment(spark):
    rows = [(0, 0.7, 0.2, 0.1), (1, 0.333, 0.333, 0.333), (2, 1.5, 0.0, 0.0), (3, 0.8, 0.3, 0.1)]
    df = spark.createDataFrame(rows, "i int, prob_pos double, prob_neg double, prob_neu double")
    assert errors(vd.check_sentiment(df)) == [[], [], ["prob_pos", "prob_sum"], ["prob_sum"]]


def test_embeddings(spark):
    df = spark.createDataFrame([(0, 384, 384), (1, 100, 384), (2, 384, 512)], "i int, n int, dims int")
    df = df.withColumn("embedding", F.array_repeat(F.lit(0.1), F.col("n")))
    assert errors(vd.check_embeddings(df)) == [[], ["length", "dims"], ["dims"]]


def test_bars(spark):
    rows = [(0, "AAPL", 150.0, 1000000, "1d"), (1, "AAPL", -150.0, -1000, "1d"), (2, "AAPL", None, None, "5m")]
    df = spark.createDataFrame(rows, "i int, ticker string, o double, v bigint, timeframe string")
    df = df.withColumn("ts", F.current_timestamp()).withColumns({c: F.lit(1.0) for c in "hlc"})
    assert errors(vd.check_bars(df)) == [[], ["o", "v"], ["timeframe"]]


def test_signals_and_contribs(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1, 2, 3]), (2, None)], "i int, contributors array<bigint>")
    df = df.withColumn("ticker", F.lit("A")).withColumn("ts", F.current_timestamp()).withColumn("event_tags", F.lit(None).cast("array<string>"))
    checked = vd.check_signals(df)
    assert errors(checked) == [[], ["contributors"], []]
    assert checked.first().event_tags == []
    ranks = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 1, 0), (2, 1, 1, None)], "i int, signal_id bigint, article_id bigint, rank int")
    assert errors(vd.check_contribs(ranks)) == [[], ["rank"], []]


def test_articles(spark):
    df = spark.createDataFrame([(0, 50.0), (1, 75.5), (2, 150.0), (3, None)], "i int, credibility double")
    df = df.withColumn("source", F.lit("s")).withColumn("url", F.lit("u")).withColumn("published_at", F.current_timestamp())
    assert errors(vd.check_articles(df)) == [[], [], ["credibility"], []]


def test_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r.k for r in vd.orphans(child, parent, "k", "id").collect()] == [2]
    twice = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "x string, y int")
    assert [tuple(r) for r in vd.duplicate_keys(twice, ["x", "y"]).collect()] == [("a", 1, 2)]
