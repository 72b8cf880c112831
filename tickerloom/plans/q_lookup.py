"""Lookups, joins and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import lookup as lk
from tickerloom.operators import stats as st
from tickerloom.plans.frames import contribs, joined_text, rounded, signal_rows, signals
from tickerloom.plans.registry import query
from tickerloom.sources import views as v

_ART = ["id", "source", "url", "published_at", "lang"]
_ART_SQL = "id, source, url, published_at, lang"
_SIG_SQL = (
    "id, ticker, ts, round(sentiment, 6) AS sentiment, round(novelty, 6) AS novelty, round(velocity, 6) AS velocity,"
    " score, event_tags"
)


def _signal_query(sql: str) -> str:
    return f"SELECT {_SIG_SQL} FROM v_signal {sql}"


@query("full_scan", "SELECT symbol, name FROM v_ticker")
def full_scan(spark, sf):
    """All rows of a table; without a limit, or with 0, none is left out."""
    return lk.scan(v.tickers(spark, sf).select("symbol", "name"))


@query("recent_articles", f"SELECT {_ART_SQL} FROM v_article ORDER BY published_at DESC, id LIMIT 100")
def recent_articles(spark, sf):
    return lk.recent_articles(v.articles(spark, sf).select(*_ART), 100)


@query(
    "articles_by_source",
    f"SELECT {_ART_SQL} FROM v_article WHERE source = 'sec' ORDER BY published_at DESC, id LIMIT 100",
)
def articles_by_source(spark, sf):
    return lk.articles_by_source(v.articles(spark, sf).select(*_ART), "sec")


@query(
    "articles_by_range",
    f"""SELECT {_ART_SQL} FROM v_article WHERE published_at BETWEEN TIMESTAMP '2024-01-01 02:00:00'
    AND TIMESTAMP '2024-01-01 03:00:00' ORDER BY published_at DESC, id LIMIT 100""",
)
def articles_by_range(spark, sf):
    return lk.articles_by_range(v.articles(spark, sf).select(*_ART), "2024-01-01 02:00:00", "2024-01-01 03:00:00")


@query(
    "article_by_url",
    f"SELECT {_ART_SQL} FROM v_article WHERE url = (SELECT url FROM v_article ORDER BY published_at, id LIMIT 1)",
)
def article_by_url(spark, sf):
    """The address looked up is that of the oldest article."""
    articles = v.articles(spark, sf).select(*_ART)
    oldest = articles.orderBy("published_at", "id").limit(1).select("url").scalar()
    return articles.filter(F.col("url") == oldest)


@query(
    "articles_by_ticker",
    f"""SELECT {_ART_SQL} FROM v_article WHERE id IN (SELECT article_id FROM v_mention WHERE ticker = 'BC')
    ORDER BY published_at DESC, id LIMIT 100""",
)
def articles_by_ticker(spark, sf):
    return lk.articles_by_ticker(v.articles(spark, sf).select(*_ART), v.links(spark, sf), "BC")


@query(
    "article_with_tickers",
    """SELECT a.id, a.source, coalesce(string_agg(m.ticker || ':' || coalesce(m.method, ''), ',' ORDER BY m.ticker), '')
    AS tickers FROM v_article a LEFT JOIN v_mention m ON m.article_id = a.id GROUP BY a.id, a.source""",
)
def article_with_tickers(spark, sf):
    nested = lk.articles_with_tickers(v.articles(spark, sf).select("id", "source"), v.links(spark, sf))
    shown = F.transform("tickers", lambda t: F.concat(t["ticker"], F.lit(":"), F.coalesce(t["method"], F.lit(""))))
    return nested.withColumn("tickers", F.array_join(shown, ","))


@query(
    "lookup_keys",
    """SELECT d.doc_id, (e.vec_id IS NOT NULL) AS present FROM documents d LEFT JOIN embeddings e
    ON e.vec_id = d.doc_id""",
)
def lookup_keys(spark, sf):
    """Which articles have a stored vector."""
    keys = v.table(spark, sf, "documents").select("doc_id")
    return lk.exists_flags(keys, v.embeddings(spark, sf).select(F.col("article_id").alias("doc_id")), "doc_id")


@query(
    "lookup_rows",
    f"SELECT {_ART_SQL} FROM v_article WHERE id IN (SELECT article_id FROM v_embed)",
)
def lookup_rows(spark, sf):
    keys = v.embeddings(spark, sf).select(F.col("article_id").alias("id"))
    return lk.by_keys(v.articles(spark, sf).select(*_ART), keys, "id")


@query("find_by", f"SELECT {_ART_SQL} FROM v_article WHERE source = 'gdelt' AND lang = 'en'")
def find_by(spark, sf):
    return lk.find_by(v.articles(spark, sf).select(*_ART), source="gdelt", lang="en", url=None)


@query("find_one_by", f"SELECT {_ART_SQL} FROM v_article WHERE source = 'gdelt' AND lang = 'fr' ORDER BY id LIMIT 1")
def find_one_by(spark, sf):
    return lk.find_by(v.articles(spark, sf).select(*_ART), limit=1, order_by="id", source="gdelt", lang="fr")


@query("tickers_by_exchange", "SELECT symbol, name, exchange, cik FROM v_ticker WHERE exchange = 'NATION_3'")
def tickers_by_exchange(spark, sf):
    return lk.find_by(v.tickers(spark, sf), exchange="NATION_3").select("symbol", "name", "exchange", "cik")


@query("ticker_by_symbol", "SELECT symbol, name, exchange, cik FROM v_ticker WHERE symbol = 'H'")
def ticker_by_symbol(spark, sf):
    return lk.find_by(v.tickers(spark, sf), symbol="H").select("symbol", "name", "exchange", "cik")


@query("ticker_by_cik", "SELECT symbol, name, exchange, cik FROM v_ticker WHERE cik = '0000000007'")
def ticker_by_cik(spark, sf):
    return lk.find_by(v.tickers(spark, sf), cik="0000000007").select("symbol", "name", "exchange", "cik")


@query(
    "embed_by_article",
    """SELECT article_id, model, CAST(dims AS BIGINT) AS dims FROM v_embed
    WHERE article_id = (SELECT min(article_id) FROM v_embed)""",
)
def embed_by_article(spark, sf):
    embeds = v.embeddings(spark, sf)
    first = embeds.agg(F.min("article_id")).scalar()
    return embeds.filter(F.col("article_id") == first).select("article_id", "model", F.col("dims").cast("bigint"))


@query(
    "embeds_by_model",
    """SELECT article_id, model, CAST(dims AS BIGINT) AS dims FROM v_embed WHERE model = 'minilm'
    ORDER BY article_id LIMIT 100""",
)
def embeds_by_model(spark, sf):
    found = lk.embeddings_by_model(v.embeddings(spark, sf), "minilm")
    return found.select("article_id", "model", F.col("dims").cast("bigint"))


@query(
    "recent_embeds_for_ticker",
    """SELECT e.article_id, e.model, a.published_at FROM v_embed e JOIN v_article a ON a.id = e.article_id
    WHERE a.published_at >= TIMESTAMP '2024-01-01 01:00:00'
    AND EXISTS (SELECT 1 FROM v_mention m WHERE m.article_id = e.article_id AND m.ticker = 'BC')
    ORDER BY a.published_at DESC, e.article_id LIMIT 100""",
)
def recent_embeds_for_ticker(spark, sf):
    embeds = v.embeddings(spark, sf).select("article_id", "model")
    return lk.recent_embeddings_for_ticker(
        embeds, v.articles(spark, sf), v.links(spark, sf), "BC", "2024-01-01 01:00:00"
    )


@query("bars_by_ticker", "SELECT * FROM v_bar WHERE ticker = 'BA' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, timeframe LIMIT 1000")
def bars_by_ticker(spark, sf):
    return lk.bars_by_ticker(v.all_bars(spark, sf), "BA", start="2024-01-05 00:00:00")


@query("bars_by_timeframe", "SELECT * FROM v_bar1d WHERE ticker = 'BA' ORDER BY ts DESC LIMIT 1000")
def bars_by_timeframe(spark, sf):
    return lk.bars_by_timeframe(v.all_bars(spark, sf), "BA", "1d")


@query(
    "bars_by_range",
    """SELECT * FROM v_bar1h WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06'
    AND ticker IN ('BA', 'BB', 'C') ORDER BY ts DESC, ticker LIMIT 10000""",
)
def bars_by_range(spark, sf):
    return lk.bars_by_range(
        v.all_bars(spark, sf), "2024-01-03 00:00:00", "2024-01-06 00:00:00", ["BA", "BB", "C"], "1h"
    )


@query(
    "ohlcv",
    """SELECT ts AS timestamp, o AS open, h AS high, l AS low, c AS close, v AS volume FROM v_bar1d
    WHERE ticker = 'BA' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""",
)
def ohlcv(spark, sf):
    return lk.ohlcv(v.all_bars(spark, sf), "BA", "2024-01-03 00:00:00", "2024-01-20 00:00:00")


@query(
    "latest_bar",
    "SELECT * FROM v_bar QUALIFY row_number() OVER (PARTITION BY ticker, timeframe ORDER BY ts DESC) = 1",
)
def latest_bar(spark, sf):
    return lk.latest_per_ticker(v.all_bars(spark, sf), ["ticker", "timeframe"])


@query("tickers_with_data", "SELECT DISTINCT ticker FROM v_bar1h")
def tickers_with_data(spark, sf):
    return lk.tickers_with_data(v.all_bars(spark, sf), "1h")


@query("signals_by_ticker", _signal_query("WHERE ticker = 'BA' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, id LIMIT 100"))
def signals_by_ticker(spark, sf):
    return signal_rows(lk.signals_by_ticker(signals(spark, sf), "BA", end="2024-01-20 00:00:00"))


@query(
    "signals_by_range",
    _signal_query(
        "WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04' AND ticker IN ('B', 'BA', 'C', 'D')"
        " ORDER BY ts DESC, id LIMIT 1000"
    ),
)
def signals_by_range(spark, sf):
    found = lk.signals_by_range(signals(spark, sf), "2024-01-02 00:00:00", "2024-01-04 00:00:00", ["B", "BA", "C", "D"])
    return signal_rows(found)


@query("signals_by_score", _signal_query("WHERE score >= 1.0 ORDER BY score DESC, id LIMIT 100"))
def signals_by_score(spark, sf):
    return signal_rows(lk.signals_by_score(signals(spark, sf), 1.0))


@query("signals_by_tags", _signal_query("WHERE contains(event_tags, 'earnings') AND contains(event_tags, 'mna') ORDER BY ts DESC, id LIMIT 100"))
def signals_by_tags(spark, sf):
    return signal_rows(lk.signals_by_tags(signals(spark, sf), ["earnings", "mna"]))


@query(
    "signals_page",
    _signal_query(
        "WHERE ts >= TIMESTAMP '2024-01-05' AND (ts < TIMESTAMP '2024-01-20 12:00:00' OR (ts = TIMESTAMP"
        " '2024-01-20 12:00:00' AND id < 600000000000000000)) ORDER BY ts DESC, id DESC LIMIT 100"
    ),
)
def signals_page(spark, sf):
    after = ("2024-01-20 12:00:00", 600000000000000000)
    return signal_rows(lk.signals_page(signals(spark, sf), start="2024-01-05 00:00:00", after=after))


@query("latest_signal", _signal_query("QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1"))
def latest_signal(spark, sf):
    return signal_rows(lk.latest_per_ticker(signals(spark, sf)))


@query(
    "signal_with_contribs",
    """SELECT s.id, s.ticker, s.ts, coalesce(string_agg(c.rank || ':' || c.article_id, ',' ORDER BY c.rank, c.article_id), '')
    AS contributions FROM v_signal s LEFT JOIN v_contrib c ON c.signal_id = s.id GROUP BY s.id, s.ticker, s.ts""",
)
def signal_with_contribs(spark, sf):
    nested = lk.signals_with_contribs(signals(spark, sf).select("id", "ticker", "ts"), contribs(spark, sf))
    shown = F.transform("contributions", lambda c: F.concat_ws(":", c["rank"], c["article_id"]))
    return nested.withColumn("contributions", F.array_join(shown, ","))


@query(
    "rising_fresh",
    """SELECT id, ticker, ts, coalesce(velocity >= 2.0, false) AS rising, coalesce(novelty >= 0.6, false) AS fresh
    FROM v_signal""",
)
def rising_fresh(spark, sf):
    return lk.with_flags(signals(spark, sf), 2.0, 0.6).select("id", "ticker", "ts", "rising", "fresh")


@query(
    "universe_filter",
    """SELECT id, ticker, ts, score FROM v_signal WHERE ticker IN
    (SELECT symbol FROM v_ticker WHERE exchange IN ('NATION_1', 'NATION_2', 'NATION_3'))""",
)
def universe_filter(spark, sf):
    """Signals of the tickers listed on three exchanges."""
    listed = v.tickers(spark, sf).filter(F.col("exchange").isin("NATION_1", "NATION_2", "NATION_3"))
    found = lk.restrict_universe(signals(spark, sf), listed.select(F.col("symbol").alias("ticker")))
    return found.select("id", "ticker", "ts", "score")


@query("active_tickers", "SELECT symbol, valid_from, valid_to FROM v_ticker WHERE valid_to IS NULL")
def active_tickers(spark, sf):
    return lk.active_tickers(v.tickers(spark, sf)).select("symbol", "valid_from", "valid_to")


@query(
    "active_tickers_asof",
    """SELECT symbol, valid_from, valid_to FROM v_ticker WHERE (valid_from IS NULL OR valid_from <= DATE '2023-12-15')
    AND (valid_to IS NULL OR valid_to > DATE '2023-12-15')""",
)
def active_tickers_asof(spark, sf):
    return lk.active_tickers(v.tickers(spark, sf), "2023-12-15").select("symbol", "valid_from", "valid_to")


@query(
    "ticker_dim_pit",
    """SELECT m.article_id, m.ticker, m.ts, t.exchange FROM v_mention m JOIN v_ticker t ON t.symbol = m.ticker
    AND (t.valid_from IS NULL OR t.valid_from <= CAST(m.ts AS DATE)) AND (t.valid_to IS NULL OR t.valid_to > CAST(m.ts AS DATE))""",
)
def ticker_dim_pit(spark, sf):
    dim = v.tickers(spark, sf).select("symbol", "exchange", "valid_from", "valid_to")
    facts = v.mentions(spark, sf).select("article_id", "ticker", "ts")
    return lk.tickers_point_in_time(facts, dim).select("article_id", "ticker", "ts", "exchange")


@query(
    "find_by_alias",
    """SELECT alias, min(symbol) AS symbol FROM (SELECT symbol, unnest(aliases) AS alias FROM v_ticker)
    WHERE alias IN (SELECT s_name FROM supplier) GROUP BY alias""",
)
def find_by_alias(spark, sf):
    names = v.table(spark, sf, "supplier").select(F.col("s_name").alias("alias"))
    return lk.find_by_alias(v.tickers(spark, sf), names)


@query(
    "alias_map",
    "SELECT symbol, array_to_string(aliases, ',') AS aliases FROM v_ticker WHERE aliases IS NOT NULL",
)
def alias_map(spark, sf):
    return joined_text(lk.alias_map(v.tickers(spark, sf)), "aliases")


@query(
    "row_counts",
    """SELECT 'article' AS table_name, count(*) AS row_count FROM v_article UNION ALL
    SELECT 'article_ticker', count(*) FROM v_mention UNION ALL SELECT 'article_embed', count(*) FROM v_embed UNION ALL
    SELECT 'price_bar', count(*) FROM v_bar UNION ALL SELECT 'ticker', count(*) FROM v_ticker""",
)
def row_counts(spark, sf):
    tables = {
        "article": v.articles(spark, sf),
        "article_ticker": v.links(spark, sf),
        "article_embed": v.embeddings(spark, sf),
        "price_bar": v.all_bars(spark, sf),
        "ticker": v.tickers(spark, sf),
    }
    return st.row_counts(tables)


def _count_by_sql(view: str, col: str, where: str = "") -> str:
    return (
        f"SELECT 'total' AS metric, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM {view} UNION ALL"
        f" SELECT '{col}', {col}, count(*) FROM {view} {where} GROUP BY {col}"
    )


@query("article_stats", _count_by_sql("v_article", "source"))
def article_stats(spark, sf):
    return st.count_by(v.articles(spark, sf), "source")


@query("embedding_stats", _count_by_sql("v_embed", "model"))
def embedding_stats(spark, sf):
    return st.count_by(v.embeddings(spark, sf), "model")


@query("ticker_stats", _count_by_sql("v_ticker", "exchange", "WHERE exchange IS NOT NULL"))
def ticker_stats(spark, sf):
    return st.count_by(v.tickers(spark, sf), "exchange", null_in_total_only=True)


@query(
    "data_coverage",
    """SELECT 'all' AS timeframe, count(*) AS bars, count(DISTINCT ticker) AS tickers FROM v_bar UNION ALL
    SELECT timeframe, count(*), count(DISTINCT ticker) FROM v_bar GROUP BY timeframe""",
)
def data_coverage(spark, sf):
    return st.data_coverage(v.all_bars(spark, sf))


@query(
    "signal_stats",
    """SELECT count(*) AS total, round(avg(sentiment), 6) AS avg_sentiment, round(avg(novelty), 6) AS avg_novelty,
    round(avg(velocity), 6) AS avg_velocity FROM v_signal""",
)
def signal_stats(spark, sf):
    return rounded(st.signal_stats(signals(spark, sf)), "avg_sentiment", "avg_novelty", "avg_velocity")


@query(
    "signal_stats_ticker",
    """SELECT count(*) AS total, round(avg(sentiment), 6) AS avg_sentiment, round(avg(novelty), 6) AS avg_novelty,
    round(avg(velocity), 6) AS avg_velocity FROM v_signal WHERE ticker = 'B'""",
)
def signal_stats_ticker(spark, sf):
    return rounded(st.signal_stats(signals(spark, sf), "B"), "avg_sentiment", "avg_novelty", "avg_velocity")


@query(
    "price_stats",
    """SELECT ticker, last_c AS current_price, round(last_c - first_c, 6) AS price_change,
      round(CASE WHEN first_c = 0 THEN 0 ELSE (last_c - first_c) / first_c * 100 END, 6) AS price_change_pct,
      min_price, max_price, round(avg_volume, 6) AS avg_volume, total_volume, data_points
    FROM (SELECT ticker, first(c ORDER BY ts) AS first_c, last(c ORDER BY ts) AS last_c, min(c) AS min_price,
        max(c) AS max_price, avg(v) AS avg_volume, CAST(sum(v) AS BIGINT) AS total_volume, count(*) AS data_points
      FROM v_bar1d WHERE ts BETWEEN TIMESTAMP '2024-01-25' - INTERVAL 20 DAY AND TIMESTAMP '2024-01-25'
      GROUP BY ticker)""",
)
def price_stats(spark, sf):
    out = st.price_stats(v.all_bars(spark, sf), "2024-01-25 00:00:00", "1d", 20)
    return rounded(out, "price_change", "price_change_pct", "avg_volume")


@query(
    "tickers_with_articles",
    """SELECT t.symbol, t.name, c.article_count FROM v_ticker t JOIN (SELECT ticker, count(*) AS article_count
    FROM v_mention GROUP BY ticker) c ON c.ticker = t.symbol ORDER BY c.article_count DESC, t.symbol LIMIT 100""",
)
def tickers_with_articles(spark, sf):
    out = st.tickers_with_articles(v.tickers(spark, sf), v.links(spark, sf))
    return out.select("symbol", "name", "article_count")


@query(
    "bar_rollup",
    "SELECT ticker, ts, o, h, l, c, v, timeframe FROM v_bar1d",
)
def bar_rollup(spark, sf):
    """Hourly bars to daily ones; the check builds the daily bars from the ticks."""
    return st.roll_up_bars(v.bars(spark, sf, "1h"), "1d", "day")


@query(
    "score_heatmap",
    """SELECT ticker, date_trunc('day', ts)::TIMESTAMP AS bucket, round(avg(score), 10) AS avg_score, count(score) AS points
    FROM v_signal GROUP BY 1, 2""",
)
def score_heatmap(spark, sf):
    return rounded(st.heatmap(signals(spark, sf), "ticker", F.date_trunc("day", "ts")), "avg_score", digits=10)
