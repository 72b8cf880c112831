"""Normalisation, validation, deduplication and linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import fields as fl
from tickerloom.functions import text as tx
from tickerloom.functions.keys import letters, ticker_ok
from tickerloom.operators import dedupe as dd
from tickerloom.operators import linking as ln
from tickerloom.operators import normalize as nm
from tickerloom.operators import validate as vd
from tickerloom.operators.scoring import signal_id
from tickerloom.params import STOP_WORDS
from tickerloom.plans.check_views import clean
from tickerloom.plans.frames import contribs, joined_text, rounded, signals
from tickerloom.plans.registry import query
from tickerloom.sources import views as v


@query(
    "canonical_urls",
    """SELECT p.page_id, p.url AS raw_url, c.url AS canonical FROM pages p
    JOIN v_clean c ON c.source_id = 'page-' || p.page_id""",
)
def canonical_urls(spark, sf):
    pages = v.table(spark, sf, "pages")
    return pages.select("page_id", F.col("url").alias("raw_url"), tx.canonical_url(F.col("url")).alias("canonical"))


@query("clean_text", f"SELECT page_id, {clean('html')} AS text FROM pages")
def clean_text(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


@query("article_hash", "SELECT source_id, hash FROM v_clean")
def article_hash(spark, sf):
    raw = v.raw_items(spark, sf)
    title = tx.clean_text(F.col("title"))
    return raw.select("source_id", tx.article_hash(F.col("title"), title, F.col("url")).alias("hash"))


@query("credibility", "SELECT source_id, credibility FROM v_clean")
def credibility(spark, sf):
    cols = [F.col(c) for c in ("source", "author", "license", "url")]
    return v.raw_items(spark, sf).select("source_id", fl.credibility(*cols).alias("credibility"))


@query(
    "normalize_articles",
    "SELECT id, source, url, published_at, retrieved_at, title, text, lang, hash, credibility, license, author FROM v_clean",
)
def normalize_articles(spark, sf):
    return v.clean_articles(spark, sf)


@query(
    "format_ts",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS from_time,
      strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_text,
      strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_epoch, event_type AS unparsed
    FROM events""",
)
def format_ts(spark, sf):
    events = v.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    text = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select(
        "event_id",
        fl.iso_from_timestamp(F.col("t")).alias("from_time"),
        fl.iso_from_text(text).alias("from_text"),
        fl.iso_from_epoch(F.unix_seconds("t")).alias("from_epoch"),
        fl.iso_from_text(F.col("event_type")).alias("unparsed"),
    )


@query(
    "json_objects",
    """SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, true AS is_object, false AS array_is_object,
    false AS broken_is_object FROM events""",
)
def json_objects(spark, sf):
    events = v.table(spark, sf, "events")
    obj = fl.json_object(F.col("props"))
    return events.select(
        "event_id",
        F.try_variant_get(obj, "$.k", "bigint").alias("k"),
        obj.isNotNull().alias("is_object"),
        fl.json_object(F.concat(F.lit("["), F.col("props"), F.lit("]"))).isNotNull().alias("array_is_object"),
        fl.json_object(F.rtrim(F.col("props"), F.lit("}"))).isNotNull().alias("broken_is_object"),
    )


@query(
    "map_drop_nulls",
    """SELECT doc_id, concat_ws(',', 'lang=' || lang, CASE WHEN lang = 'en' THEN 'license=CC-BY' END,
      'source=' || source) AS fields FROM documents""",
)
def map_drop_nulls(spark, sf):
    docs = v.raw_documents(spark, sf)
    source = F.regexp_extract("url", r"//([^.]*)\.", 1)
    full = F.create_map(F.lit("lang"), "lang", F.lit("license"), "license", F.lit("source"), source)
    entries = F.map_entries(fl.drop_null_values(full))
    shown = F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return docs.select("doc_id", F.array_join(shown, ",").alias("fields"))


@query("alias_json", "SELECT symbol, coalesce(array_to_string(aliases, ','), '') AS aliases FROM v_ticker")
def alias_json(spark, sf):
    """Alias lists out of their stored JSON wrapper; no wrapper gives an empty list."""
    tickers = v.tickers(spark, sf)
    wrapped = F.when(F.col("aliases").isNotNull(), F.to_json(F.struct("aliases")))
    return joined_text(tickers.select("symbol", fl.listed_values(wrapped, "aliases").alias("aliases")), "aliases")


@query(
    "lead_excerpt",
    """SELECT id, substr(text, 1, 80) AS excerpt, concat_ws(' ', title, substr(text, 1, 200)) AS title_and_lead
    FROM v_article""",
)
def lead_excerpt(spark, sf):
    return v.articles(spark, sf).select(
        "id",
        tx.excerpt(F.col("text"), 80).alias("excerpt"),
        tx.title_and_lead(F.col("title"), F.col("text"), 200).alias("title_and_lead"),
    )


@query(
    "utc_times",
    "SELECT event_id, ts AS naive_as_utc, ts + INTERVAL 5 HOUR AS from_new_york, ts - INTERVAL 2 HOUR AS from_offset FROM events",
)
def utc_times(spark, sf):
    """Times without a zone count as UTC; market-local and offset times are converted."""
    events = v.table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return events.select(
        "event_id",
        fl.as_utc(text).alias("naive_as_utc"),
        F.to_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York").alias("from_new_york"),
        fl.as_utc(F.concat(text, F.lit("+02:00"))).alias("from_offset"),
    )


@query("lang_filter", "SELECT id, lang FROM v_article WHERE lang = 'en'")
def lang_filter(spark, sf):
    return nm.keep_languages(v.articles(spark, sf).select("id", "lang", "text"), ["en"]).select("id", "lang")


_GUESS = """
SELECT doc_id, {scores} FROM (SELECT doc_id,
  [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+') IF x <> ''] AS w FROM documents)"""


def _guess_sql() -> str:
    scores = []
    for lang, ws in STOP_WORDS.items():
        listed = ", ".join(f"'{w}'" for w in ws)
        scores.append(f"len([x FOR x IN w IF x IN ({listed})]) AS {lang}")
    inner = _GUESS.format(scores=", ".join(scores))
    # Of equally frequent languages the alphabetically last wins.
    return (
        "SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN NULL WHEN fr >= greatest(de, en, es) THEN 'fr'"
        f" WHEN es >= greatest(de, en) THEN 'es' WHEN en >= de THEN 'en' ELSE 'de' END AS guessed FROM ({inner})"
    )


@query("lang_guess", _guess_sql())
def lang_guess(spark, sf):
    """The language guess for every document, as if none were stated."""
    return v.table(spark, sf, "documents").select("doc_id", nm.guess_language(F.col("text")).alias("guessed"))


# Validation

def _errors(checked, *cols):
    return joined_text(checked, "errors").select(*cols, "errors")


@query(
    "quarantine_raw",
    """SELECT source_id, errors FROM (SELECT source_id, concat_ws(',',
      CASE WHEN length(title) > 512 THEN 'title' END, CASE WHEN length(text) > 20000 THEN 'text' END,
      CASE WHEN length(lang) NOT BETWEEN 2 AND 5 THEN 'lang' END) AS errors FROM v_raw) WHERE errors <> ''""",
)
def quarantine_raw(spark, sf):
    return _errors(vd.quarantined_rows(vd.check_raw_items(v.raw_items(spark, sf))), "source_id")


@query(
    "quarantine_article",
    "SELECT id, CASE WHEN credibility > 100 THEN 'credibility' ELSE '' END AS errors FROM (SELECT id, credibility * (1 + id % 3) AS credibility FROM v_article)",
)
def quarantine_article(spark, sf):
    """Credibility scaled by the id so that some values leave the range."""
    scaled = v.articles(spark, sf).withColumn("credibility", F.col("credibility") * (1 + F.col("id") % 3))
    return _errors(vd.check_articles(scaled), "id")


@query(
    "quarantine_links",
    """SELECT article_id, concat_ws(',', CASE WHEN length(user_ticker) > 10 OR user_ticker <> upper(user_ticker) THEN 'ticker' END,
      CASE WHEN confidence * 1.5::DOUBLE > 1 THEN 'confidence' END, CASE WHEN method IS NULL THEN 'method' END) AS errors
    FROM (SELECT *, CASE WHEN event_type = 'view' THEN lower(ticker) ELSE ticker END AS user_ticker FROM v_mention)""",
)
def quarantine_links(spark, sf):
    """Linker output with stretched confidences and some tickers in lower case."""
    links = v.mentions(spark, sf).select(
        "article_id",
        F.when(F.col("event_type") == "view", F.lower("ticker")).otherwise(F.col("ticker")).alias("ticker"),
        (F.col("confidence") * 1.5).alias("confidence"),
        "method",
        F.array("event_type").alias("matched_terms"),
    )
    return _errors(vd.check_links(links, linker_output=True), "article_id")


@query("links_valid", "SELECT article_id, ticker, confidence, method FROM v_mention")
def links_valid(spark, sf):
    """Stored links may leave the method open."""
    links = v.links(spark, sf)
    return vd.valid_rows(vd.check_links(links)).select("article_id", "ticker", "confidence", "method")


@query(
    "quarantine_sentiment",
    """SELECT event_id, concat_ws(',', CASE WHEN value / 100 > 1 THEN 'prob_pos' END,
      CASE WHEN abs(value / 100 + 0.25::DOUBLE + 0.25::DOUBLE - 1) > 0.01::DOUBLE THEN 'prob_sum' END) AS errors FROM events""",
)
def quarantine_sentiment(spark, sf):
    probs = v.table(spark, sf, "events").select(
        "event_id", (F.col("value") / 100).alias("prob_pos"), F.lit(0.25).alias("prob_neg"), F.lit(0.25).alias("prob_neu")
    )
    return _errors(vd.check_sentiment(probs), "event_id")


@query("quarantine_embeds", "SELECT vec_id AS article_id, 'length' AS errors FROM embeddings WHERE len(embedding) <> 384")
def quarantine_embeds(spark, sf):
    """Against the default dimension every supplied vector is too short."""
    return _errors(vd.quarantined_rows(vd.check_embeddings(v.embeddings(spark, sf))), "article_id")


@query("valid_embeds", "SELECT vec_id AS article_id FROM embeddings WHERE len(embedding) = 64")
def valid_embeds(spark, sf):
    return vd.valid_rows(vd.check_embeddings(v.embeddings(spark, sf), dims=64)).select("article_id")


@query(
    "quarantine_bars",
    """SELECT ticker, ts, timeframe, concat_ws(',', CASE WHEN o < 100 THEN 'o' END, CASE WHEN h < 100 THEN 'h' END,
      CASE WHEN l < 100 THEN 'l' END, CASE WHEN c < 100 THEN 'c' END) AS errors FROM v_bar WHERE l < 100""",
)
def quarantine_bars(spark, sf):
    """Prices lowered by 100, so that cheap ones fall below zero."""
    lowered = v.all_bars(spark, sf).withColumns({c: F.col(c) - 100 for c in "ohlc"})
    return _errors(vd.quarantined_rows(vd.check_bars(lowered)), "ticker", "ts", "timeframe")


@query(
    "quarantine_signals",
    """SELECT signal_id, CASE WHEN n > 2 THEN 'contributors' ELSE '' END AS errors FROM
    (SELECT signal_id, count(*) AS n FROM v_strength GROUP BY signal_id)""",
)
def quarantine_signals(spark, sf):
    """Signals that would list every mention of their hour; only those with at most two pass."""
    m = v.mentions(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    counted = m.groupBy("ticker", "ts").agg(F.collect_list("article_id").alias("contributors"))
    listed = counted.select(
        signal_id(ts="ts").alias("signal_id"), "ticker", "ts", F.lit(None).cast("array<string>").alias("event_tags"),
        "contributors",
    )
    return _errors(vd.check_signals(listed), "signal_id")


@query("quarantine_contribs", "SELECT signal_id, article_id, CASE WHEN rank < 2 THEN 'rank' ELSE '' END AS errors FROM v_contrib")
def quarantine_contribs(spark, sf):
    """Ranks counted from zero, as a common mistake has them."""
    shifted = contribs(spark, sf).withColumn("rank", F.col("rank") - 1)
    return _errors(vd.check_contribs(shifted), "signal_id", "article_id")


@query(
    "bad_tickers",
    r"""SELECT p_partkey, p_brand, regexp_full_match(p_brand, '[A-Z.\-]{1,10}') AS brand_ok,
      regexp_full_match(translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ'), '[A-Z.\-]{1,10}') AS spelled_ok,
      false AS newline_ok FROM part""",
)
def bad_tickers(spark, sf):
    parts = v.table(spark, sf, "part")
    spelled = letters(F.col("p_partkey"))
    return parts.select(
        "p_partkey",
        "p_brand",
        ticker_ok(F.col("p_brand")).alias("brand_ok"),
        ticker_ok(spelled).alias("spelled_ok"),
        ticker_ok(F.concat(spelled, F.lit("\n"))).alias("newline_ok"),
    )


@query(
    "orphans",
    """SELECT 'link without ticker' AS problem, count(*) AS n FROM v_mention WHERE ticker NOT IN (SELECT symbol FROM v_ticker)
    UNION ALL SELECT 'link without article', count(*) FROM v_mention WHERE article_id NOT IN (SELECT id FROM v_article)
    UNION ALL SELECT 'embedding without article', count(*) FROM v_embed WHERE article_id NOT IN (SELECT id FROM v_article)
    UNION ALL SELECT 'contribution without signal', count(*) FROM v_contrib WHERE signal_id NOT IN (SELECT id FROM v_signal)""",
)
def orphans(spark, sf):
    links, articles = v.links(spark, sf), v.articles(spark, sf)
    cases = {
        "link without ticker": vd.orphans(links, v.tickers(spark, sf), "ticker", "symbol"),
        "link without article": vd.orphans(links, articles, "article_id", "id"),
        "embedding without article": vd.orphans(v.embeddings(spark, sf), articles, "article_id", "id"),
        "contribution without signal": vd.orphans(contribs(spark, sf), signals(spark, sf), "signal_id", "id"),
    }
    out = None
    for name, df in cases.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("ambiguous_ids", "SELECT id, count(*) AS keys FROM (SELECT DISTINCT id, url FROM v_clean) GROUP BY id HAVING count(*) > 1")
def ambiguous_ids(spark, sf):
    """No two addresses share an id."""
    return vd.ambiguous_ids(v.clean_articles(spark, sf), "id", ["url"])


@query("dup_keys", "SELECT url, count(*) AS copies FROM v_article GROUP BY url HAVING count(*) > 1")
def dup_keys(spark, sf):
    return vd.duplicate_keys(v.articles(spark, sf), ["url"])


# Deduplication

@query(
    "dedupe_exact",
    """SELECT source_id, url, hash FROM (SELECT * FROM v_clean
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_at, source_id) = 1)
    QUALIFY row_number() OVER (PARTITION BY CASE WHEN hash = '' THEN 'url ' || url ELSE hash END
      ORDER BY published_at, source_id) = 1""",
)
def dedupe_exact(spark, sf):
    raw = v.raw_items(spark, sf)
    title = tx.clean_text(F.col("title"))
    keyed = raw.select(
        "source_id",
        "published_at",
        tx.canonical_url(tx.validated_url(F.col("url"))).alias("url"),
        tx.article_hash(F.col("title"), title, F.col("url")).alias("hash"),
    )
    return dd.dedupe_exact(keyed, "source_id").select("source_id", "url", "hash")


@query(
    "dedupe_simhash",
    """SELECT a.id, s.sig AS simhash, (SELECT CASE WHEN f.id <> a.id THEN f.id END FROM v_sigs f
      WHERE bit_count(xor(f.sig, s.sig)) <= 3 ORDER BY f.published_at, f.id LIMIT 1) AS dup_of
    FROM v_article a LEFT JOIN v_sigs s ON s.id = a.id""",
)
def dedupe_simhash(spark, sf):
    articles = v.articles(spark, sf).select("id", "published_at", "title")
    return dd.dedupe_simhash(articles).select("id", "simhash", "dup_of")


@query(
    "boilerplate",
    """SELECT source, line, docs FROM (SELECT source, line, count(*) AS docs,
        max(total) AS total FROM (SELECT DISTINCT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
      JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) USING (source)
      WHERE line <> '' GROUP BY source, line) WHERE docs >= 2 AND docs >= total * 0.05::DOUBLE""",
)
def boilerplate(spark, sf):
    return nm.boilerplate_lines(v.table(spark, sf, "documents"), 0.05)


@query(
    "boilerplate_stripped",
    """SELECT d.doc_id, array_to_string([s FOR s IN string_split(d.text, chr(10)) IF NOT list_contains(coalesce(b.lines, []), trim(s))], chr(10))
      AS text
    FROM documents d LEFT JOIN (SELECT source, list(line) AS lines FROM (SELECT source, line, count(*) AS docs, max(total) AS total
        FROM (SELECT DISTINCT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
        JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) USING (source)
        WHERE line <> '' GROUP BY source, line) WHERE docs >= 2 AND docs >= total * 0.05::DOUBLE GROUP BY source) b
    ON b.source = d.source""",
)
def boilerplate_stripped(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "source", "text")
    return nm.strip_boilerplate(docs, 0.05).select("doc_id", "text")


# Linking

def _link_sql(found: str) -> str:
    return f"""SELECT article_id, ticker, round(max(confidence), 6) AS confidence, arg_max(method, confidence) AS method,
      string_agg(DISTINCT term, ',' ORDER BY term) AS matched_terms FROM ({found}) GROUP BY article_id, ticker"""


def _shown_links(links):
    return rounded(joined_text(links, "matched_terms"), "confidence")


@query("cashtag_links", _link_sql("SELECT * FROM v_cashtag"))
def cashtag_links(spark, sf):
    return _shown_links(ln.link_cashtags(v.linker_articles(spark, sf), v.linker_tickers(spark, sf)))


@query("dict_links", _link_sql("SELECT * FROM v_dict"))
def dict_links(spark, sf):
    return _shown_links(ln.link_dictionary(v.linker_articles(spark, sf), v.linker_tickers(spark, sf)))


_ALL_LINKS = (
    "SELECT article_id, ticker, term, method, confidence FROM v_cashtag UNION ALL"
    " SELECT article_id, ticker, term, method, confidence FROM v_dict"
)


@query("link_tickers", _link_sql(_ALL_LINKS))
def link_tickers(spark, sf):
    return _shown_links(ln.link_tickers(v.linker_articles(spark, sf), v.linker_tickers(spark, sf)))


@query(
    "links_stored",
    _link_sql("SELECT * FROM v_cashtag").replace("SELECT article_id,", "SELECT article_id + 1000000000 AS article_id,", 1),
)
def links_stored(spark, sf):
    linked = ln.link_cashtags(v.linker_articles(spark, sf), v.linker_tickers(spark, sf))
    return _shown_links(ln.stored_links(linked, F.col("article_id") + 1000000000))


_SPAN_SQL = r"""SELECT * FROM (WITH RECURSIVE a AS (SELECT l.id, c.ticker, l.text, c.term FROM v_linker l JOIN ({found}) c ON c.article_id = l.id),
    w AS (SELECT id, ticker, term, text, CAST(0 AS BIGINT) AS done, strpos(text, term) AS pos FROM a
      UNION ALL SELECT id, ticker, term, text, done + pos + length(term) - 1,
        strpos(substr(text, CAST(done + pos + length(term) AS BIGINT)), term) FROM w WHERE pos > 0)
    SELECT id AS article_id, ticker, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM (SELECT DISTINCT id, ticker,
        done + pos - 1 AS s, done + pos - 1 + length(term) AS e FROM w WHERE pos > 0
        AND (done + pos = 1 OR NOT regexp_matches(substr(text, CAST(done + pos - 1 AS BIGINT), 1), '[\p{L}\p{Nd}$#]'))
        AND NOT regexp_matches(substr(text, CAST(done + pos + length(term) AS BIGINT), 1), '[\p{L}\p{Nd}#]'))
    GROUP BY id, ticker)"""


def _shown_spans(spans):
    each = F.transform("char_spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return spans.select("article_id", "ticker", F.array_join(each, ",").alias("spans"))


@query("cashtag_spans", _SPAN_SQL.replace("{found}", "SELECT article_id, ticker, term FROM v_cashtag"))
def cashtag_spans(spark, sf):
    """All places of all known cashtags."""
    return _shown_spans(ln.cashtag_spans(v.linker_articles(spark, sf), v.linker_tickers(spark, sf)))


@query(
    "link_spans",
    _SPAN_SQL.replace("{found}", "SELECT article_id, ticker, term FROM v_cashtag UNION SELECT article_id, ticker, term FROM v_dict"),
)
def link_spans(spark, sf):
    """All places of all matched terms of every link, whatever the method."""
    articles = v.linker_articles(spark, sf)
    return _shown_spans(ln.with_spans(ln.link_tickers(articles, v.linker_tickers(spark, sf)), articles))
