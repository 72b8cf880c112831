"""Sources, zones, table maintenance and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators import dedupe as dd
from tickerloom.operators import linking as ln
from tickerloom.operators import maintenance as mt
from tickerloom.operators import quality as ql
from tickerloom.operators import stats as st
from tickerloom.operators import validate as vd
from tickerloom.operators.features import hashed_embeddings
from tickerloom.operators.scoring import signal_id
from tickerloom.operators.stats import bars_from_ticks
from tickerloom.operators.validity import apply_intervals
from tickerloom.plans.frames import contribs, rounded, signals
from tickerloom.plans.registry import query
from tickerloom.session import stored, work_dir
from tickerloom.sources import readers as rd
from tickerloom.sources import views as v
from tickerloom.sources import zones as zn

_RAW = ["source", "source_id", "url", "published_at", "retrieved_at", "title", "text", "lang", "license", "author"]
_RAW_SQL = ", ".join(_RAW)


def landed_items(items: DataFrame, *meta) -> DataFrame:
    """Raw items as a collector lands them: zoned ISO text for times, upper-case language codes."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    fields = [
        F.date_format(c, iso).alias(c) if c in ("published_at", "retrieved_at") else F.upper(c).alias(c) if c == "lang" else F.col(c)
        for c in _RAW
    ]
    return items.select(*fields, F.create_map(*meta).alias("meta")) if meta else items.select(*fields)


def land(spark, items: DataFrame, label: str) -> str:
    path = work_dir(spark, label)
    items.write.json(path)
    return path


# Sources

@query("raw_json_roundtrip", f"SELECT {_RAW_SQL} FROM v_raw")
def raw_json_roundtrip(spark, sf):
    """Landed as NDJSON, read under the declared schema, mapped back to raw items."""
    path = land(spark, landed_items(v.raw_items(spark, sf)), "raw")
    return rd.map_news_items(rd.read_raw_json(spark, path)).select(*_RAW)


@query(
    "corrupt_json",
    "SELECT count(*) AS items, count(*) AS corrupt FROM documents",
)
def corrupt_json(spark, sf):
    """Every landed line once whole and once cut short: the cut ones are kept aside, none is lost."""
    lines = landed_items(v.raw_documents(spark, sf)).select(F.to_json(F.struct(*_RAW)).alias("value"))
    cut = lines.select(F.expr("substring(value, 1, length(value) - 1)").alias("value"))
    path = work_dir(spark, "cut")
    lines.unionByName(cut).write.text(path)
    landed = rd.read_raw_json(spark, path)
    whole = F.col("_corrupt").isNull() & F.col("source_id").isNotNull()
    return landed.agg(F.count_if(whole).alias("items"), F.count("_corrupt").alias("corrupt"))


@query(
    "filings",
    """SELECT source_id, form FROM (SELECT source_id, CASE lang WHEN 'en' THEN '8-K' WHEN 'fr' THEN '10-Q'
      WHEN 'de' THEN '10-K' ELSE 'S-1' END AS form FROM v_rawdoc) WHERE form IN ('8-K', '10-Q', '10-K')""",
)
def filings(spark, sf):
    """Documents as filings, the form by language; one of the four forms is not listed."""
    form = F.lit("S-1")
    for lang, name in (("en", "8-K"), ("fr", "10-Q"), ("de", "10-K")):
        form = F.when(F.col("lang") == lang, F.lit(name)).otherwise(form)
    path = land(spark, landed_items(v.raw_documents(spark, sf), F.lit("form"), form), "filings")
    listed = rd.map_filings(rd.read_raw_json(spark, path))
    return listed.select("source_id", F.col("meta")["form"].alias("form"))


@query(
    "cashtag_posts",
    r"SELECT id, text FROM (SELECT doc_id AS id, CASE WHEN lang = 'en' THEN '$' || chr(65) || ' ' ELSE '' END || text AS text FROM documents) WHERE regexp_matches(text, '\$[A-Z.\-]{1,10}')",
)
def cashtag_posts(spark, sf):
    """English documents as posts with a cashtag, the others without."""
    docs = v.raw_documents(spark, sf)
    body = F.concat(F.when(F.col("lang") == "en", F.lit("$A ")).otherwise(F.lit("")), F.col("text"))
    posts = landed_items(docs.withColumn("text", body)).withColumn("meta", F.lit(None).cast("map<string,string>"))
    kept = rd.map_posts(posts)
    return kept.select(F.substring("source_id", 5, 18).cast("bigint").alias("id"), "text")


@query(
    "sources_union",
    """SELECT source_id, url, title, lang, published_at, source, license, retrieved_at FROM v_raw
    WHERE starts_with(source_id, 'page') OR source IN ('sec', 'gdelt')""",
)
def sources_union(spark, sf):
    """Web pages and two of the document sources are switched on; the keep-list includes attribution."""
    docs = v.raw_documents(spark, sf).drop("doc_id")
    frames = {s: docs.filter(F.col("source") == s) for s in ("gdelt", "sec", "stocktwits")}
    frames["pages"] = v.raw_pages(spark, sf)
    on = rd.union_sources(frames, {"pages": True, "gdelt": True, "sec": True, "stocktwits": False})
    return rd.keep_fields(
        on, ["source_id", "url", "title", "lang", "published_at", "source", "license", "retrieved_at"]
    )


@query(
    "load_tickers_csv",
    "SELECT symbol, name, array_to_string(aliases, ';') AS aliases FROM v_ticker",
)
def load_tickers_csv(spark, sf):
    path = work_dir(spark, "tickers")
    universe = v.tickers(spark, sf).select("symbol", "name", F.array_join("aliases", ";").alias("aliases"))
    universe.write.option("header", True).csv(path)
    loaded = rd.read_ticker_csv(spark, path)
    return loaded.select("symbol", "name", F.array_join("aliases", ";").alias("aliases"))


@query("load_bars_csv", "SELECT * FROM v_bar1d")
def load_bars_csv(spark, sf):
    path = work_dir(spark, "bars")
    v.bars(spark, sf, "1d").write.option("header", True).csv(path)
    return vd.valid_rows(vd.check_bars(rd.read_bars_csv(spark, path)))


@query(
    "zone_roundtrip",
    """SELECT id, source, url, published_at, lang FROM v_article
    WHERE CAST(published_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-05'""",
)
def zone_roundtrip(spark, sf):
    """Written twice to the clean zone, which must leave one copy; read back through date pruning."""
    root = work_dir(spark, "zones")
    articles = v.articles(spark, sf).select("id", "source", "url", "published_at", "lang")
    for _ in range(2):
        zn.write_zone(articles, root, "clean", "article", "published_at", ["id"])
    back = zn.read_zone(spark, root, "clean", "article", "2024-01-01", "2024-01-05")
    return back.select("id", "source", "url", "published_at", "lang")


# Maintenance

_COPIES = """SELECT * FROM v_clean QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_at DESC, source_id DESC) = 1"""


@query(
    "upsert_articles",
    f"""SELECT coalesce(o.id, n.new_id) AS id, n.url, n.title, n.hash, n.credibility, n.published_at,
      TIMESTAMP '2024-03-01 00:00:00' AS retrieved_at
    FROM (SELECT *, CAST(CAST(concat('0x', substr(sha1(url), 1, 16)) AS UBIGINT) >> 1 AS BIGINT) AS new_id FROM ({_COPIES})) n
    LEFT JOIN (SELECT url, min(id) AS id FROM v_article GROUP BY url) o ON o.url = n.url""",
)
def upsert_articles(spark, sf):
    """Stored documents meet a batch of all items: known addresses keep their number, pages come in new."""
    kept = v.articles(spark, sf).groupBy("url").agg(F.min_by(F.struct("id", "published_at", "title"), "id").alias("a"))
    old = kept.select(
        "a.id", "url", F.col("url").alias("url_canonical"), "a.published_at", F.lit(None).cast("timestamp").alias("retrieved_at"),
        "a.title", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("double").alias("credibility"),
    )
    batch = v.clean_articles(spark, sf).select("url", "published_at", "title", "hash", "credibility")
    merged = mt.upsert_articles(old, batch, "2024-03-01 00:00:00", ["published_at", "hash"])
    return merged.select("id", "url", "title", "hash", "credibility", "published_at", "retrieved_at")


@query(
    "dedupe_batch",
    "SELECT ticker, article_id, ts, value FROM v_mention QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, article_id DESC) = 1",
)
def dedupe_batch(spark, sf):
    rows = v.mentions(spark, sf).select("ticker", "article_id", "ts", "value")
    return dd.keep_last_in_batch(rows, ["ticker"], ["ts", "article_id"])


@query(
    "merge_by_key",
    """SELECT c_custkey AS id, CASE WHEN o.n IS NOT NULL THEN o.n END AS orders, CASE WHEN o.n IS NOT NULL THEN o.last_status END
      AS status, c_name AS name FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n,
      arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey""",
)
def merge_by_key(spark, sf):
    """Generic upsert on two other tables: order totals are merged into the customers, whose names stay."""
    old = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.lit(None).cast("bigint").alias("orders"), F.lit(None).cast("string").alias("status"),
        F.col("c_name").alias("name"),
    )
    totals = (
        v.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(F.count("*").alias("orders"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
        .withColumn("name", F.lit(None).cast("string"))
    )
    known = totals.join(old.select("id"), "id", "left_semi")
    return mt.merge_by_key(old, known, "id", ["orders"], keep_old=["name"])


@query(
    "replace_links",
    """SELECT article_id, ticker, confidence, method FROM v_mention WHERE article_id NOT IN (SELECT article_id FROM v_cashtag)
    UNION ALL SELECT article_id, ticker, confidence, method FROM v_cashtag""",
)
def replace_links(spark, sf):
    """Articles that the linker has seen get its links, the others keep what they had."""
    new = ln.stored_links(ln.link_cashtags(v.linker_articles(spark, sf), v.linker_tickers(spark, sf)))
    return mt.replace_links(v.links(spark, sf), new).select("article_id", "ticker", "confidence", "method")


def _bars_of(spark, sf, event_type: str) -> DataFrame:
    ticks = v.mentions(spark, sf).filter(F.col("event_type") == event_type)
    return bars_from_ticks(ticks, "1d", "day", "article_id")


def _bars_sql(event_type: str) -> str:
    return f"""SELECT ticker, date_trunc('day', ts)::TIMESTAMP AS ts, first(value ORDER BY ts, article_id) AS o,
      max(value) AS h, min(value) AS l, last(value ORDER BY ts, article_id) AS c, count(*) AS v, '1d' AS timeframe
    FROM v_mention WHERE event_type = '{event_type}' GROUP BY ticker, date_trunc('day', ts)"""


@query(
    "append_bars",
    f"""SELECT * FROM ({_bars_sql('click')}) UNION ALL SELECT * FROM ({_bars_sql('view')}) n
    WHERE NOT EXISTS (SELECT 1 FROM ({_bars_sql('click')}) o WHERE o.ticker = n.ticker AND o.ts = n.ts)""",
)
def append_bars(spark, sf):
    """Bars of two trade kinds: a taken key keeps its bar."""
    keys = ["ticker", "ts", "timeframe"]
    return mt.append(_bars_of(spark, sf, "click"), _bars_of(spark, sf, "view"), keys, "ignore")


@query(
    "append_bars_replace",
    f"""SELECT * FROM ({_bars_sql('view')}) UNION ALL SELECT * FROM ({_bars_sql('click')}) o
    WHERE NOT EXISTS (SELECT 1 FROM ({_bars_sql('view')}) n WHERE o.ticker = n.ticker AND o.ts = n.ts)""",
)
def append_bars_replace(spark, sf):
    keys = ["ticker", "ts", "timeframe"]
    return mt.append(_bars_of(spark, sf, "click"), _bars_of(spark, sf, "view"), keys, "replace")


@query("append_error_free", "SELECT * FROM v_bar")
def append_error_free(spark, sf):
    """Daily and hourly bars share no key, so the strict append goes through."""
    return mt.append(v.bars(spark, sf, "1d"), v.bars(spark, sf, "1h"), ["ticker", "ts", "timeframe"])


@query("insert_signals", "SELECT id, ticker, ts, score FROM v_signal")
def insert_signals(spark, sf):
    """The id follows from ticker and time, whatever produced the row."""
    return mt.with_signal_ids(signals(spark, sf).select("ticker", "ts", "score")).select("id", "ticker", "ts", "score")


@query(
    "upsert_embeds",
    r"""SELECT article_id, array_to_string([CAST(round(1000000 * x) AS BIGINT) FOR x IN embedding], ',') AS embedding,
      CAST(len(embedding) AS BIGINT) AS dims FROM (
        SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT id, [c / sqrt(list_sum([y * y FOR y IN counts])) FOR c IN counts]
        FROM (SELECT id, [CAST(len([s FOR s IN slots IF s = i]) AS DOUBLE) FOR i IN range(0, 16)] AS counts
          FROM (SELECT id, [CAST(concat('0x', substr(sha1(x), 1, 15)) AS BIGINT) % 16
              FOR x IN regexp_split_to_array(lower(title || ' ' || substr(text, 1, 200)), '[^\p{L}\p{Nd}]+') IF x <> ''] AS slots
            FROM v_article WHERE id IN (SELECT doc_id FROM labels)))
        WHERE list_sum(counts) > 0)""",
)
def upsert_embeds(spark, sf):
    """New vectors for the labelled documents replace or join the stored ones."""
    old = v.embeddings(spark, sf).select("article_id", F.col("embedding").cast("array<double>").alias("embedding"), "model", "dims")
    labelled = v.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    new = hashed_embeddings(v.articles(spark, sf).join(labelled, "id", "left_semi"), dims=16, lead=200)
    merged = mt.upsert_embeddings(old, new, ["model"])
    whole = F.transform("embedding", lambda x: F.round(x * 1000000).cast("bigint"))
    return merged.select("article_id", F.array_join(whole, ",").alias("embedding"), F.col("dims").cast("bigint").alias("dims"))


@query(
    "append_tickers",
    """SELECT symbol, name, exchange FROM v_ticker UNION ALL SELECT t.ticker, NULL, NULL FROM
    (SELECT DISTINCT ticker FROM v_mention) t WHERE t.ticker NOT IN (SELECT symbol FROM v_ticker)""",
)
def append_tickers(spark, sf):
    """Mentioned tickers missing from the dimension come in with their symbol only."""
    old = v.tickers(spark, sf).select("symbol", "name", "exchange")
    seen = v.mentions(spark, sf).select(F.col("ticker").alias("symbol")).distinct()
    null = F.lit(None).cast("string")
    return mt.append(old, seen.select("symbol", null.alias("name"), null.alias("exchange")), ["symbol"], "ignore")


@query(
    "update_tickers",
    """SELECT t.symbol, t.name, CASE WHEN e.n % 2 = 0 THEN 'X' || e.n WHEN e.n IS NULL THEN t.exchange END AS exchange
    FROM v_ticker t LEFT JOIN (SELECT ticker, count(*) AS n FROM v_mention GROUP BY ticker) e ON e.ticker = t.symbol""",
)
def update_tickers(spark, sf):
    """The exchange of mentioned tickers is set, for odd counts to null, after an older update of each that doesn't
    count; the unknown column and unknown symbols change nothing."""
    counted = v.mentions(spark, sf).groupBy(F.col("ticker").alias("symbol")).agg(F.count("*").alias("n"))
    last = F.when(F.pmod("n", F.lit(2)) == 0, F.concat(F.lit("X"), "n"))
    updates = counted.select("symbol", last.alias("exchange"), F.col("n").alias("no_such_column"), F.lit(2).alias("no"))
    older = updates.withColumns({"exchange": F.lit("old"), "no": F.lit(1)})
    return mt.update_by_key(v.tickers(spark, sf), older.unionByName(updates), "symbol", ["no"]).select("symbol", "name", "exchange")


@query(
    "alias_edit",
    """SELECT e.symbol, CASE WHEN t.symbol IS NULL THEN NULL ELSE array_to_string(list_sort([x FOR x IN
        list_distinct(list_append(coalesce(t.aliases, []), 'Inc ' || e.symbol)) IF x <> coalesce(t.name, '')]), ',') END AS aliases,
      (t.symbol IS NOT NULL AND t.aliases IS NOT NULL) AS changed
    FROM (SELECT DISTINCT ticker AS symbol FROM v_mention) e LEFT JOIN v_ticker t ON t.symbol = e.symbol""",
)
def alias_edit(spark, sf):
    """Each mentioned ticker gains one alias and loses its name as an alias."""
    seen = v.mentions(spark, sf).select(F.col("ticker").alias("symbol")).distinct()
    tickers = v.tickers(spark, sf)
    edits = seen.join(tickers.select("symbol", "name"), "symbol", "left").select(
        "symbol", F.concat(F.lit("Inc "), "symbol").alias("add"), F.coalesce("name", F.lit("none")).alias("remove")
    )
    out = mt.edit_aliases(tickers, edits)
    sorted_aliases = F.when(F.col("aliases").isNotNull(), F.array_join(F.array_sort("aliases"), ","))
    return out.select("symbol", sorted_aliases.alias("aliases"), "changed")


@query(
    "add_contribs",
    """SELECT signal_id, article_id, CAST(rank AS BIGINT) AS rank FROM v_contrib UNION ALL
    SELECT s.signal_id, s.article_id, NULL FROM v_strength s WHERE NOT EXISTS
    (SELECT 1 FROM v_contrib c WHERE c.signal_id = s.signal_id AND c.article_id = s.article_id)""",
)
def add_contribs(spark, sf):
    """The mentions that did not make the ranking are appended without a rank."""
    old = contribs(spark, sf).select("signal_id", "article_id", F.col("rank").cast("bigint").alias("rank"))
    every = v.mentions(spark, sf).withColumn("hour", F.date_trunc("hour", "ts")).select(
        signal_id().alias("signal_id"), "article_id", F.lit(None).cast("bigint").alias("rank")
    )
    return mt.append(old, every, ["signal_id", "article_id"], "ignore")


def _table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


_CUT = "TIMESTAMP '2024-01-01 06:00:00'"


@query(
    "delete_cascade",
    f"""SELECT 'article' AS table_name, count(*) AS n FROM v_article WHERE published_at >= {_CUT}
    UNION ALL SELECT 'link', count(*) FROM v_mention WHERE article_id NOT IN (SELECT id FROM v_article WHERE published_at < {_CUT})
    UNION ALL SELECT 'embed', count(*) FROM v_embed WHERE article_id NOT IN (SELECT id FROM v_article WHERE published_at < {_CUT})
    UNION ALL SELECT 'contrib', count(*) FROM v_contrib WHERE article_id NOT IN (SELECT id FROM v_article WHERE published_at < {_CUT})""",
)
def delete_cascade(spark, sf):
    children = {"link": v.links(spark, sf), "embed": v.embeddings(spark, sf), "contrib": contribs(spark, sf)}
    return _table_counts(mt.delete_old_articles(v.articles(spark, sf), children, "2024-01-01 06:00:00"))


@query(
    "delete_signals",
    """SELECT 'by ticker' AS table_name, count(*) AS n FROM v_signal WHERE ticker <> 'BA'
    UNION ALL SELECT 'by range', count(*) FROM v_signal WHERE NOT ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06'
    UNION ALL SELECT 'contributions', count(*) FROM v_contrib WHERE signal_id NOT IN (SELECT id FROM v_signal WHERE ticker = 'BA')""",
)
def delete_signals(spark, sf):
    s = signals(spark, sf)
    _, kept = mt.delete_signals_cascade(s, contribs(spark, sf), F.col("ticker") == "BA")
    return _table_counts(
        {
            "by ticker": mt.delete_by_ticker(s, "BA"),
            "by range": mt.delete_by_range(s, "2024-01-03 00:00:00", "2024-01-06 00:00:00"),
            "contributions": kept,
        }
    )


@query(
    "delete_bars",
    "SELECT * FROM v_bar WHERE ticker <> 'BA' AND NOT ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06'",
)
def delete_bars(spark, sf):
    left = mt.delete_by_ticker(v.all_bars(spark, sf), "BA")
    return mt.delete_by_range(left, "2024-01-03 00:00:00", "2024-01-06 00:00:00")


@query(
    "delete_embeds",
    "SELECT article_id, model FROM v_embed WHERE article_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_embeds(spark, sf):
    toxic = v.table(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("article_id"))
    return mt.delete_by_keys(v.embeddings(spark, sf), toxic, "article_id").select("article_id", "model")


@query(
    "retention",
    """SELECT 'raw' AS table_name, count(*) AS n FROM v_mention WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY
    UNION ALL SELECT 'features', count(*) FROM v_bar1h WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY
    UNION ALL SELECT 'signals', count(*) FROM v_signal""",
)
def retention(spark, sf):
    """Each zone with its own period; signals are kept."""
    now = "2024-01-31 00:00:00"
    return _table_counts(
        {
            "raw": mt.retain(v.mentions(spark, sf), "ts", 7, now),
            "features": mt.retain(v.bars(spark, sf, "1h"), "ts", 14, now),
            "signals": signals(spark, sf),
        }
    )


# Zones in batches

def _dated_articles(spark, sf):
    return v.articles(spark, sf).select("id", "url", (F.col("published_at") + F.make_dt_interval(F.pmod("id", F.lit(5)))).alias("ts"))


_DATED = "SELECT id, url, published_at + to_days(CAST(id % 5 AS INTEGER)) AS ts FROM v_article"


@query("zone_append", _DATED)
def zone_append(spark, sf):
    """Two batches of the same days: nothing of the first is lost."""
    root = work_dir(spark, "zone-append")
    rows = _dated_articles(spark, sf)
    for half in (0, 1):
        zn.write_zone(rows.filter(F.pmod("id", F.lit(2)) == half), root, "clean", "article", "ts", ["id"], mode="append")
    return zn.read_zone(spark, root, "clean", "article").drop("date")


@query("zone_upsert", f"SELECT id, CASE WHEN id % 3 = 0 AND id % 5 = 1 THEN 'new' ELSE url END AS url, ts FROM ({_DATED})")
def zone_upsert(spark, sf):
    """A batch upserted into one day; other days aren't touched."""
    root = work_dir(spark, "zone-upsert")
    rows = _dated_articles(spark, sf)
    zn.write_zone(rows, root, "clean", "article", "ts", ["id"])
    some = rows.filter((F.pmod("id", F.lit(3)) == 0) & (F.pmod("id", F.lit(5)) == 1)).withColumn("url", F.lit("new"))
    zn.upsert_zone(some, root, "clean", "article", "ts", ["id"], ["url"])
    return zn.read_zone(spark, root, "clean", "article").drop("date")


@query(
    "zone_move",
    f"""SELECT id, url, CASE WHEN id % 7 = 2 THEN ts + INTERVAL 2 DAY ELSE ts END AS ts FROM ({_DATED})
    UNION ALL SELECT -1, 'later', (SELECT max(ts) + INTERVAL 5 DAY FROM ({_DATED}))""",
)
def zone_move(spark, sf):
    """A batch in which some addresses change their day: each keeps one row, found by the key summaries."""
    root = work_dir(spark, "zone-move")
    rows = _dated_articles(spark, sf)
    zn.write_zone(rows, root, "clean", "article", "ts", ["id"])
    moved = rows.filter(F.pmod("id", F.lit(7)) == 2).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAY"))
    last = rows.agg(F.lit(-1).cast("bigint").alias("id"), F.lit("later").alias("url"), (F.max("ts") + F.expr("INTERVAL 5 DAY")).alias("ts"))
    zn.upsert_zone(moved.unionByName(last), root, "clean", "article", "ts", ["id"], ["url"])
    return zn.read_zone(spark, root, "clean", "article").drop("date")


@query("zone_retention", f"SELECT * FROM ({_DATED}) WHERE ts >= TIMESTAMP '2024-01-03 00:00:00'")
def zone_retention(spark, sf):
    """Old days dropped as whole folders."""
    root = work_dir(spark, "zone-retention")
    zn.write_zone(_dated_articles(spark, sf), root, "clean", "article", "ts", ["id"])
    zn.drop_dates(spark, root, "clean", "article", before="2024-01-03")
    return zn.read_zone(spark, root, "clean", "article").drop("date")


@query("bar_rollup_minutes", "SELECT * FROM v_bar1h")
def bar_rollup_minutes(spark, sf):
    """Hourly bars from minute bars."""
    return st.roll_up_bars(v.bars(spark, sf, "1m"), "1h", "hour")


# Quality

_SPLIT = "2024-01-01 08:00:00"


@query(
    "dq_report",
    f"""SELECT 'duplicate_url_pct' AS metric, round((count(*) - count(DISTINCT url)) / count(*) * 100.0::DOUBLE, 6) AS value FROM v_clean
    UNION ALL SELECT 'duplicate_hash_pct', round((count(*) FILTER (WHERE hash <> '') - count(DISTINCT hash) FILTER (WHERE hash <> ''))
      / count(*) * 100.0::DOUBLE, 6) FROM v_clean
    UNION ALL SELECT 'language_drift', round(sum(abs(a / nullif(ta, 0) - b / nullif(tb, 0))) / 2, 6) FROM (SELECT lang,
        CAST(count(*) FILTER (WHERE published_at < TIMESTAMP '{_SPLIT}') AS DOUBLE) AS a,
        CAST(count(*) FILTER (WHERE published_at >= TIMESTAMP '{_SPLIT}') AS DOUBLE) AS b,
        (SELECT count(*) FROM v_clean WHERE published_at < TIMESTAMP '{_SPLIT}') AS ta,
        (SELECT count(*) FROM v_clean WHERE published_at >= TIMESTAMP '{_SPLIT}') AS tb FROM v_clean GROUP BY lang)
    UNION ALL SELECT 'linker_precision', round(avg(CASE WHEN list_contains(l.named, k.ticker) THEN 1.0::DOUBLE ELSE 0 END), 6)
      FROM (SELECT DISTINCT article_id, ticker FROM (SELECT article_id, ticker FROM v_cashtag UNION ALL SELECT article_id, ticker FROM v_dict)) k
      JOIN v_linker l ON l.id = k.article_id WHERE l.id IN (SELECT doc_id FROM labels)""",
)
def dq_report(spark, sf):
    """Linker precision is judged on the labelled documents."""
    source = v.linker_articles(spark, sf)
    labelled = v.table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"))
    truth = v.linker_truth(spark, sf).join(labelled, "article_id", "left_semi")
    links = ln.link_tickers(source, v.linker_tickers(spark, sf))
    report = ql.quality_report(v.clean_articles(spark, sf), links, truth, _SPLIT)
    return rounded(report, "value")


@query(
    "ingest_metrics",
    """SELECT date_trunc('hour', retrieved_at)::TIMESTAMP AS hour, count(*) AS items,
      round(avg(epoch(retrieved_at) - epoch(published_at)), 6) AS mean_lag_sec,
      max(epoch(retrieved_at) - epoch(published_at)) AS max_lag_sec,
      round(1 - count(DISTINCT url) / CAST(count(*) AS DOUBLE), 6) AS dedupe_rate FROM v_clean GROUP BY 1""",
)
def ingest_metrics(spark, sf):
    return rounded(ql.ingest_metrics(v.clean_articles(spark, sf)), "mean_lag_sec", "dedupe_rate")


@query(
    "lag_percentiles",
    """SELECT source AS bucket, quantile_disc(epoch(retrieved_at)::BIGINT - epoch(published_at)::BIGINT, 0.5) AS p50,
      quantile_disc(epoch(retrieved_at)::BIGINT - epoch(published_at)::BIGINT, 0.95) AS p95 FROM v_raw GROUP BY source""",
)
def lag_percentiles(spark, sf):
    out = ql.lag_percentiles(v.raw_items(spark, sf), F.col("source"), [0.5, 0.95])
    return out.select("bucket", F.col("lag_percentiles")[0].alias("p50"), F.col("lag_percentiles")[1].alias("p95"))


@query(
    "drift_psi",
    """SELECT bin, early, late, round((b - a) * ln(b / a), 6) AS psi FROM (SELECT bin, early, late,
        greatest(CAST(early AS DOUBLE), 0.5::DOUBLE) / sum(early) OVER () AS a,
        greatest(CAST(late AS DOUBLE), 0.5::DOUBLE) / sum(late) OVER () AS b
      FROM (SELECT CAST(len([e FOR e IN (SELECT quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM v_mention
            WHERE ts < TIMESTAMP '2024-01-16') IF value > e]) AS BIGINT) AS bin,
          count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS early, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS late
        FROM v_mention GROUP BY 1))""",
)
def drift_psi(spark, sf):
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp")
    out = ql.population_stability(v.mentions(spark, sf), "value", late, 10, 100000)
    return rounded(out, "psi").withColumn("bin", F.col("bin").cast("bigint"))


@query(
    "brigading",
    """SELECT article_id, k AS author, ticker, ts FROM (SELECT *, count(*) OVER (PARTITION BY k % 5, ticker, date_trunc('hour', ts)) AS n
    FROM v_mention) WHERE n <= 1""",
)
def brigading(spark, sf):
    """Posts of authors who name a ticker more than once an hour are dropped; five author groups."""
    posts = v.mentions(spark, sf).withColumn("author", F.pmod("k", F.lit(5)))
    kept = ql.drop_bursts(posts, 1)
    return kept.select("article_id", F.col("k").alias("author"), "ticker", "ts")


@query(
    "drift_sketches",
    """SELECT (SELECT count(DISTINCT CAST(ts AS DATE)) FROM v_mention WHERE value IS NOT NULL) AS days, count(*) AS bins, true AS near
    FROM (SELECT DISTINCT CAST(len([e FOR e IN (SELECT quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM v_mention
        WHERE ts < TIMESTAMP '2024-01-16') IF value > e]) AS BIGINT) AS bin FROM v_mention)""",
)
def drift_sketches(spark, sf):
    """Drift from the days' stored sketches; ``near`` if it lies within 0.01 of the index over all rows."""
    rows = v.mentions(spark, sf)
    days = stored(ql.day_sketches(rows, "value"), "drift-days")
    split = "2024-01-16"
    parts = ql.stability_of_sketches(ql.period_sketch(days, end=split), ql.period_sketch(days, start=split))
    exact = ql.population_stability(rows, "value", F.col("ts") >= F.lit(split).cast("timestamp"), 10, 100000).agg(F.sum("psi")).scalar()
    merged = parts.agg(F.count("*").alias("bins"), F.sum("psi").alias("psi")).withColumn("exact", exact)
    near = F.abs(F.col("psi") - F.col("exact")) <= 0.01
    return merged.withColumn("days", F.lit(days.count())).select("days", "bins", near.alias("near"))


@query(
    "rings",
    """SELECT * FROM (WITH RECURSIVE p AS (
      SELECT title, source || '-' || (doc_id % 50) AS author, published_at,
        published_at - lag(published_at) OVER (PARTITION BY title ORDER BY published_at) > INTERVAL 6 HOUR AS pause FROM v_rawdoc),
    b AS (SELECT title, author, count(*) FILTER (WHERE pause) OVER (PARTITION BY title ORDER BY published_at) AS burst FROM p),
    e AS (SELECT DISTINCT title, burst, author FROM b JOIN
      (SELECT title, burst FROM b GROUP BY title, burst HAVING count(DISTINCT author) > 1) USING (title, burst)),
    r(author, other) AS (SELECT DISTINCT author, author FROM e
      UNION SELECT r.author, y.author FROM r JOIN e x ON x.author = r.other JOIN e y ON y.title = x.title AND y.burst = x.burst),
    named AS (SELECT author, min(other) AS ring, count(*) AS authors FROM r GROUP BY author)
    SELECT author, ring, authors, texts FROM named JOIN (SELECT ring, count(DISTINCT title) AS texts FROM named JOIN e USING (author) GROUP BY ring)
      USING (ring) WHERE authors >= 3 AND texts >= 2)""",
)
def rings(spark, sf):
    """Authors who post equal titles within six hours of each other, directly or through others."""
    posts = v.raw_documents(spark, sf).withColumn("author", F.concat_ws("-", "source", F.pmod("doc_id", F.lit(50))))
    return ql.coordinated_groups(posts, "title", "published_at", 6 * 3600)


@query(
    "ticker_history",
    """SELECT * FROM (WITH u AS (SELECT symbol, 'X' || n AS exchange, DATE '2024-02-01' + n * 7 AS valid_from, DATE '2024-02-01' + n * 7 + 40 AS valid_to, 1 AS no
        FROM (SELECT ticker AS symbol, CAST(count(*) % 13 AS INTEGER) AS n FROM v_mention GROUP BY ticker)
      UNION ALL SELECT symbol, NULL, DATE '2024-03-01', DATE '2024-03-11', 2 FROM v_ticker WHERE length(symbol) = 2
      UNION ALL SELECT symbol, exchange, DATE '2024-06-01', NULL, 3 FROM v_ticker WHERE exchange IS NOT NULL),
    rows AS (SELECT symbol, exchange, valid_from, valid_to, no FROM u UNION ALL SELECT symbol, exchange, valid_from, valid_to, 0 FROM v_ticker),
    days AS (SELECT d::DATE AS day FROM generate_series(DATE '2023-01-01', DATE '2025-12-31', INTERVAL 1 DAY) t(d)),
    won AS (SELECT symbol, day, arg_max(coalesce(exchange, '-'), no) AS exchange FROM rows JOIN days
        ON (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR valid_to > day) GROUP BY symbol, day),
    runs AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY symbol, exchange ORDER BY day) AS INTEGER) AS run FROM won WHERE exchange <> '-')
    SELECT symbol, exchange, CASE WHEN min(day) > DATE '2023-01-01' THEN min(day) END AS valid_from,
      CASE WHEN max(day) < DATE '2025-12-31' THEN max(day) + 1 END AS valid_to FROM runs GROUP BY symbol, exchange, run)""",
)
def ticker_history(spark, sf):
    """The exchange of tickers over time, after overlapping updates that replace, split and end what was valid."""
    old = v.tickers(spark, sf).select("symbol", "exchange", "valid_from", "valid_to")
    n = F.pmod(F.count("*"), F.lit(13)).cast("int")
    counted = v.mentions(spark, sf).groupBy(F.col("ticker").alias("symbol")).agg(n.alias("n"))
    start = F.date_add(F.lit("2024-02-01").cast("date"), F.col("n") * 7)
    day = lambda d: F.lit(d).cast("date")
    updates = [
        counted.select("symbol", F.concat(F.lit("X"), "n").alias("exchange"), start.alias("valid_from"), F.date_add(start, 40).alias("valid_to"), F.lit(1).alias("no")),
        old.filter(F.length("symbol") == 2).select("symbol", F.lit(None).cast("string").alias("exchange"), day("2024-03-01").alias("valid_from"), day("2024-03-11").alias("valid_to"), F.lit(2).alias("no")),
        old.filter("exchange is not null").select("symbol", "exchange", day("2024-06-01").alias("valid_from"), day(None).alias("valid_to"), F.lit(3).alias("no")),
    ]
    return apply_intervals(old, reduce(DataFrame.unionByName, updates), "symbol", ["exchange"], "no")
