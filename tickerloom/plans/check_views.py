"""The domain frames once more, in SQL for the checking engine. Names start with ``v_``."""

from __future__ import annotations

_LETTERS = "translate(CAST({} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"
# Entities that the pages hold; like a browser, the decoder accepts them without the semicolon too.
_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "copy": "©", "middot": "·", "amp": "&"}
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def letters(col: str) -> str:
    return _LETTERS.format(col)


def clean(col: str) -> str:
    for name, char in _ENTITIES.items():
        col = f"regexp_replace({col}, '&{name};?', '{char}', 'g')"
    return f"nullif(trim(regexp_replace(regexp_replace({col}, '<[^>]+>', '', 'g'), '{_SPACES}', ' ', 'g')), '')"


def word_hash(text: str) -> str:
    return f"CAST(concat('0x', substr(sha1({text}), 1, 15)) AS BIGINT)"


def stable_id(text: str) -> str:
    return f"CAST(CAST(concat('0x', substr(sha1({text}), 1, 16)) AS UBIGINT) >> 1 AS BIGINT)"


_CANONICAL = """
CASE WHEN len(kept) = 0 THEN base ELSE base || '?' || array_to_string(kept, '&') END
"""

VIEWS: dict[str, str] = {
    "v_mention": f"""
SELECT event_id AS article_id, ts, {letters('user_id')} AS ticker, event_type, value, props,
  CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS k,
  CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS DOUBLE) / 100 AS confidence,
  CASE event_type WHEN 'click' THEN 'cashtag' WHEN 'view' THEN 'dict' WHEN 'purchase' THEN 'synonym'
    WHEN 'signup' THEN 'ner' END AS method
FROM events""",
    "v_scored": """
SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE WHEN event_type = 'error' THEN -1.0::DOUBLE
    ELSE 0.0::DOUBLE END AS sentiment,
  CASE event_type WHEN 'purchase' THEN 'earnings' WHEN 'signup' THEN 'guidance' WHEN 'error' THEN 'mna' END AS tag
FROM v_mention""",
    "v_bar1d": """
SELECT ticker, date_trunc('day', ts)::TIMESTAMP AS ts, first(value ORDER BY ts, article_id) AS o, max(value) AS h,
  min(value) AS l, last(value ORDER BY ts, article_id) AS c, count(*) AS v, '1d' AS timeframe
FROM v_mention GROUP BY ticker, date_trunc('day', ts)""",
    "v_bar1h": """
SELECT ticker, date_trunc('hour', ts)::TIMESTAMP AS ts, first(value ORDER BY ts, article_id) AS o, max(value) AS h,
  min(value) AS l, last(value ORDER BY ts, article_id) AS c, count(*) AS v, '1h' AS timeframe
FROM v_mention GROUP BY ticker, date_trunc('hour', ts)""",
    "v_bar1m": """
SELECT ticker, date_trunc('minute', ts)::TIMESTAMP AS ts, last(value ORDER BY ts, article_id) AS c
FROM v_mention GROUP BY ticker, date_trunc('minute', ts)""",
    "v_bar": "SELECT * FROM v_bar1d UNION ALL SELECT * FROM v_bar1h",
    "v_rawdoc": r"""
SELECT CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 0 THEN 'gdelt' WHEN 1 THEN 'sec' WHEN 2 THEN 'stocktwits'
    WHEN 3 THEN 'twitter' ELSE 'reddit' END AS source,
  'doc-' || doc_id AS source_id,
  'https://' || source || '.example.com/a/' || sha1(text)
    || CASE doc_id % 3 WHEN 0 THEN '?utm_source=feed' WHEN 1 THEN '#top' ELSE '' END AS url,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60) AS published_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60 + n_chars % 90) AS retrieved_at,
  split_part(text, chr(10), 1) AS title, text, lang,
  CASE WHEN lang = 'en' THEN 'CC-BY' END AS license, CASE WHEN doc_id % 2 = 0 THEN source END AS author, doc_id
FROM documents""",
    "v_rawpage": r"""
SELECT 'gdelt' AS source, 'page-' || page_id AS source_id, url,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 60) AS published_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 60 + 300) AS retrieved_at,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS text,
  regexp_extract(html, '<html lang="([a-zA-Z]+)"', 1) AS lang,
  CAST(NULL AS VARCHAR) AS license, CAST(NULL AS VARCHAR) AS author
FROM pages""",
    "v_raw": "SELECT * EXCLUDE (doc_id) FROM v_rawdoc UNION ALL SELECT * FROM v_rawpage",
    "v_article": """
SELECT doc_id AS id, source, regexp_replace(url, '[?#].*$', '') AS url, published_at, retrieved_at, title, text, lang,
  license, author, CASE WHEN author IS NOT NULL THEN 80.0::DOUBLE END AS credibility
FROM v_rawdoc""",
    "v_split": """
SELECT *, regexp_replace(url, '#.*$', '') AS u0, split_part(regexp_replace(url, '#.*$', ''), '?', 1) AS base,
  [url_decode(replace(p, '+', ' ')) FOR p IN string_split(CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?')
      THEN substr(regexp_replace(url, '#.*$', ''), strpos(regexp_replace(url, '#.*$', ''), '?') + 1) ELSE '' END, '&')
    IF regexp_matches(p, '^[^=]*=.') AND split_part(p, '=', 1) NOT IN
      ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content')] AS kept
FROM v_raw""",
    "v_clean": f"""
SELECT {stable_id(_CANONICAL)} AS id, source, {_CANONICAL} AS url, published_at, retrieved_at,
  {clean('title')} AS title, {clean('text')} AS text, lang,
  CASE WHEN title = '' THEN '' ELSE sha1(coalesce({clean('title')}, '') || ':'
    || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))) END AS hash,
  least(100.0::DOUBLE, CASE source WHEN 'sec' THEN 90.0::DOUBLE WHEN 'gdelt' THEN 70 WHEN 'stocktwits' THEN 40
      WHEN 'twitter' THEN 35 WHEN 'reddit' THEN 30 ELSE 50 END
    + CASE WHEN coalesce(author, '') <> '' THEN 5 ELSE 0 END + CASE WHEN coalesce(license, '') <> '' THEN 3 ELSE 0 END
    + CASE WHEN starts_with(url, 'https://') THEN 2 ELSE 0 END) AS credibility,
  license, author, source_id
FROM v_split""",
    "v_embed": f"""
SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS embedding,
  CASE WHEN label < 5 THEN 'minilm' ELSE 'other' END AS model, len(embedding) AS dims, {letters('label')} AS ticker,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(vec_id * 600) AS published_at
FROM embeddings""",
    "v_ticker": f"""
SELECT {letters('s_suppkey')} AS symbol, s_name AS name, CASE WHEN s_suppkey % 11 > 0 THEN n_name END AS exchange,
  lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik,
  CASE WHEN s_suppkey % 7 > 0 THEN [s_name, {letters('s_suppkey')}] END AS aliases,
  CASE WHEN s_suppkey % 5 > 0 THEN DATE '2023-06-01' + CAST(s_suppkey % 400 AS INTEGER) END AS valid_from,
  CASE WHEN s_suppkey % 3 = 0 THEN DATE '2023-06-01' + CAST(s_suppkey % 400 + 180 AS INTEGER) END AS valid_to
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_linker": f"""
SELECT doc_id AS id, '$' || {letters('doc_id % 97')} || ' ' || text || ' Supplier#'
  || lpad(CAST(doc_id % 89 AS VARCHAR), 9, '0') || '. Supplier No ' || (doc_id % 83) || ', see $' || {letters('doc_id % 79')}
  || '.' AS text, [{letters('doc_id % 97')}, {letters('doc_id % 89')}, {letters('doc_id % 83')}, {letters('doc_id % 79')}] AS named
FROM documents""",
    "v_cashtag": r"""
SELECT DISTINCT id AS article_id, tag AS ticker, '$' || tag AS term, 'cashtag' AS method, 0.95::DOUBLE AS confidence
FROM (SELECT id, rtrim(CASE WHEN regexp_matches(run, '^[A-Z.\-]*([.\-][^A-Z.\-][\p{L}\p{Nd}]*)?$')
      THEN regexp_extract(run, '^[A-Z.\-]*') ELSE regexp_replace(regexp_extract(run, '^[A-Z.\-]*'), '[A-Z]+$', '') END, '.-') AS tag
  FROM (SELECT id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{Nd}$])\$([A-Z][A-Z.\-]*[\p{L}\p{Nd}]*)', 1)) AS run
    FROM v_linker))
WHERE tag IN (SELECT symbol FROM v_ticker)""",
    "v_dict": r"""
SELECT DISTINCT t.id AS article_id, d.ticker, t.term, d.method, d.confidence
FROM (SELECT id, regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')),
        '^[^\p{L}\p{Nd}$#]+', ''), '[^\p{L}\p{Nd}#]+$', '') AS term FROM v_linker
      UNION ALL SELECT id, regexp_extract(text, 'Supplier No \d+', 0) FROM v_linker) t
JOIN (SELECT symbol AS term, symbol AS ticker, 'dict' AS method, 0.7::DOUBLE AS confidence FROM v_ticker
        WHERE length(symbol) > 1
      UNION SELECT name, symbol, 'synonym', 0.6::DOUBLE FROM v_ticker WHERE name <> symbol
      UNION SELECT 'Supplier No ' || CAST(cik AS BIGINT), symbol, 'synonym', 0.6::DOUBLE FROM v_ticker) d ON t.term = d.term""",
    "v_hourcount": """
SELECT ticker, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS mentions FROM v_mention GROUP BY 1, 2""",
    "v_dense": """
SELECT s.ticker, s.hour, coalesce(c.mentions, 0) AS n, c.mentions
FROM (SELECT ticker, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
      FROM v_hourcount GROUP BY ticker) s
LEFT JOIN v_hourcount c ON c.ticker = s.ticker AND c.hour = s.hour""",
    "v_base": """
SELECT ticker, hour, mentions,
  count(*) OVER w AS baseline_hours, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS std
FROM v_dense WINDOW w AS (PARTITION BY ticker ORDER BY hour ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING)""",
    "v_velocity": """
SELECT ticker, hour, mentions, baseline_hours, mean, std,
  CASE WHEN std > 1e-9 THEN (mentions - mean) / std ELSE 0.0::DOUBLE END AS velocity
FROM v_base WHERE mentions IS NOT NULL""",
    "v_novel": """
SELECT a.article_id, a.ticker, a.published_at, max(list_cosine_similarity(a.embedding, b.embedding)) AS nearest_sim,
  1 - coalesce(max(list_cosine_similarity(a.embedding, b.embedding)), 0) AS novelty
FROM v_embed a LEFT JOIN v_embed b ON a.ticker = b.ticker AND b.published_at < a.published_at
  AND b.published_at >= a.published_at - INTERVAL 24 HOUR
GROUP BY a.article_id, a.ticker, a.published_at""",
    "v_hourly": """
SELECT ticker, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(sentiment) AS sentiment,
  bool_or(coalesce(tag = 'earnings', false)) AS t1, bool_or(coalesce(tag = 'guidance', false)) AS t2,
  bool_or(coalesce(tag = 'mna', false)) AS t3
FROM v_scored GROUP BY 1, 2""",
    "v_feature": f"""
SELECT {stable_id("concat_ws('|', h.ticker, CAST(epoch(h.hour) AS BIGINT))")} AS id, h.ticker, h.hour AS ts,
  round(h.sentiment, 6) AS sentiment, round(n.novelty, 6) AS novelty, round(v.velocity, 6) AS velocity,
  concat_ws(',', CASE WHEN t1 THEN 'earnings' END, CASE WHEN t2 THEN 'guidance' END, CASE WHEN t3 THEN 'mna' END)
    AS event_tags, t1, t2, t3
FROM v_hourly h JOIN v_velocity v ON v.ticker = h.ticker AND v.hour = h.hour
LEFT JOIN (SELECT ticker, date_trunc('hour', published_at)::TIMESTAMP AS hour, avg(novelty) AS novelty
           FROM v_novel GROUP BY 1, 2) n ON n.ticker = h.ticker AND n.hour = h.hour""",
    "v_signal": """
SELECT id, ticker, ts, sentiment, novelty, velocity, event_tags,
  round(coalesce(sentiment, 0) * 0.4::DOUBLE + coalesce(novelty, 0) * 0.3::DOUBLE + coalesce(velocity, 0) * 0.3::DOUBLE
    + (CASE WHEN t1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN t2 THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN t3 THEN 0.25::DOUBLE ELSE 0 END), 8) AS score
FROM v_feature""",
    "v_strength": f"""
SELECT {stable_id("concat_ws('|', ticker, CAST(epoch(date_trunc('hour', ts)) AS BIGINT))")} AS signal_id, article_id,
  abs(sentiment) * confidence AS strength
FROM v_scored""",
    "v_contrib": """
SELECT signal_id, article_id, CAST(rank AS INTEGER) AS rank,
  CASE WHEN total > 0 THEN strength / total ELSE 0.0::DOUBLE END AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY strength DESC, article_id) AS rank,
        sum(strength) OVER (PARTITION BY signal_id) AS total FROM v_strength)
WHERE rank <= 2""",
    "v_fwd1h": """
SELECT *, CASE WHEN c <> 0 THEN lead(c, 1) OVER (PARTITION BY ticker ORDER BY ts) / c - 1 END AS forward_return
FROM v_bar1h""",
    "v_fwd1m": """
SELECT *, CASE WHEN c <> 0 THEN lead(c, 1) OVER (PARTITION BY ticker ORDER BY ts) / c - 1 END AS forward_return
FROM v_bar1m""",
    "v_fwdsession": """
SELECT *, CASE WHEN c <> 0 THEN lead(c, 1) OVER (PARTITION BY ticker ORDER BY ts) / c - 1 END AS forward_return
FROM v_sessionbar""",
    "v_session": """
SELECT day::DATE AS session, row_number() OVER (ORDER BY day) AS ordinal,
  CASE WHEN day = DATE '2024-01-10' THEN TIME '13:00:00' ELSE TIME '16:00:00' END AS closing
FROM generate_series(DATE '2023-12-26', DATE '2024-03-29', INTERVAL 1 DAY) t(day)
WHERE isodow(day) <= 5 AND day NOT IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19', DATE '2024-03-29', DATE '2024-01-23')""",
    "v_sessionbar": """
SELECT b.*, s.session, s.ordinal FROM v_bar1m b JOIN v_session s ON s.session = CAST(ts - INTERVAL 5 HOUR AS DATE)
  AND CAST(ts - INTERVAL 5 HOUR AS TIME) >= TIME '09:30:00' AND CAST(ts - INTERVAL 5 HOUR AS TIME) < s.closing""",
    "v_fwd1d": """
SELECT *, CASE WHEN c <> 0 THEN lead(c, 1) OVER (PARTITION BY ticker ORDER BY ts) / c - 1 END AS forward_return
FROM v_bar1d""",
    "v_return": """
SELECT s.id, s.ticker, s.ts, s.score, b.ts AS entry_ts, b.c AS entry_close, b.forward_return
FROM v_signal s LEFT JOIN v_fwd1h b ON b.ticker = s.ticker
  AND b.ts = (SELECT min(x.ts) FROM v_bar1h x WHERE x.ticker = s.ticker AND x.ts > s.ts)""",
    "v_daily": """
SELECT ticker, CAST(ts AS DATE) AS date, round(avg(score), 10) AS score, max(ts) AS ts FROM v_signal GROUP BY 1, 2""",
    "v_dayret": """
SELECT d.ticker, d.date, d.score, d.ts, b.ts AS entry_ts, b.forward_return
FROM v_daily d LEFT JOIN v_fwd1d b ON b.ticker = d.ticker
  AND b.ts = (SELECT min(x.ts) FROM v_bar1d x WHERE x.ticker = d.ticker AND x.ts > d.ts)""",
    "v_ranked": """
SELECT *, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE
    AS score_rank,
  rank() OVER (PARTITION BY date ORDER BY forward_return)
    + (count(*) OVER (PARTITION BY date, forward_return) - 1) / 2.0::DOUBLE AS return_rank,
  count(*) OVER (PARTITION BY date) AS names
FROM v_dayret WHERE score IS NOT NULL AND forward_return IS NOT NULL""",
    "v_sigs": f"""
SELECT id, published_at, CAST(sum(CASE WHEN 2 * ones > n THEN (1::BIGINT << CAST(bit AS INTEGER)) ELSE 0 END) AS BIGINT) AS sig
FROM (SELECT id, published_at, bit, count(*) AS n, sum((h >> CAST(bit AS INTEGER)) & 1) AS ones
  FROM (SELECT id, published_at, {word_hash('word')} AS h FROM (SELECT id, published_at,
      unnest([x FOR x IN regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{Nd}}]+') IF x <> '']) AS word FROM v_article)) hashed
  CROSS JOIN range(0, 60) r(bit)
  GROUP BY id, published_at, bit)
GROUP BY id, published_at""",
}
