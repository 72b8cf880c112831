"""Declared schemas of the domain frames; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
TS, DATE = T.TimestampType(), T.DateType()

# Landed raw items keep timestamps as text so that a bad one is quarantined, not lost.
RAW_LANDED = _struct(
    ("source", S), ("source_id", S), ("url", S), ("published_at", S), ("retrieved_at", S),
    ("title", S), ("text", S), ("lang", S), ("license", S), ("author", S),
    ("meta", T.MapType(S, S)), ("_corrupt", S),
)

RAW_ITEM = _struct(
    ("source", S), ("source_id", S), ("url", S), ("published_at", TS), ("retrieved_at", TS),
    ("title", S), ("text", S), ("lang", S), ("license", S), ("author", S), ("meta", T.MapType(S, S)),
)

ARTICLE = _struct(
    ("id", L), ("source", S), ("url", S), ("url_canonical", S), ("published_at", TS), ("retrieved_at", TS),
    ("title", S), ("text", S), ("lang", S), ("hash", S), ("credibility", D),
)

LINK = _struct(
    ("article_id", L), ("ticker", S), ("confidence", D), ("method", S), ("matched_terms", T.ArrayType(S)),
)

TICKER = _struct(
    ("symbol", S), ("name", S), ("exchange", S), ("cik", S), ("aliases", T.ArrayType(S)),
    ("valid_from", DATE), ("valid_to", DATE),
)

TICKER_CSV = _struct(("symbol", S), ("name", S), ("aliases", S))

PRICE_BAR = _struct(
    ("ticker", S), ("ts", TS), ("o", D), ("h", D), ("l", D), ("c", D), ("v", L), ("timeframe", S),
)

SIGNAL = _struct(
    ("id", L), ("ticker", S), ("ts", TS), ("sentiment", D), ("novelty", D), ("velocity", D),
    ("score", D), ("event_tags", T.ArrayType(S)),
)

EMBEDDING = _struct(
    ("article_id", L), ("embedding", T.ArrayType(T.FloatType())), ("model", S), ("dims", I),
)

CONTRIB = _struct(("signal_id", L), ("article_id", L), ("rank", I), ("weight", D))
