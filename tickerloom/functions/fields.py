"""Small field functions: credibility, timestamps, JSON, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.params import CREDIBILITY_BASE, CREDIBILITY_BONUS, CREDIBILITY_OTHER

_ISO = "yyyy-MM-dd'T'HH:mm:ssxxx"
_ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def credibility(source: Column, author: Column, licence: Column, url: Column) -> Column:
    base = F.lit(CREDIBILITY_OTHER)
    for name, value in CREDIBILITY_BASE.items():
        base = F.when(source == name, F.lit(value)).otherwise(base)

    def bonus(name: str, present: Column) -> Column:
        return F.when(F.coalesce(present, F.lit(False)), F.lit(CREDIBILITY_BONUS[name])).otherwise(F.lit(0.0))

    total = (
        base
        + bonus("author", F.length(author) > 0)
        + bonus("license", F.length(licence) > 0)
        + bonus("https", url.startswith("https://"))
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def iso_from_timestamp(ts: Column) -> Column:
    """ISO text with a numeric offset; microseconds appear only when they are not zero."""
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, F.date_format(ts, _ISO)).otherwise(F.date_format(ts, _ISO_MICROS))


def iso_from_text(text: Column) -> Column:
    """Re-emit ISO text, keeping its own offset; text that is no timestamp comes back unchanged."""
    ts = F.try_to_timestamp(F.regexp_replace(text, "Z", "+00:00"))
    body = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{6})?)", 1)
    offset = F.regexp_replace(F.regexp_extract(text, r"(Z|[+-]\d{2}:\d{2})$", 1), "Z", "+00:00")
    kept = F.concat(F.regexp_replace(body, " ", "T"), F.when(F.length(text) > 10, offset).otherwise(F.lit("")))
    return F.when(ts.isNotNull() & (body != ""), kept).otherwise(text)


def iso_from_epoch(seconds: Column) -> Column:
    return iso_from_timestamp(F.timestamp_micros((seconds * 1000000).cast("bigint")))


def as_utc(text: Column) -> Column:
    """Parse text with an offset to an instant; text without one is read as UTC (the session zone)."""
    return F.try_to_timestamp(text)


def has_offset(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def json_object(text: Column) -> Column:
    """Variant of a JSON object; null for arrays, scalars and text that does not parse."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def listed_values(text: Column, field: str) -> Column:
    """The string list in one field of a JSON object, such as stored aliases or terms; empty when absent."""
    parsed = F.from_json(text, f"{field} array<string>")
    return F.coalesce(parsed[field], F.array().cast("array<string>"))


def drop_null_values(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def change_pct(first: Column, last: Column) -> Column:
    return F.when(first == 0, F.lit(0.0)).otherwise((last - first) / first * 100)
