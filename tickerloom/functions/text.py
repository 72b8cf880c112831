"""URL and text normalisation as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.binding import let
from tickerloom.params import UTM_PARAMS

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_AFTER_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"
URL_PATTERN = r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+"


def _decode_query(part: Column) -> Column:
    """Percent-decode one query field; a stray percent sign stays as it is."""
    return F.url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_url(url: Column) -> Column:
    """Drop the fragment, campaign parameters and blank parameters; keep the first of a repeated key."""
    lowered = F.concat(F.lower(F.regexp_extract(url, _SCHEME, 0)), F.regexp_replace(url, _SCHEME, ""))
    whole = F.regexp_replace(lowered, r"(?s)#.*$", "")
    base = F.substring_index(whole, "?", 1)
    query = F.substr(whole, F.length(base) + F.lit(2))
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    fields = F.transform(
        pairs,
        lambda p: F.struct(
            _decode_query(F.substring_index(p, "=", 1)).alias("k"),
            _decode_query(F.regexp_replace(p, "^[^=]*=", "")).alias("v"),
        ),
    )

    def first_of_each(fs: Column) -> Column:
        return F.filter(fs, lambda f, i: (F.array_position(fs["k"], f["k"]) == i + 1) & ~f["k"].isin(UTM_PARAMS))

    kept = let(fields, first_of_each)
    text = F.array_join(F.transform(kept, lambda f: F.concat(f["k"], F.lit("="), f["v"])), "&")
    return F.when(text == "", base).otherwise(F.concat(base, F.lit("?"), text))


def url_host(url: Column) -> Column:
    """Lower-cased authority, with user-info and port when present."""
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def validated_url(url: Column) -> Column:
    """The string form of a validated URL: lower-case scheme and host, no default port, never an empty path."""
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 0))
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    user = F.regexp_extract(authority, "^.*@", 0)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    host = (
        F.when(scheme == "https:", F.regexp_replace(host, ":443$", ""))
        .when(scheme == "http:", F.regexp_replace(host, ":80$", ""))
        .otherwise(host)
    )
    rest = F.regexp_replace(url, _AFTER_AUTHORITY, "")
    path = F.when(rest.rlike("^/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.rlike(_AUTHORITY), F.concat(scheme, F.lit("//"), user, host, path)).otherwise(url)


# What html.unescape takes for a character reference.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape(references: pd.Series) -> pd.Series:
    return references.map(lambda own: [html.unescape(r) for r in own], na_action="ignore")


def unescape_html(text: Column) -> Column:
    """Spark has no entity decoder; only the references themselves go to Python, and the text around them stays."""
    some = F.instr(text, "&") > 0
    decoded = _unescape(F.when(some, F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))))
    pieces = F.zip_with(F.split(text, _REFERENCE, -1), F.concat(decoded, F.array(F.lit(""))), lambda gap, own: F.concat(gap, own))
    return F.coalesce(F.when(some, F.array_join(pieces, "")), text)


def strip_markup(text: Column) -> Column:
    """Remove tags, collapse every kind of white space, trim; empty becomes null."""
    bare = F.regexp_replace(text, "<[^>]+>", "")
    flat = F.trim(F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.nullif(flat, F.lit(""))


def clean_text(text: Column) -> Column:
    """Entities first and tags second, so an escaped tag goes too."""
    return strip_markup(unescape_html(text))


def article_hash(title: Column, clean_title: Column, url: Column) -> Column:
    """Digest of clean title and host; empty when either input is empty."""
    digest = F.sha1(F.concat(F.coalesce(clean_title, F.lit("")), F.lit(":"), url_host(url)))
    missing = (F.coalesce(title, F.lit("")) == "") | (F.coalesce(url, F.lit("")) == "")
    return F.when(missing, F.lit("")).otherwise(digest)


def words(text: Column) -> Column:
    """Lower-case alphanumeric words, accents included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def excerpt(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def title_and_lead(title: Column, text: Column, n: int) -> Column:
    return F.concat_ws(" ", title, F.substring(text, 1, n))
