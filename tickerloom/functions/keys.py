"""Identifiers and ticker predicates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.params import TICKER_PATTERN


def word_hash(word: Column) -> Column:
    return F.conv(F.substring(F.sha1(word), 1, 15), 16, 10).cast("bigint")


def stable_id(*cols: Column) -> Column:
    """A non-negative 63-bit id from the key columns: the same key gets the same id on every run.

    ``validate.ambiguous_ids`` finds ids that two keys share.
    """
    signed = F.conv(F.substring(F.sha1(F.concat_ws("|", *cols)), 1, 16), 16, -10).cast("bigint")
    return F.shiftrightunsigned(signed, 1)


def letters(col: Column) -> Column:
    """Spell a number with letters, since a ticker may hold no digit."""
    return F.translate(col.cast("string"), "0123456789", "ABCDEFGHIJ")


def ticker_ok(col: Column) -> Column:
    return F.coalesce(col.rlike(TICKER_PATTERN), F.lit(False))


def time_then_id(ts: Column, row_id: Column) -> Column:
    """Time and a non-negative id as one number that orders like the pair.

    A number lets Spark keep first and last values in a hash aggregation; ordering by a struct would make it
    sort the rows first.
    """
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    return micros * F.lit(Decimal(10**19)) + row_id.cast("decimal(19,0)")
