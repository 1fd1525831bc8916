"""Texts, keywords, numbers and dates of metadata as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let

def clean(text: Column) -> Column:
    """Without NUL, runs of any blanks as one, trimmed; null if nothing is
    left."""
    return F.nullif(F.trim(F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), r"(?U)\s+", " ")), F.lit(""))


def split_keywords(text: Column, pattern: str = "[;,]") -> Column:
    """Parts of a list, cleaned, of those that differ in case only the first."""
    parts = F.array_compact(F.transform(F.split(text, pattern), clean))
    return F.filter(parts, lambda p, i: F.array_position(F.transform(parts, F.lower), F.lower(p)) == i + 1)


def rel_tokens(rel: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(rel), r"(?U)\s+"), lambda t: t != ""))


def length_prefixed(text: Column) -> Column:
    """A part of a signature that can't run into the next."""
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def lenient_int(text: Column) -> Column:
    """An integer as the lenient readers take it: with a sign, in hexadecimal,
    or as a number with a fraction, which is cut."""
    t = F.trim(text)
    hexed = F.conv(F.regexp_extract(t, r"^[-+]?0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("bigint")
    sign = F.when(t.startswith("-"), -1).otherwise(1)
    return F.when(t.rlike(r"^[-+]?0[xX][0-9a-fA-F]+$"), sign * hexed).otherwise(F.coalesce(t.try_cast("bigint"), t.try_cast("double").try_cast("bigint")))


def iso_instant(text: Column) -> Column:
    """An ISO date or time; without a zone, UTC. Compact dates too."""
    compact = r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})?)?(Z|[-+]\d{2}:?\d{2})?$"

    def read(t: Column) -> Column:
        spread = F.regexp_replace(t, compact, "$1-$2-$3T$4:$5:$6$7")
        spread = F.regexp_replace(F.regexp_replace(spread, r"T::", "T00:00:00"), r":(Z|[-+]|$)", ":00$1")
        plain = F.when(t.rlike(compact), spread).otherwise(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"))
        return F.regexp_replace(F.regexp_replace(plain, r"([-+]\d{2})(\d{2})$", "$1:$2"), ",", ".")

    form = r"^[-+]?\d{4,6}-\d{2}-\d{2}(?:T\d{2}(?::\d{2}(?::\d{2}(?:[.]\d{1,9})?)?)?(?:Z|[-+]\d{2}(?::\d{2})?)?)?$"
    return let(let(F.trim(text), read), lambda z: F.when(z.rlike(form), z.try_cast("timestamp")))


def meta_date(text: Column) -> Column:
    """A time out of a meta element: thirteen and more digits are
    milliseconds, ten are seconds, anything else is read as ISO."""
    read = lambda t: F.when(t.rlike(r"^\d{13,}$"), F.timestamp_millis(t.try_cast("bigint"))).when(t.rlike(r"^\d{10}$"), F.timestamp_seconds(t.try_cast("bigint"))).otherwise(iso_instant(t))
    return let(F.trim(text), read)


def graph_date(text: Column, is_string: Column) -> Column:
    """A time out of linked data: strings as ISO; numbers of 1e12 and more
    are milliseconds, of 1e9 and more seconds."""
    n = text.try_cast("bigint")
    return F.when(is_string, iso_instant(text)).when(n >= 10**12, F.timestamp_millis(n)).when(n >= 10**9, F.timestamp_seconds(n))
