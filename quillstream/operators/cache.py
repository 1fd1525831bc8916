"""Results kept as a keyed table with lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lifetime of entries that name none, four hours, and entries kept at most.
DEFAULT_TTL_MS, MAX_ENTRIES = 14_400_000, 500


def expires_at(kind: Column, created: Column, duration: Column, default_ttl_ms: int = DEFAULT_TTL_MS) -> Column:
    """Millisecond after which an entry is expired; null if never. A default
    of zero or less is none; so is a lifetime of zero or less that an entry
    names, which then takes the default."""
    default = F.when(F.lit(default_ttl_ms) > 0, created + default_ttl_ms)
    own = (kind == "expiresAfter") & (duration > 0)
    return F.when(kind == "neverExpires", None).when(own, created + duration).otherwise(default)


def is_expired(now: Column, default_ttl_ms: int = DEFAULT_TTL_MS) -> Column:
    at = expires_at(F.col("lifetime_kind"), F.col("created_at_ms"), F.col("duration_ms"), default_ttl_ms)
    return F.coalesce(now > at, F.lit(False))


def prefixed(key: Column, prefix: str) -> Column:
    return F.when(key.startswith(prefix), key).otherwise(F.concat(F.lit(prefix), key))


def read(requests: DataFrame, entries: DataFrame, now_ms: int, ttl_ms: int = 0, default_ttl_ms: int = DEFAULT_TTL_MS, payload_kind: str | None = None) -> DataFrame:
    """``requests`` (``cache_key``) with the ``payload`` of a valid entry and
    ``hit``: not expired by its own lifetime nor by the reader's, and of the
    kind that is asked for."""
    live = entries.filter(~is_expired(F.lit(now_ms), default_ttl_ms))
    if ttl_ms > 0:
        live = live.filter(F.lit(now_ms) <= F.col("created_at_ms") + ttl_ms)
    if payload_kind:
        live = live.filter(F.col("kind") == payload_kind)
    one = live.groupBy("cache_key").agg(F.max_by("payload", "created_at_ms").alias("payload"))
    return requests.join(one, "cache_key", "left").withColumn("hit", F.col("payload").isNotNull())


def misses(requests: DataFrame, entries: DataFrame, now_ms: int, ttl_ms: int = 0, default_ttl_ms: int = DEFAULT_TTL_MS) -> DataFrame:
    live = entries.filter(~is_expired(F.lit(now_ms), default_ttl_ms))
    if ttl_ms > 0:
        live = live.filter(F.lit(now_ms) <= F.col("created_at_ms") + ttl_ms)
    return requests.join(live.select("cache_key").distinct(), "cache_key", "left_anti")


def write(entries: DataFrame, fresh: DataFrame, now_ms: int, default_ttl_ms: int = DEFAULT_TTL_MS) -> DataFrame:
    """Entries after writing: a key's new entry replaces the old; one that is
    expired already isn't written."""
    valid = fresh.filter(~is_expired(F.lit(now_ms), default_ttl_ms)).withColumn("last_access_ms", F.lit(now_ms).cast("bigint"))
    newest = Window.partitionBy("cache_key").orderBy(F.col("created_at_ms").desc(), F.xxhash64("payload"))
    one = valid.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n").select(*entries.columns)
    return entries.join(one.select("cache_key"), "cache_key", "left_anti").select(*entries.columns).unionByName(one)


def purge(entries: DataFrame, now_ms: int, default_ttl_ms: int = DEFAULT_TTL_MS, prefix: str = "") -> DataFrame:
    """Entries that stay: those of another prefix, and of this one those that
    are neither expired nor unreadable."""
    mine = F.col("cache_key").startswith(prefix)
    sound = F.col("payload").isNotNull() & F.try_parse_json("payload").isNotNull()
    return entries.filter(~mine | (~is_expired(F.lit(now_ms), default_ttl_ms) & sound))


def evict(entries: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The entries used last; zero or less keeps none. The order is total, so
    the bound is taken by a top-k and not in one window."""
    if max_entries <= 0:
        return entries.limit(0)
    return entries.orderBy(F.col("last_access_ms").desc_nulls_last(), F.col("cache_key")).limit(max_entries)
