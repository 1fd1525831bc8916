"""Ranking of candidates, winners, collections, provenance and decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALARS = ("canonicalUrl", "title", "description", "siteName", "locale", "author", "publishedAt", "modifiedAt", "kind", "structuredData")
# How many items of a collection are kept.
LIMITS = {"images": 10, "icons": 10, "videos": 5, "audios": 5, "keywords": 25}
MERGED = ("width", "height", "mime_type", "alt", "byte_size")

Policy = Callable[[], list[Column]]


def by_score() -> list[Column]:
    """Score, then order of appearance."""
    return [F.col("score").desc(), F.col("original_index").asc()]


def with_index(candidates: DataFrame) -> DataFrame:
    """Exact repetitions once, numbered by field in order of appearance."""
    order = Window.partitionBy("doc_id", "field_name").orderBy("stage_ord", "seq", "source", "score", "evidence", "candidate_value", *[f"item.{f}" for f in ("url", *MERGED)])
    return candidates.distinct().withColumn("original_index", F.row_number().over(order) - 1)


def rank(candidates: DataFrame, policy: Policy = by_score) -> DataFrame:
    """``rank`` of each candidate in its document and field, from 1; scores
    that are no finite numbers drop out. Null scores do as well."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return candidates.filter(finite).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "field_name").orderBy(*policy())))


def winners(ranked: DataFrame) -> DataFrame:
    """The best candidate of each scalar field, one row for each document."""
    best = ranked.filter((F.col("rank") == 1) & F.col("field_name").isin(*SCALARS))
    return best.groupBy("doc_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("candidate_value"))).alias(f) for f in SCALARS])


def provenance(ranked: DataFrame) -> DataFrame:
    """Where each scalar winner is from; a kind of ``unknown`` has none."""
    best = ranked.filter((F.col("rank") == 1) & F.col("field_name").isin(*SCALARS) & ~((F.col("field_name") == "kind") & (F.col("candidate_value") == "unknown")))
    return best.select("doc_id", "field_name", "source", "score", "evidence")


def item_key(c: Column = None) -> Column:
    return F.when(F.col("field_name") == "keywords", F.lower(F.trim("candidate_value"))).otherwise(F.col("item.url"))


def collections(ranked: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Items of the collections: of candidates with one key the first counts
    and the later ones fill what it leaves open, also where the limit is
    reached by other keys. A limit of zero or less keeps nothing."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    keyed = ranked.filter(F.col("field_name").isin(*limits)).withColumn("key", item_key()).filter("key is not null and key <> ''")
    first = F.min("rank").over(Window.partitionBy("doc_id", "field_name", "key"))
    placed = keyed.withColumn("first_rank", first).withColumn("place", F.dense_rank().over(Window.partitionBy("doc_id", "field_name").orderBy("first_rank")))
    kept = placed.filter(F.col("place") <= F.element_at(limit, F.col("field_name")))
    filled = lambda a: F.min_by(F.col(f"item.{a}"), F.when(F.col(f"item.{a}").isNotNull(), F.col("rank"))).alias(a)
    return kept.groupBy("doc_id", "field_name", "key", "place").agg(F.min_by("candidate_value", "rank").alias("candidate_value"), F.min_by("item.url", "rank").alias("url"), *[filled(a) for a in MERGED])


def contributors(ranked: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Candidates of the kept items with ``contributes``: whether one is the
    first of its key or fills an attribute that was open."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    keyed = ranked.filter(F.col("field_name").isin(*limits)).withColumn("key", item_key()).filter("key is not null and key <> ''")
    key = Window.partitionBy("doc_id", "field_name", "key")
    before = key.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("first_rank", F.min("rank").over(key)).withColumn("place", F.dense_rank().over(Window.partitionBy("doc_id", "field_name").orderBy("first_rank")))
    fills = F.lit(False)
    for a in MERGED:
        fills = fills | (F.col(f"item.{a}").isNotNull() & ~F.coalesce(F.max(F.col(f"item.{a}").isNotNull()).over(before), F.lit(False)))
    opens = F.col("rank") == F.col("first_rank")
    kept = F.col("place") <= F.element_at(limit, F.col("field_name"))
    return placed.withColumn("contributes", kept & (opens | (fills & (F.col("field_name") != "keywords"))))


def decisions(ranked: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Every ranked candidate with ``selected``: the winner of a scalar field,
    any contributor of a collection."""
    cols = ["doc_id", "field_name", "rank", "source", "score", "evidence"]
    scalar = ranked.filter(~F.col("field_name").isin(*limits)).select(*cols, F.col("candidate_value").alias("value_key"), (F.col("rank") == 1).alias("selected"))
    several = contributors(ranked, limits).select(*cols, F.col("key").alias("value_key"), F.col("contributes").alias("selected"))
    return scalar.unionByName(several)
