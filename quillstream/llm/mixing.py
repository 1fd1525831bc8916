"""Documents of several sources mixed to target shares, along a curriculum."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Documents of a source are laid out in so many buckets, summed apart, or in as
#: many that one holds some ``BUCKET_ROWS`` of all documents.
BUCKETS, BUCKET_ROWS = 256, 50_000
#: How far the weight of a source may lean to the end (1) or the beginning (-1).
LEAN = 0.5


def token_counter(spark: SparkSession, path: str, pattern: str):
    """A column function that counts the tokens of texts by a byte-level BPE
    given as ranks (``path``, read on the driver) and its splitting pattern."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shipped = spark.sparkContext.broadcast(ranks)  # a vocabulary, of fixed size

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=shipped.value, special_tokens={})
        for batch in texts:
            yield pd.Series([None if t is None else len(encoding.encode_ordinary(t)) for t in batch], dtype="Int64")

    return count


def mix(documents: DataFrame, targets: DataFrame, counter, total_tokens: int | None = None, doc_id: str = "doc_id", text_col: str = "text", lean: float = LEAN) -> DataFrame:
    """The documents in training order: ``doc_id``, ``source``, ``pass_no``
    (0 for the first use), ``n_tokens``, ``position`` (in 0..1).

    ``targets`` has ``source``, ``target_share``, ``max_repeats``. Every source
    gets its share of ``total_tokens``; by default that of the largest total
    at which no source needs more than its repeats, so that all shares are
    met. A source's weight at time t is its share times 1 + a(2t - 1), where
    the ``a`` of the sources are spread over -lean..lean and shifted so that
    the weights always sum to 1; integrated it is the demand of the source up to
    t. A document whose tokens end at the c-th of its source stands where the
    demand reaches c, by the inverse of the integral. Sources are laid out in
    hash order and summed by bucket, then within buckets, so that no source is
    in one task; the result is sorted by range of position. A document that
    would end beyond its source's demand isn't used, so each source stays
    within a document of its share. Edge cases: null or empty texts have no
    tokens and are left out; sources without a target, or with a share or
    repeats of zero or null, are left out, and targets without documents make
    the default total 0; repeated rows count as documents of their own; other
    columns are ignored.
    """
    given = documents.select(F.col(doc_id).alias("_doc"), F.col("source").alias("_source"), counter(F.col(text_col)).alias("n_tokens"))
    counted = cut(given.filter("n_tokens > 0"))
    wanted = targets.filter("target_share > 0 and max_repeats > 0").groupBy(F.col("source").alias("_source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    buckets = max(BUCKETS, -(-counted.count() // BUCKET_ROWS))
    hashed = counted.withColumn("_h", F.xxhash64("_source", "_doc", "n_tokens")).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))

    # Bucket sums are few: sources times buckets.
    sums = hashed.groupBy("_source", "_b").agg(F.sum("n_tokens").alias("s"))
    size = wanted.join(sums.groupBy("_source").agg(F.sum("s").alias("size")), "_source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    total = F.lit(total_tokens) if total_tokens is not None else F.expr("cast(floor(min(size * repeats / share) over () + 1e-6) as bigint)")
    order = F.expr("row_number() over (order by _source) - 1")
    n = F.expr("count(*) over ()")
    raw = F.when(n > 1, F.lit(lean) * (2 * order / (n - 1) - 1)).otherwise(F.lit(0.0))
    plan = size.withColumn("a0", raw).withColumn("total", total)
    # The weights sum to 1 at all times once the leans balance by share.
    balance = F.expr("sum(a0 * share) over () / sum(share) over ()")
    plan = plan.withColumn("a", F.col("a0") - balance).withColumn("demand", F.least(F.col("total") * F.col("share"), F.col("size") * F.col("repeats")).cast("double")).select("_source", "size", "repeats", "a", "demand")
    before = sums.withColumn("before", F.expr("sum(s) over (partition by _source order by _b) - s")).drop("s")

    # Within a bucket the running sum; buckets of a hot source are many.
    within = hashed.withColumn("_in", F.expr("sum(n_tokens) over (partition by _source, _b order by _h, _doc rows unbounded preceding)"))
    placed = within.join(before, ["_source", "_b"]).join(plan, "_source").withColumn("_end", F.col("before") + F.col("_in"))
    # Only the passes that the demand reaches.
    last = F.least(F.col("repeats") - 1, F.ceil(F.col("demand") / F.greatest(F.col("size"), F.lit(1))).cast("int"))
    passes = placed.withColumn("pass_no", F.explode(F.sequence(F.lit(0), last)))
    used = passes.withColumn("_c", F.col("_end") + F.col("pass_no") * F.col("size")).filter(F.col("_c") <= F.col("demand") + 1e-6)
    # demand(t) = D (t + a t (t - 1)) is c; of the two roots the one in 0..1.
    x, a = F.col("_c") / F.col("demand"), F.col("a")
    root = F.when(F.abs(a) < 1e-12, x).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * x)) / (2 * a))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), root))  # rounding may end beyond
    timed = used.select(F.col("_doc").alias(doc_id), F.col("_source").alias("source"), "pass_no", "n_tokens", inside.alias("position"))
    return timed.repartitionByRange("position", doc_id, "pass_no").sortWithinPartitions("position", doc_id, "pass_no")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target what was reached: ``target_share``, ``share``,
    ``n_tokens``, ``n_uses``, ``most_uses`` (of one document)."""
    uses = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), (F.max("pass_no") + 1).alias("most_uses"))
    joined = targets.select("source", "target_share", "max_repeats").join(uses, "source", "left")
    return joined.withColumn("share", F.round(F.expr("coalesce(n_tokens, 0) / sum(n_tokens) over ()"), 6)).select("source", "target_share", "share", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
