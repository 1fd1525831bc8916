"""URLs to metadata: validation, coalescing, cache, redirects, checks, parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import cache, redirects
from ..operators.enrich import enrich
from ..sources import charset
from .parse import Options, assemble, candidates_of, graph_warnings, read_warnings, status_of, terminal_check


def extract_batch(requests: DataFrame, responses: DataFrame, entries: DataFrame | None = None, now_ms: int = 0, options: Options = Options(), url_col: str = "url", position_col: str = "input_pos", remote: DataFrame | None = None) -> DataFrame:
    """One row for each request, keyed by ``position_col``: the metadata,
    ``error_code``, ``retryable``, ``from_cache``, ``warnings``, ``status``.

    Requests of one normalised URL are computed once and joined back; hits of
    the cache aren't computed at all. Rows of failed requests carry their error
    and no metadata: one bad URL spoils nothing else. A body beyond the limit
    is cut and the result partial. ``warnings`` (code, message) stand in the order
    of the steps: body, charset, linked data, enrichment. ``remote`` (``url``,
    ``status``, ``text``) holds oEmbed and manifest documents to enrich pages by.
    """
    parsed = requests.select(position_col, F.col(url_col).alias("original_url"), urls.parse_loose(F.col(url_col)).alias("_url"))
    keyed = parsed.withColumn("cache_key", urls.cache_key(F.col("_url")))
    distinct = keyed.filter("_url is not null").select("_url", "cache_key").distinct()
    if entries is not None:
        looked = cache.read(distinct, entries, now_ms)
        hits, todo = looked.filter("hit"), looked.filter("not hit").select("_url", "cache_key")
    else:
        hits, todo = None, distinct
    edges = responses.select(F.col("url").alias("from_url"), "status", redirects.header(F.coalesce("headers", F.create_map().cast("map<string,string>")), "location").alias("location"))
    chains = redirects.follow(todo, edges, url_col="_url")
    one = responses.withColumn("_norm", urls.normalize_for_request(F.col("url"))).groupBy("_norm").agg(F.min_by(F.struct("status", "headers", "body", "error"), F.struct(F.col("error").isNotNull(), F.xxhash64("body"))).alias("_r"))
    fetched = chains.join(one, urls.normalize_for_request(F.col("final_url")) == F.col("_norm"), "left").select("_url", "cache_key", "final_url", "failure", "_r.*")
    checked = terminal_check(fetched.withColumn("error", F.when(F.col("status").isNull() & F.col("error").isNull(), "no response").otherwise(F.col("error"))))
    checked = checked.withColumn("error_code", F.coalesce("failure", "error_code"))
    kind = redirects.header(F.coalesce("headers", F.create_map().cast("map<string,string>")), "content-type")
    limit = max(options.max_bytes, 0)
    sound = F.col("error_code").isNull()
    cut = checked.withColumn("truncated", sound & F.lit(limit > 0) & (F.octet_length("body") > limit)).withColumn("_d", charset.decode_body(F.when(sound, F.substring("body", F.lit(1), F.lit(limit))), kind))
    pages = cut.withColumn("html", F.col("_d.text")).withColumn("charset_source", F.when(sound & F.col("body").isNotNull(), F.col("_d.charset_source"))).drop("_d", "body")
    found = candidates_of(pages, "html", "final_url", options)
    found = enrich(found, remote) if remote is not None else found.withColumn("enrich_warnings", F.array().cast("array<struct<code: string, message: string>>"))
    made = assemble(found, options)
    errors = F.filter(F.array("error_code"), lambda e: e.isNotNull())
    none = F.array().cast("array<struct<code: string, message: string>>")
    told = F.concat(read_warnings(F.coalesce("truncated", F.lit(False)), F.coalesce("charset_source", F.lit(""))), graph_warnings(F.col("graph")), F.col("enrich_warnings"))
    made = made.withColumn("warnings", F.when(F.col("error_code").isNull(), told).otherwise(none)).withColumn("status", status_of(errors, F.col("warnings")))
    cols = ["title", "description", "site_name", "locale", "canonical_url", "kind", "final_url", "error_code", "retryable", "warnings", "status"]
    computed = made.select("_url", *cols, F.lit(False).alias("from_cache"))
    if hits is not None:
        stored = hits.select("_url", *[F.get_json_object("payload", f"$.{c}").alias(c) if c not in ("error_code", "retryable", "status", "final_url", "warnings") else F.lit(None).cast(computed.schema[c].dataType).alias(c) for c in cols], F.lit(True).alias("from_cache"))
        computed = computed.unionByName(stored.withColumn("status", F.lit("success")).select(*computed.columns))
    joined = keyed.join(computed, "_url", "left")
    bad = F.col("_url").isNull()
    return joined.select(position_col, "original_url", *[F.col(c) for c in cols if c not in ("error_code", "status", "final_url")], F.when(bad, "about:blank").otherwise(F.coalesce("final_url", "_url")).alias("final_url"), F.when(bad, "invalidUrl").otherwise(F.col("error_code")).alias("error_code"), F.when(bad, "failure").otherwise(F.col("status")).alias("status"), F.coalesce("from_cache", F.lit(False)).alias("from_cache"))
