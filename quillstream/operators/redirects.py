"""Redirects over a table of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..session import cut

# Statuses that redirect, and headers that another origin must
# not see.
REDIRECTS = (300, 301, 302, 303, 307, 308)
SENSITIVE = ("authorization", "cookie", "cookie2", "proxy-authorization", "x-api-key")


def is_redirect(status: Column, location: Column) -> Column:
    return status.isin(*REDIRECTS) & (F.trim(location) != "")


def header(headers: Column, name: str) -> Column:
    """A header whatever its case; the first of several spellings."""
    hits = F.filter(F.map_entries(headers), lambda h: F.lower(h["key"]) == name)
    return F.get(hits, F.lit(0))["value"]


def merge_headers(defaults: Column, given: Column) -> Column:
    """Headers in lower case, those given before the defaults; of several
    spellings of one the first."""
    def low(m: Column) -> Column:
        entries = F.transform(F.map_entries(m), lambda h: F.struct(F.lower(h["key"]).alias("key"), h["value"].alias("value")))
        keys = F.transform(entries, lambda h: h["key"])
        return F.filter(entries, lambda h, i: F.array_position(keys, h["key"]) == i + 1)

    mine = low(given)
    rest = F.filter(low(defaults), lambda h: ~F.exists(mine, lambda g: g["key"] == h["key"]))
    return F.map_from_entries(F.concat(rest, mine))


def strip_sensitive(headers: Column, a: Column, b: Column) -> Column:
    """Headers that may go from ``a`` to ``b``: all within an origin, none
    that tell who asks beyond it."""
    kept = F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*SENSITIVE))
    return F.when(urls.same_origin(a, b), headers).otherwise(kept)


def follow(requests: DataFrame, edges: DataFrame, max_redirects: int = 5, url_col: str = "url") -> DataFrame:
    """Follows ``url_col`` of ``requests`` over ``edges`` (``from_url``,
    ``status``, ``location``): ``final_url``, ``hops`` (array of from, to,
    status, location) and ``failure``.

    Each round joins the chains still open with the next response. Bounds are
    tried in order: no redirect ends the chain; ``redirectLimit`` if none is
    allowed; ``invalidRedirect``; ``redirectLoop``; ``redirectLimit``; then the
    hop counts. There are ``max_redirects + 1`` rounds at most. Edge cases: a
    null URL ends at once; a URL without a response ends there; URLs are met by
    their normalised form, so that case of the host, a default port or a
    fragment hide no response; of several
    responses of a URL one with a redirect counts first, then the least
    location; repeated requests come out each; columns are kept.
    """
    loc = F.col("location")
    met = edges.withColumn("from_url", urls.normalize_for_request(F.col("from_url")))
    one = met.filter("from_url is not null").groupBy("from_url").agg(F.min(F.struct((~F.coalesce(is_redirect(F.col("status"), loc), F.lit(False))).alias("o"), loc.alias("location"), F.col("status").alias("status"))).alias("_e"))
    one = one.select(F.col("from_url").alias("_from"), "_e.status", "_e.location").filter(is_redirect(F.col("status"), loc)).withColumnRenamed("status", "_status").withColumnRenamed("location", "_location")
    hop = "array<struct<from_url: string, to_url: string, status: int, location: string>>"
    state = requests.withColumn("_at", F.col(url_col)).withColumn("hops", F.array().cast(hop)).withColumn("failure", F.lit(None).cast("string")).withColumn("_open", F.col(url_col).isNotNull())
    kept = [*requests.columns, "_at", "hops", "failure", "_open"]
    for _ in range(max_redirects + 1):
        asked = state.withColumn("_norm", F.when(F.col("_open"), urls.normalize_for_request(F.col("_at"))))
        joined = asked.join(one, F.col("_norm") == F.col("_from"), "left")
        to = urls.resolve(F.col("_at"), F.col("_location"))
        bare = urls.remove_fragment(to)
        seen = F.exists("hops", lambda h: urls.remove_fragment(h["from_url"]) == bare) | (urls.remove_fragment(F.col("_at")) == bare)
        why = (
            F.when(F.lit(max_redirects <= 0), "redirectLimit").when(to.isNull(), "invalidRedirect").when(seen, "redirectLoop")
            .when(F.size("hops") >= max_redirects, "redirectLimit")
        )
        goes = F.col("_open") & F.col("_from").isNotNull()
        stepped = joined.withColumn("_why", F.when(goes, why)).withColumn("_to", F.when(goes & F.col("_why").isNull(), to))
        state = stepped.select(
            *requests.columns, F.coalesce("_to", "_at").alias("_at"),
            F.when(F.col("_to").isNotNull(), F.concat("hops", F.array(F.struct(F.col("_at").alias("from_url"), F.col("_to").alias("to_url"), F.col("_status").cast("int").alias("status"), F.col("_location").alias("location"))))).otherwise(F.col("hops")).alias("hops"),
            F.coalesce("failure", "_why").alias("failure"), F.col("_to").isNotNull().alias("_open"),
        ).select(*kept)
    return state.withColumnRenamed("_at", "final_url").drop("_open")


def optimize(requests: DataFrame, edges: DataFrame, raw_col: str = "url", max_redirects: int = 5) -> DataFrame:
    """Loosely typed URLs to where they lead: ``input_url``, ``final_url``,
    ``n_hops``, ``error``. Input that is no URL leads to ``about:blank``."""
    parsed = requests.withColumn("_url", urls.parse_loose(F.col(raw_col)))
    # Each URL is followed once; skewed inputs meet their result by join.
    distinct = cut(parsed.filter("_url is not null").select("_url").distinct())
    done = follow(distinct, edges, max_redirects, "_url").select("_url", "final_url", F.size("hops").alias("n_hops"), "failure")
    joined = parsed.join(done, "_url", "left")
    return joined.select(*requests.columns, F.coalesce("final_url", F.lit("about:blank")).alias("final_url"), F.coalesce("n_hops", F.lit(0)).alias("n_hops"), F.when(F.col("_url").isNull(), "invalidUrl").otherwise(F.col("failure")).alias("error"))
