"""Pages and responses to metadata with provenance, warnings and status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import stages
from ..operators.ranking import LIMITS, SCALARS
from ..operators.redirects import header
from ..sources import charset, html, linked_data

# Warnings that make a result partial.
PARTIAL = ("redirectedTooMuch", "truncatedHtml", "oembedFailed", "manifestFailed", "partialParse")


@dataclass(frozen=True)
class Options:
    """What is extracted. ``skip`` names stages; limits are by collection."""

    skip: frozenset[str] = frozenset()
    limits: tuple[tuple[str, int], ...] = tuple(LIMITS.items())
    raw: bool = False
    max_bytes: int = 524_288


def candidates_of(df: DataFrame, html_col: str = "html", url_col: str = "url", options: Options = Options()) -> DataFrame:
    """``df`` with ``elements``, ``base_url``, ``graph`` and ``candidates``
    (array in order of appearance): one tokenizer pass and no exchange."""
    read, legs = _read(df, html_col, url_col, options)
    # The generator keeps the stages from being planned once for each field.
    return read.select("*", F.explode(F.array(stages.candidates(legs))).alias("candidates"))


def _read(df: DataFrame, html_col: str, url_col: str, options: Options) -> tuple[DataFrame, list[stages.Leg]]:
    """``df`` with ``elements``, ``base_url`` and ``graph``, and the legs of
    the stages over them."""
    e = df.withColumn("elements", html.html_elements(F.col(html_col)))
    b = e.withColumn("base_url", html.base_url(F.col("elements"), F.col(url_col)))
    g = b.withColumn("graph", linked_data.graph_of(F.col("elements")))
    graph = None if "jsonLd" in options.skip else F.col("graph")
    return g, stages.all_legs(F.col("elements"), F.col("base_url"), F.col(url_col), graph, options.skip)


def _candidates_by_field(df: DataFrame, html_col: str, url_col: str, options: Options) -> DataFrame:
    """``df`` with what ``candidates_of`` gives, but the candidates of each
    field in a column of their own (``_of_``), so that those of fields which
    the reader doesn't select are never made. Legs that tell of several fields
    stand in a column once."""
    read, legs = _read(df, html_col, url_col, options)
    shared = {i: f"_leg_{i}" for i, (names, _) in enumerate(legs) if len(names) > 1}
    out = read.select("*", *[legs[i][1].alias(name) for i, name in shared.items()])
    legs = [(names, F.col(shared[i]) if i in shared else values) for i, (names, values) in enumerate(legs)]
    fields = dict.fromkeys([*SCALARS, *dict(options.limits)])
    return out.select("*", *[stages.candidates_for(legs, f).alias(f"_of_{f}") for f in fields]).drop(*shared.values())


def _finite(candidates: Column) -> Column:
    return F.filter(candidates, lambda c: c["score"].isNotNull() & ~F.isnan(c["score"]) & (F.abs(c["score"]) < float("inf")))


def _best(mine: Column) -> Column:
    """The winner of a field: highest finite score, then first. Ties keep
    the order of the array, as a later one has to be greater."""
    return urls.let(_finite(mine), lambda m: F.aggregate(m, F.get(m, F.lit(0)), lambda acc, c: F.when(c["score"] > acc["score"], c).otherwise(acc)))


def _collection(mine: Column, field: str, limit: int) -> Column:
    """Items of a collection by rank, the first of each key, merged."""
    if limit <= 0:
        return F.array().cast("array<string>") if field == "keywords" else F.array().cast(stages.T.ArrayType(stages.ITEM))
    numbered = F.transform(_finite(mine), lambda c, i: F.struct((-c["score"]).alias("s"), i.alias("i"), c.alias("c")))
    ranked = F.transform(F.array_sort(numbered), lambda x: x["c"])

    def words(ranked: Column) -> Column:
        keys = F.transform(ranked, lambda c: F.lower(F.trim(c["candidate_value"])))
        firsts = lambda keys: F.transform(ranked, lambda c, i: F.when(F.array_position(keys, F.get(keys, i)) == i + 1, c["candidate_value"]))
        return F.slice(F.filter(urls.let(keys, firsts), lambda v: v.isNotNull()), 1, limit)

    def items(ranked: Column) -> Column:
        keys = F.slice(F.array_distinct(F.transform(ranked, lambda c: c["item"]["url"])), 1, limit)

        def merged(key: Column, same: Column) -> Column:
            known = lambda a: F.get(F.filter(F.transform(same, lambda c: c["item"][a]), lambda v: v.isNotNull()), F.lit(0))
            return stages.item(key, **{f.name: known(f.name) for f in stages.ITEM.fields if f.name != "url"})

        return F.transform(keys, lambda key: urls.let(F.filter(ranked, lambda c: c["item"]["url"] == key), lambda same: merged(key, same)))

    return urls.let(ranked, words if field == "keywords" else items)


def assemble(df: DataFrame, options: Options = Options(), by_field: bool = False) -> DataFrame:
    """Metadata columns from ``candidates``, or from columns of them by field: the
    winners, the collections, ``provenance`` (field to source and score) and
    ``is_empty``."""
    limits = dict(options.limits)
    of = lambda f: F.col(f"_of_{f}") if by_field else F.filter("candidates", lambda c: c["field_name"] == f)
    names = {"canonicalUrl": "canonical_url", "siteName": "site_name", "publishedAt": "published_at", "modifiedAt": "modified_at", "structuredData": "structured_data_key"}
    best = df.select("*", *[_best(of(f)).alias(f"_best_{f}") for f in SCALARS])
    out = best.select(
        "*", *[F.col(f"_best_{f}")["candidate_value"].alias(names.get(f, f)) for f in SCALARS if f not in ("publishedAt", "modifiedAt", "kind")],
        *[F.col(f"_best_{f}")["candidate_value"].try_cast("timestamp").alias(names[f]) for f in ("publishedAt", "modifiedAt")], F.coalesce(F.col("_best_kind")["candidate_value"], F.lit("unknown")).alias("kind"),
        *[_collection(of(f), f, limits[f]).alias(f) for f in limits],
        F.filter(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_best_{f}")["source"].alias("source"), F.col(f"_best_{f}")["score"].alias("score")) for f in SCALARS]), lambda p: p["source"].isNotNull()).alias("provenance"),
    ).drop(*[f"_best_{f}" for f in SCALARS], *[f"_of_{f}" for f in (*SCALARS, *limits) if by_field])
    return out.withColumn("is_empty", F.size("provenance") + sum((F.size(f) for f in limits), F.lit(0)) == 0)


def graph_warnings(graph: Column) -> Column:
    warn = lambda cond, why: F.when(cond, F.struct(F.lit("partialParse").alias("code"), F.lit(why).alias("message")))
    return F.array_compact(F.array(warn(graph["malformed"] > 0, "malformed JSON-LD"), warn(graph["limit_reached"], "JSON size or traversal limit")))


def read_warnings(truncated: Column, charset_source: Column) -> Column:
    """What reading the body has to tell, before anything of the page."""
    warn = lambda cond, code: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(code).alias("message")))
    return F.array_compact(F.array(warn(truncated, "truncatedHtml"), warn(charset_source.isin("fallback", "unknown"), "charsetFallback")))


def status_of(errors: Column, warnings: Column) -> Column:
    """``failure`` with errors, ``partial`` with warnings that tell of it,
    else ``success``."""
    return F.when(F.size(errors) > 0, "failure").when(F.exists(warnings, lambda w: w["code"].isin(*PARTIAL)), "partial").otherwise("success")


# Statuses of HTTP that may pass on another try.
RETRIED = (408, 425, 429)


def retryable(code: Column, status: Column, reason: Column) -> Column:
    """Whether an error may pass: network and time limits, some statuses;
    never one with a reason of its own."""
    return reason.isNull() & (code.isin("network", "timeout") | (code == "httpStatus") & (status.isin(*RETRIED) | (status >= 500)))


def parse_html(pages: DataFrame, html_col: str = "html", url_col: str = "url", options: Options = Options()) -> DataFrame:
    """Metadata of HTML texts: the other columns of ``pages``, the metadata,
    ``warnings`` and ``status``. Null or empty texts give empty metadata."""
    made = assemble(_candidates_by_field(pages, html_col, url_col, options), options, by_field=True)
    made = made.withColumn("warnings", graph_warnings(F.col("graph"))).withColumn("status", status_of(F.array(), F.col("warnings")))
    if options.raw:
        made = made.withColumn("raw", html.raw_metadata(F.col("elements")))
    return made.drop("elements", "graph")


def parse_response(responses: DataFrame, options: Options = Options()) -> DataFrame:
    """As ``parse_html`` for raw responses (``url``, ``headers``, ``body``):
    bytes beyond the limit are cut, the charset is told by mark, header or
    page, with ``charset``, ``charset_source`` and ``truncated``."""
    limit = options.max_bytes
    cut = responses.withColumn("_h", header(F.col("headers"), "content-type")).withColumn("truncated", F.lit(limit > 0) & (F.octet_length("body") > limit)).withColumn("_b", F.substring("body", F.lit(1), F.lit(max(limit, 0))))
    decoded = cut.withColumn("_d", charset.decode_body(F.col("_b"), F.col("_h")))
    pages = decoded.select(*responses.columns, "truncated", F.col("_d.text").alias("html"), F.col("_d.charset").alias("charset"), F.col("_d.charset_source").alias("charset_source"))
    made = assemble(_candidates_by_field(pages, "html", "url", options), options, by_field=True)
    first = read_warnings(F.col("truncated"), F.col("charset_source"))
    warned = made.withColumn("warnings", F.concat(first, graph_warnings(F.col("graph"))))
    return warned.withColumn("status", status_of(F.array(), F.col("warnings"))).drop("elements", "graph", "html", "_h", "_b", "_d")


def terminal_check(df: DataFrame) -> DataFrame:
    """``responses`` with ``error_code`` (null if the page is to be parsed) in
    the order of the checks: fetch error, no HTML, status; and ``retryable``."""
    kind = F.lower(header(F.col("headers"), "content-type"))
    is_html = kind.isNull() | kind.contains("text/html") | kind.contains("application/xhtml")
    failed = F.col("error").isNotNull() | F.col("status").isNull()
    reason = F.when(F.lower("error").contains("timeout") | F.lower("error").contains("timed out"), "timeout").otherwise("network")
    code = F.when(failed, reason).when(~is_html, "nonHtmlContent").when(~F.col("status").between(200, 299), "httpStatus")
    return df.withColumn("error_code", code).withColumn("retryable", F.coalesce(retryable(code, F.col("status"), F.lit(None).cast("string")), F.lit(False)))


def same_document(a: Column, b: Column) -> Column:
    return urls.compare_form(a) == urls.compare_form(b)
