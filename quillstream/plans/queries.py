"""Named queries of the core, each a function of (spark, directory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import cache, enrich, nested, ranking, redirects, stages, timestamps
from ..session import spread, table
from ..sources import charset, html, linked_data
from . import parse
from .extract import extract_batch

#: The moment that queries over the cache are asked at.
NOW_MS = 1_770_000_000_000


def _times(spark, d):
    links, sites = table(spark, d, "link_metadata"), table(spark, d, "sites")
    return timestamps.normalise_times(links, sites, ["meta_id"], ["published_at", "modified_at"])


def p1_found(spark, d):
    return timestamps.changed_times(_times(spark, d), ["meta_id"])


def p1_report(spark, d):
    """How the values of each field and outcome spread."""
    return _times(spark, d).groupBy("field_name", "status").agg(F.count("*").alias("n_values"), F.countDistinct("shape").alias("n_shapes"), F.min("utc_ms").alias("first_ms"), F.max("utc_ms").alias("last_ms"))


def p7_found(spark, d):
    return nested.flatten_objects(table(spark, d, "structured_data"), labels_only=True).select("graph_id", "path", "parent_path")


def p7_tables(spark, d):
    """The tables that nested objects fall into."""
    return nested.schema_tables(nested.flatten_objects(table(spark, d, "structured_data")))


def url_parse_loose(spark, d):
    return table(spark, d, "urls").select("input_pos", "url", urls.parse_loose(F.col("url")).alias("parsed"))


def url_cache_key(spark, d):
    parsed = table(spark, d, "urls").select("input_pos", urls.parse_loose(F.col("url")).alias("u")).filter("u is not null")
    return parsed.select("input_pos", urls.cache_key(F.col("u")).alias("cache_key"))


def url_proxy(spark, d):
    links = table(spark, d, "link_metadata")
    return links.select("meta_id", urls.apply_proxy(F.col("resolved_url"), "https://proxy.example/?u={urlEncoded}").alias("proxied"))


def url_https(spark, d):
    return table(spark, d, "link_metadata").select("meta_id", urls.ensure_https(F.col("resolved_url")).alias("url"))


def url_same_origin(spark, d):
    links = table(spark, d, "link_metadata")
    return links.filter("canonical_url is not null").select("meta_id", urls.same_origin(F.col("original_url"), F.col("canonical_url")).alias("same_origin"))


def url_resolve(spark, d):
    """Rooted paths of canonical links against the pages they are on."""
    links = table(spark, d, "link_metadata").filter("canonical_url is not null")
    rooted = F.concat(F.lit("/./x/../"), F.regexp_replace("canonical_url", "^https?://[^/]*/", ""))
    return links.select("meta_id", urls.resolve(urls.normalize_for_request(F.col("original_url")), rooted).alias("resolved"))


def request_coalescing(spark, d):
    """How many requests one normalised URL answers."""
    parsed = table(spark, d, "urls").select("input_pos", urls.parse_loose(F.col("url")).alias("request"))
    return parsed.filter("request is not null").groupBy("request").agg(F.count("*").alias("n_requests"), F.min("input_pos").alias("first_pos"))


def unsafe_targets(spark, d):
    """Addresses made of customer keys, and why they are no public targets."""
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (k * 7 % 256).cast("string"), (k * 13 % 256).cast("string"), (k % 3).cast("string"), (k % 251).cast("string"))
    return table(spark, d, "customer").select("c_custkey", ip.alias("ip"), urls.unsafe_host(ip).alias("reason"))


def rank_candidates(spark, d):
    ranked = ranking.rank(ranking.with_index(table(spark, d, "candidates")))
    return ranked.select("doc_id", "field_name", "rank", "source", "score", "candidate_value", F.col("item.url").alias("url"))


def field_winners(spark, d):
    won = ranking.winners(ranking.rank(ranking.with_index(table(spark, d, "candidates"))))
    return won.select("doc_id", "title", "description", F.col("siteName").alias("site_name"), "locale", F.col("publishedAt").alias("published_at"))


def field_provenance(spark, d):
    return ranking.provenance(ranking.rank(ranking.with_index(table(spark, d, "candidates"))))


def image_collection(spark, d):
    """At most ten images of a document, merged by URL."""
    kept = ranking.collections(ranking.rank(ranking.with_index(table(spark, d, "candidates"))))
    return kept.filter("field_name = 'images'").select("doc_id", "url", "place", "width", "height", "byte_size")


def candidate_decisions(spark, d):
    made = ranking.decisions(ranking.rank(ranking.with_index(table(spark, d, "candidates"))))
    return made.groupBy("field_name", "source", "selected").agg(F.count("*").alias("n"))


def page_metadata(spark, d):
    """Responses to metadata, through charset, tokenizer, stages and ranking."""
    made = parse.parse_response(table(spark, d, "responses").filter("body is not null"))
    return made.select("meta_id", "url", "title", "description", "locale", "canonical_url", "kind", "charset", "charset_source", "truncated", "status")


def page_candidates(spark, d):
    """Candidates of the pages by field and stage."""
    bodies = table(spark, d, "responses").filter("body is not null").select("url", charset.decode_body(F.col("body"), F.lit(None).cast("string"))["text"].alias("html"))
    made = parse.candidates_of(bodies)
    return made.select(F.explode("candidates").alias("c")).groupBy("c.field_name", "c.source").agg(F.count("*").alias("n"), F.avg("c.score").alias("avg_score"))


def raw_metadata(spark, d):
    bodies = table(spark, d, "responses").filter("body is not null").select("meta_id", charset.decode_body(F.col("body"), F.lit(None).cast("string"))["text"].alias("html"))
    raw = bodies.withColumn("e", html.html_elements(F.col("html"))).select("meta_id", html.raw_metadata(F.col("e")).alias("r"))
    return raw.select("meta_id", F.explode("r.meta").alias("key", "values")).groupBy("key").agg(F.count("*").alias("n_pages"), F.sum(F.size("values")).alias("n_values"))


def charset_decode(spark, d):
    kind = redirects.header(F.col("headers"), "content-type")
    decoded = table(spark, d, "responses").filter("body is not null").select(charset.decode_body(F.col("body"), kind).alias("x"))
    return decoded.groupBy("x.charset", "x.charset_source").agg(F.count("*").alias("n"))


def terminal_checks(spark, d):
    checked = parse.terminal_check(table(spark, d, "responses"))
    return checked.groupBy("status", F.col("error").isNotNull().alias("failed"), "error_code", "retryable").agg(F.count("*").alias("n"))


def redirect_chains(spark, d):
    """Requests of fetches followed over the redirects that were seen."""
    fetches = table(spark, d, "fetch_diagnostics").dropDuplicates(["fetch_id"])
    edges = fetches.select(F.explode("redirects").alias("r")).select(urls.normalize_for_request(F.col("r.from_url")).alias("from_url"), F.col("r.status_code").alias("status"), "r.location")
    asked = fetches.select("fetch_id", urls.normalize_for_request(F.col("requested_url")).alias("url"))
    return redirects.follow(asked, edges).select("fetch_id", "final_url", F.size("hops").alias("n_hops"), "failure")


def url_optimize(spark, d):
    fetches = table(spark, d, "fetch_diagnostics")
    edges = fetches.select(F.explode("redirects").alias("r")).select(urls.normalize_for_request(F.col("r.from_url")).alias("from_url"), F.col("r.status_code").alias("status"), "r.location")
    return redirects.optimize(table(spark, d, "urls"), edges)


def cache_valid(spark, d):
    return table(spark, d, "cache_entries").filter(~cache.is_expired(F.lit(NOW_MS))).select("cache_key", "kind", "created_at_ms")


def cache_purge(spark, d):
    return cache.purge(table(spark, d, "cache_entries"), NOW_MS, prefix="meta:").select("cache_key")


def cache_evict(spark, d):
    return cache.evict(table(spark, d, "cache_entries")).select("cache_key", "last_access_ms")


def cache_write(spark, d):
    """The cache after every page was written by its address, the newest fetch
    of an address last."""
    entries, links = table(spark, d, "cache_entries"), table(spark, d, "link_metadata")
    fresh = links.filter("resolved_url is not null and fetched_at is not null").select(
        urls.cache_key(F.col("resolved_url")).alias("cache_key"), F.lit("metadata").alias("kind"), F.unix_millis("fetched_at").alias("created_at_ms"), F.lit("neverExpires").alias("lifetime_kind"),
        F.lit(None).cast("bigint").alias("duration_ms"), F.lit(None).cast("bigint").alias("last_access_ms"), F.to_json(F.struct("title", "description")).alias("payload"),
    )
    return cache.write(entries, fresh, NOW_MS).select("cache_key", "created_at_ms")


def batch_extract(spark, d):
    """Typed URLs to metadata over the stored responses and the cache."""
    return extract_batch(table(spark, d, "urls"), table(spark, d, "responses"), table(spark, d, "cache_entries"), NOW_MS)


def oembed_json(spark, d):
    """oEmbed texts of parts, read back."""
    made = F.to_json(F.struct(F.lit("rich").alias("type"), F.col("p_name").alias("title"), F.col("p_brand").alias("provider_name"), F.col("p_size").alias("thumbnail_width"), F.concat(F.lit("/t/"), F.col("p_partkey").cast("string")).alias("thumbnail_url")))
    rec = table(spark, d, "part").select("p_partkey", enrich.oembed_json(made).alias("r"))
    return rec.select("p_partkey", text.clean(F.col("r.title")).alias("title"), F.col("r.provider_name").alias("provider"), text.lenient_int(F.col("r.thumbnail_width")).alias("width"), urls.absolute(F.lit("https://o.example/p/"), F.col("r.thumbnail_url")).alias("image"))


def oembed_xml(spark, d):
    made = F.concat(F.lit("<oembed><title>"), F.col("p_name"), F.lit("</title><deep><width>"), F.col("p_size").cast("string"), F.lit("</width></deep></oembed>"))
    rec = table(spark, d, "part").select("p_partkey", enrich.oembed_xml(made).alias("r"))
    return rec.select("p_partkey", "r.title", text.lenient_int(F.col("r.width")).alias("width"))


def manifest_json(spark, d):
    made = F.to_json(F.struct(F.col("s_name").alias("name"), F.lit("./start").alias("start_url"), F.array(F.struct(F.concat(F.lit("i/"), F.col("s_suppkey").cast("string")).alias("src"), F.lit("64x64").alias("sizes"))).alias("icons")))
    m = table(spark, d, "supplier").select("s_suppkey", enrich.manifest_json(made, F.lit("https://m.example/app/manifest.json")).alias("m"))
    return m.select("s_suppkey", "m.name", "m.start_url", F.col("m.icons")[0]["src"].alias("icon"))


def open_graph_images(spark, d):
    """Pages of parts with grouped image properties, read back."""
    key = F.col("p_partkey").cast("string")
    page = F.concat(F.lit('<meta property="og:image" content="/a/'), key, F.lit('.png"><meta property="og:image:width" content="'), F.col("p_size").cast("string"), F.lit('"><meta property="og:image:alt" content="one"><meta property="og:image" content="b/'), key, F.lit('.png"><meta property="og:image:height" content="7">'))
    parts = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    pages = parts.select("p_partkey", F.lit("https://p.example/x/y").alias("url"), page.alias("html"))
    made = parse.parse_html(pages, options=parse.Options(skip=frozenset({"jsonLd"})))
    return made.select("p_partkey", F.posexplode("images").alias("place", "i")).select("p_partkey", "place", "i.url", "i.width", "i.height", "i.alt")


def graph_articles(spark, d):
    """Pages of orders with linked data, read back."""
    key = F.col("o_orderkey").cast("string")
    node = F.concat(F.lit('{"@type":"Article","headline":"Order '), key, F.lit('","author":{"name":"'), F.col("o_orderstatus"), F.lit('"},"datePublished":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","keywords":["a","'), F.col("o_orderpriority"), F.lit('"]}'))
    page = F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("</script><title>t</title>"))
    pages = table(spark, d, "orders").select("o_orderkey", F.lit("https://p.example/x").alias("url"), page.alias("html"))
    made = parse.parse_html(pages)
    return made.select("o_orderkey", "title", "kind", "author", F.date_format("published_at", "yyyy-MM-dd").alias("published"), F.array_join("keywords", "|").alias("keywords"))


def _supplier_pages(spark, d, html):
    """A page for each supplier, made of its columns, read back."""
    return parse.parse_html(table(spark, d, "supplier").select("s_suppkey", F.lit("https://s.example/a/b").alias("url"), html.alias("html")), options=parse.Options(skip=frozenset({"jsonLd"})))


def og_fields(spark, d):
    """Open Graph before everything else of a page."""
    k, prop = F.col("s_suppkey").cast("string"), lambda p, v: F.concat(F.lit(f'<META property="og:{p}" content="'), v, F.lit('">'))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "article").when(F.col("s_suppkey") % 3 == 1, "website").otherwise("video.movie")
    page = F.concat(F.lit("<title>no</title>"), prop("title", F.concat(F.lit("  A &amp;  "), F.col("s_name"))), prop("description", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))), prop("site_name", F.col("s_name")), prop("locale", F.lit("en_US")), prop("type", kind), prop("url", F.concat(F.lit("../c/"), k, F.lit("#x"))), F.lit('<meta property="article:tag" content="one"><meta property="article:tag" content="ONE">'))
    return _supplier_pages(spark, d, page).select("s_suppkey", "title", "description", "site_name", "locale", "kind", "canonical_url", F.array_join("keywords", "|").alias("keywords"))


def twitter_fallback(spark, d):
    """Twitter cards where Open Graph is silent, by name or property."""
    k, prop = F.col("s_suppkey").cast("string"), lambda a, p, v: F.concat(F.lit(f'<meta {a}="twitter:{p}" content="'), v, F.lit('">'))
    page = F.concat(F.lit("<title>no</title>"), prop("name", "title", F.col("s_name")), prop("property", "description", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))), prop("name", "creator", F.concat(F.lit("@"), k)), prop("name", "image:src", F.concat(F.lit("/i/"), k, F.lit(".png"))), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('<meta property="og:title" content="og '), k, F.lit('">'))).otherwise(""))
    made = _supplier_pages(spark, d, page)
    return made.select("s_suppkey", "title", "description", "author", F.col("images")[0]["url"].alias("image"))


def std_meta(spark, d):
    """Titles, names, dates and keywords that pages state themselves."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    title = F.when(n % 2 == 0, F.concat(F.lit("<title> T \n"), k, F.lit("</title>"))).otherwise("")
    date = F.when(n % 3 == 0, F.concat((n + 1_700_000_000).cast("string"))).when(n % 3 == 1, "20240105").otherwise("2024-01-05T10:00:00+02:00")
    page = F.concat(F.lit('<html lang="de">'), title, F.lit("<h1>H "), k, F.lit('</h1><meta name=description content="'), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.lit('"><meta name="application-name" content="'), F.col("s_name"), F.lit('"><meta name=author content=A><meta name="keywords" content="x; y,'), k, F.lit(',X"><meta name=pubdate content="'), date, F.lit('"><meta itemprop="dateModified" content="junk">'))
    made = _supplier_pages(spark, d, page)
    return made.select("s_suppkey", "title", "description", "site_name", "locale", "author", F.unix_millis("published_at").alias("published_ms"), F.col("modified_at").isNull().alias("no_change"), F.array_join("keywords", "|").alias("keywords"))


def unsafe_hosts(spark, d):
    """Hosts in forms that hide an address, and why they are refused."""
    n = F.col("s_suppkey")
    forms = ["localhost", "a.LOCALHOST", "printer.local", "metadata.", "1.2.3.4.5", "0x7f.0x0.0.1", "2130706433", "nas.lan", "0x.example", "010.0.0.1", "[::1]", "[::ffff:8.8.8.8]", "[fd12::1]", "8.8.8.8."]
    host = F.element_at(F.array(*[F.lit(f) for f in forms]), (n % len(forms) + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", host.alias("host"), urls.unsafe_host(host).alias("reason"))


def graph_nodes(spark, d):
    """Nodes of stored graphs by the limits of a walk."""
    walk = linked_data.graph_of(F.transform("nodes", lambda n: F.struct(F.lit("script").alias("tag"), F.create_map(F.lit("type"), F.lit("application/ld+json")).alias("attrs"), n.alias("text"))))
    walked = table(spark, d, "structured_data").filter("nodes is not null").select("graph_id", walk.alias("g"))
    return walked.select("graph_id", F.size("g.nodes").alias("n_nodes"), "g.malformed", "g.limit_reached")


def link_icons(spark, d):
    """Icons of suppliers' pages, by what their links say."""
    k = F.col("s_suppkey")
    rel = F.when(k % 4 == 0, "Apple-Touch-Icon").when(k % 4 == 1, "shortcut icon").when(k % 4 == 2, "mask-icon").otherwise("fluid-icon")
    page = F.concat(F.lit('<link rel="'), rel, F.lit('" href=/i/'), k.cast("string"), F.lit(".png sizes=32x32><link rel=canonical href=/c#f>"))
    pages = table(spark, d, "supplier").select("s_suppkey", F.lit("https://s.example/a").alias("url"), page.alias("html"))
    made = parse.candidates_of(pages, options=parse.Options(skip=frozenset({"jsonLd"})))
    return made.select("s_suppkey", F.explode("candidates").alias("c")).filter("c.field_name = 'icons'").select("s_suppkey", "c.score", "c.item.url", "c.item.rel", "c.item.sizes")


def result_status(spark, d):
    """Status of results by the warnings that events stand for."""
    n = F.get_json_object("props", "$.k").try_cast("int")
    code = F.when(n % 3 == 0, "truncatedHtml").when(n % 3 == 1, "charsetFallback").otherwise("partialParse")
    warnings = F.when(n % 2 == 0, F.array(F.struct(code.alias("code")))).otherwise(F.array().cast("array<struct<code: string>>"))
    errors = F.when(n % 7 == 0, F.array(F.lit("network"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", parse.status_of(errors, warnings).alias("status"))


def metadata_roundtrip(spark, d):
    """Metadata to JSON and back, by what stays the same."""
    links = table(spark, d, "link_metadata").select("meta_id", F.struct("title", "site_name", "images", "keywords").alias("m"))
    schema = links.schema["m"].dataType
    back = links.withColumn("b", F.from_json(F.to_json("m"), schema))
    return back.groupBy((F.col("m.title").eqNullSafe(F.col("b.title")) & F.col("m.images").eqNullSafe(F.col("b.images"))).alias("same")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p7_found, p7_tables, url_parse_loose, url_cache_key, url_proxy, url_https, url_same_origin, url_resolve, request_coalescing, unsafe_targets,
        rank_candidates, field_winners, field_provenance, image_collection, candidate_decisions, page_metadata, page_candidates, raw_metadata, charset_decode, terminal_checks,
        redirect_chains, url_optimize, cache_valid, cache_purge, cache_evict, cache_write, batch_extract, oembed_json, oembed_xml, manifest_json, open_graph_images, graph_articles,
        og_fields, twitter_fallback, std_meta, unsafe_hosts, graph_nodes, link_icons, result_status, metadata_roundtrip,
    )
}

_LOOSE = r"""
WITH t AS (SELECT input_pos, url, regexp_replace(url, '^\s+|\s+$', '', 'g') AS t FROM urls),
c AS (SELECT *, CASE WHEN t = '' OR t IS NULL OR regexp_matches(lower(t), '^(mailto|tel|sms|javascript|data|file|ftp|about|chrome|blob):') THEN NULL
    WHEN starts_with(t, '//') THEN 'https:' || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN t WHEN starts_with(t, '/') THEN NULL ELSE 'https://' || t END AS u FROM t),
w AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, lower(regexp_extract(u, '^[^:]*://([^/?#]*)', 1)) AS h, regexp_replace(u, '#.*$', '') AS nf FROM c),
p AS (SELECT input_pos, url, CASE WHEN s IN ('http', 'https') AND h <> '' AND NOT regexp_matches(u, '^[^?#]*[\s<>"{}|\\^`]')
    THEN s || '://' || h || CASE WHEN regexp_matches(nf, '^[^:]*://[^/?#]*($|\?)') THEN '/' ELSE '' END || regexp_replace(nf, '^[^:]*://[^/?#]*', '') END AS parsed FROM w)
"""
_RANKED = """
WITH d AS (SELECT DISTINCT * FROM candidates),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY stage_ord NULLS FIRST, seq NULLS FIRST, source NULLS FIRST, score NULLS FIRST, evidence NULLS FIRST, candidate_value NULLS FIRST, item.url NULLS FIRST, item.width NULLS FIRST, item.height NULLS FIRST, item.mime_type NULLS FIRST, item.alt NULLS FIRST, item.byte_size NULLS FIRST) - 1 AS original_index FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY score DESC, original_index) AS rank FROM i WHERE score IS NOT NULL AND isfinite(score))
"""
_EXPIRY = f"CASE WHEN lifetime_kind = 'neverExpires' THEN NULL WHEN lifetime_kind = 'expiresAfter' AND duration_ms > 0 THEN created_at_ms + duration_ms ELSE created_at_ms + {cache.DEFAULT_TTL_MS} END"
_LIVE = f"NOT coalesce({NOW_MS} > ({_EXPIRY}), false)"

ORACLES: dict[str, str] = {
    "url_parse_loose": _LOOSE + "SELECT input_pos, url, parsed FROM p",
    "url_cache_key": _LOOSE + "SELECT input_pos, 'meta:' || sha256(parsed) AS cache_key FROM p WHERE parsed IS NOT NULL",
    "url_proxy": "SELECT meta_id, 'https://proxy.example/?u=' || url_encode(resolved_url) AS proxied FROM link_metadata",
    "url_https": "SELECT meta_id, regexp_replace(resolved_url, '^(?i)http:', 'https:') AS url FROM link_metadata",
    "url_same_origin": """SELECT meta_id, lower(regexp_extract(original_url, '^([^/]*//[^/?#]*)', 1)) = lower(regexp_extract(canonical_url, '^([^/]*//[^/?#]*)', 1)) AS same_origin FROM link_metadata WHERE canonical_url IS NOT NULL""",
    "url_resolve": """SELECT meta_id, lower(regexp_extract(original_url, '^([^/]*//[^/?#]*)', 1)) || '/' || regexp_replace(canonical_url, '^https?://[^/]*/', '') AS resolved FROM link_metadata WHERE canonical_url IS NOT NULL""",
    "request_coalescing": _LOOSE + "SELECT parsed AS request, count(*) AS n_requests, min(input_pos) AS first_pos FROM p WHERE parsed IS NOT NULL GROUP BY parsed",
    "unsafe_targets": """
        WITH k AS (SELECT c_custkey, c_custkey * 7 % 256 AS a, c_custkey * 13 % 256 AS b, c_custkey % 3 AS c, c_custkey % 251 AS e FROM customer)
        SELECT c_custkey, a || '.' || b || '.' || c || '.' || e AS ip,
          CASE WHEN a IN (10, 127, 0) OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 169 AND b = 254 OR a = 100 AND b BETWEEN 64 AND 127 THEN 'private_ipv4'
               WHEN a >= 224 OR a = 192 AND b = 0 AND c IN (0, 2) OR a = 198 AND (b IN (18, 19) OR b = 51 AND c = 100) OR a = 203 AND b = 0 AND c = 113 THEN 'reserved_ipv4' END AS reason FROM k""",
    "rank_candidates": _RANKED + "SELECT doc_id, field_name, CAST(rank AS INT) AS rank, source, score, candidate_value, item.url AS url FROM r",
    "field_winners": _RANKED + """SELECT doc_id, max(candidate_value) FILTER (field_name = 'title') AS title, max(candidate_value) FILTER (field_name = 'description') AS description, max(candidate_value) FILTER (field_name = 'siteName') AS site_name,
        max(candidate_value) FILTER (field_name = 'locale') AS locale, max(candidate_value) FILTER (field_name = 'publishedAt') AS published_at
        FROM r WHERE rank = 1 AND field_name IN ('canonicalUrl','title','description','siteName','locale','author','publishedAt','modifiedAt','kind','structuredData') GROUP BY doc_id""",
    "field_provenance": _RANKED + """SELECT doc_id, field_name, source, score, evidence FROM r WHERE rank = 1 AND field_name IN ('canonicalUrl','title','description','siteName','locale','author','publishedAt','modifiedAt','kind','structuredData')
        AND NOT (field_name = 'kind' AND coalesce(candidate_value, '') = 'unknown')""",
    "image_collection": _RANKED + """, k AS (SELECT doc_id, item.url AS key, rank, item FROM r WHERE field_name = 'images' AND item.url IS NOT NULL AND item.url <> ''),
        f AS (SELECT *, min(rank) OVER (PARTITION BY doc_id, key) AS fr FROM k), g AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY fr) AS place FROM f)
        SELECT doc_id, key AS url, CAST(place AS INT) AS place, arg_min(item.width, rank) FILTER (item.width IS NOT NULL) AS width, arg_min(item.height, rank) FILTER (item.height IS NOT NULL) AS height,
        arg_min(item.byte_size, rank) FILTER (item.byte_size IS NOT NULL) AS byte_size FROM g WHERE place <= 10 GROUP BY doc_id, key, place""",
    "terminal_checks": """WITH h AS (SELECT *, lower(list_extract([e.value FOR e IN map_entries(headers) IF lower(e.key) = 'content-type'], 1)) AS ct FROM responses),
        c AS (SELECT status, error IS NOT NULL AS failed, CASE WHEN error IS NOT NULL OR status IS NULL THEN CASE WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%timed out%' THEN 'timeout' ELSE 'network' END
          WHEN NOT (ct IS NULL OR ct LIKE '%text/html%' OR ct LIKE '%application/xhtml%') THEN 'nonHtmlContent' WHEN status NOT BETWEEN 200 AND 299 THEN 'httpStatus' END AS error_code FROM h)
        SELECT status, failed, error_code, coalesce(error_code IN ('network', 'timeout') OR error_code = 'httpStatus' AND (status IN (408, 425, 429) OR status >= 500), false) AS retryable, count(*) AS n FROM c GROUP BY ALL""",
    "cache_valid": f"SELECT cache_key, kind, created_at_ms FROM cache_entries WHERE {_LIVE}",
    "cache_purge": f"SELECT cache_key FROM cache_entries WHERE NOT starts_with(cache_key, 'meta:') OR ({_LIVE} AND payload IS NOT NULL AND json_valid(payload))",
    "cache_evict": f"SELECT cache_key, last_access_ms FROM cache_entries ORDER BY last_access_ms DESC NULLS LAST, cache_key LIMIT {cache.MAX_ENTRIES}",
    "oembed_json": "SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS title, p_brand AS provider, CAST(p_size AS BIGINT) AS width, 'https://o.example/t/' || p_partkey AS image FROM part",
    "oembed_xml": "SELECT p_partkey, trim(p_name) AS title, CAST(p_size AS BIGINT) AS width FROM part",
    "manifest_json": "SELECT s_suppkey, s_name AS name, 'https://m.example/app/start' AS start_url, 'https://m.example/app/i/' || s_suppkey AS icon FROM supplier",
    "open_graph_images": """SELECT p_partkey, 0 AS place, 'https://p.example/a/' || p_partkey || '.png' AS url, p_size AS width, CAST(NULL AS INT) AS height, 'one' AS alt FROM part
        UNION ALL SELECT p_partkey, 1, 'https://p.example/x/b/' || p_partkey || '.png', NULL, 7, NULL FROM part""",
    "graph_articles": """SELECT o_orderkey, 'Order ' || o_orderkey AS title, 'article' AS kind, o_orderstatus AS author, strftime(o_orderdate, '%Y-%m-%d') AS published, 'a|' || o_orderpriority AS keywords FROM orders""",
    "link_icons": """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.75 WHEN 2 THEN 0.7 ELSE 0.65 END::DOUBLE AS score, 'https://s.example/i/' || s_suppkey || '.png' AS url,
        CASE s_suppkey % 4 WHEN 0 THEN 'Apple-Touch-Icon' WHEN 1 THEN 'shortcut icon' WHEN 2 THEN 'mask-icon' ELSE 'fluid-icon' END AS rel, '32x32' AS sizes FROM supplier""",
    "result_status": """WITH k AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS n FROM events)
        SELECT event_id, CASE WHEN n % 7 = 0 THEN 'failure' WHEN n % 2 = 0 AND n % 3 <> 1 THEN 'partial' ELSE 'success' END AS status FROM k""",
    "metadata_roundtrip": "SELECT true AS same, count(*) AS n FROM link_metadata",
    "cache_write": f"""WITH f AS (SELECT 'meta:' || sha256(resolved_url) AS cache_key, max(epoch_us(fetched_at) // 1000) AS created_at_ms FROM link_metadata WHERE resolved_url IS NOT NULL AND fetched_at IS NOT NULL GROUP BY 1)
        SELECT cache_key, created_at_ms FROM cache_entries WHERE cache_key NOT IN (SELECT cache_key FROM f) UNION ALL SELECT cache_key, created_at_ms FROM f""",
    "candidate_decisions": _RANKED + f""", k AS (SELECT *, CASE WHEN field_name = 'keywords' THEN lower(trim(candidate_value)) ELSE item.url END AS key FROM r WHERE field_name IN ({", ".join(f"'{f}'" for f in ranking.LIMITS)})),
        g AS (SELECT *, min(rank) OVER (PARTITION BY doc_id, field_name, key) AS fr, {", ".join(f"coalesce(max(CASE WHEN item.{a} IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, field_name, key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had_{a}" for a in ranking.MERGED)} FROM k WHERE key IS NOT NULL AND key <> ''),
        h AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, field_name ORDER BY fr) AS place FROM g),
        c AS (SELECT field_name, source, place <= CASE field_name {" ".join(f"WHEN '{f}' THEN {n}" for f, n in ranking.LIMITS.items())} END AND (rank = fr OR field_name <> 'keywords' AND ({" OR ".join(f"item.{a} IS NOT NULL AND had_{a} = 0" for a in ranking.MERGED)})) AS selected FROM h
          UNION ALL SELECT field_name, source, rank = 1 FROM r WHERE field_name NOT IN ({", ".join(f"'{f}'" for f in ranking.LIMITS)}))
        SELECT field_name, source, selected, count(*) AS n FROM c GROUP BY ALL""",
    "p7_found": """WITH RECURSIVE n AS (SELECT graph_id, unnest(nodes) AS t, unnest(range(len(nodes))) AS pos FROM structured_data WHERE len(nodes) > 0),
        w(graph_id, path, parent_path, v) AS (
          SELECT graph_id, CAST(pos AS VARCHAR), '', CAST(t AS JSON) FROM n WHERE t IS NOT NULL AND json_valid(t)
          UNION ALL
          SELECT graph_id, path || '/' || k, CASE WHEN json_type(v) = 'OBJECT' THEN path ELSE parent_path END, c FROM (
            SELECT graph_id, path, parent_path, v, k, CASE WHEN json_type(v) = 'OBJECT' THEN v -> k ELSE v -> CAST(k AS BIGINT) END AS c FROM (
              SELECT graph_id, path, parent_path, v, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN CAST(range(json_array_length(v)::BIGINT) AS VARCHAR[]) ELSE [] END) AS k FROM w))
          WHERE json_type(c) IN ('OBJECT', 'ARRAY'))
        SELECT graph_id, path, parent_path FROM w WHERE json_type(v) = 'OBJECT' AND len(json_keys(v)) > 0""",
    "og_fields": """SELECT s_suppkey, 'A & ' || s_name AS title, 'nation ' || s_nationkey AS description, s_name AS site_name, 'en_US' AS locale, CASE s_suppkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'other' ELSE 'video' END AS kind,
        'https://s.example/c/' || s_suppkey AS canonical_url, 'one' AS keywords FROM supplier""",
    "twitter_fallback": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'og ' || s_suppkey ELSE s_name END AS title, 'nation ' || s_nationkey AS description, '@' || s_suppkey AS author, 'https://s.example/i/' || s_suppkey || '.png' AS image FROM supplier",
    "std_meta": """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'T ' || s_suppkey ELSE 'H ' || s_suppkey END AS title, 'nation ' || s_nationkey AS description, s_name AS site_name, 'de' AS locale, 'A' AS author,
        CASE s_suppkey % 3 WHEN 0 THEN (s_suppkey + 1700000000) * 1000 WHEN 1 THEN epoch_ms(TIMESTAMP '2024-01-05 00:00:00') ELSE epoch_ms(TIMESTAMP '2024-01-05 08:00:00') END::BIGINT AS published_ms, true AS no_change, 'x|y|' || s_suppkey AS keywords FROM supplier""",
    "unsafe_hosts": """WITH f(i, host, reason) AS (VALUES (0, 'localhost', 'local_name'), (1, 'a.LOCALHOST', 'local_name'), (2, 'printer.local', 'local_name'), (3, 'metadata.', 'local_name'), (4, '1.2.3.4.5', 'ambiguous_numeric'), (5, '0x7f.0x0.0.1', 'ambiguous_numeric'),
        (6, '2130706433', 'ambiguous_numeric'), (7, 'nas.lan', NULL), (8, '0x.example', NULL), (9, '010.0.0.1', 'ambiguous_numeric'), (10, '[::1]', 'local_ipv6'), (11, '[::ffff:8.8.8.8]', NULL), (12, '[fd12::1]', 'reserved_ipv6'), (13, '8.8.8.8.', NULL))
        SELECT s_suppkey, host, reason FROM supplier JOIN f ON s_suppkey % 14 = i""",
}
