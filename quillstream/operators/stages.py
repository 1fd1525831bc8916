"""Extractor stages: elements of a page to scored candidates.

Each stage is expressions over the element array of its own row, so that a
page's candidates are made where the page is, without any exchange. It gives
legs in order: the fields that a leg may tell of, and an array of candidates
(or nulls). A field that nobody asks for is so left to the optimizer to drop.
"""

from __future__ import annotations

import json
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, urls
from ..sources.html import content, first, meta

ITEM = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("mime_type", T.StringType()),
    T.StructField("alt", T.StringType()), T.StructField("byte_size", T.LongType()), T.StructField("sizes", T.StringType()), T.StructField("rel", T.StringType()),
])
CANDIDATE = T.StructType([
    T.StructField("field_name", T.StringType()), T.StructField("stage_ord", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("evidence", T.StringType()), T.StructField("candidate_value", T.StringType()), T.StructField("item", ITEM),
])
Leg = tuple[tuple[str, ...], Column]
STAGES = ("openGraph", "twitterCard", "standardMeta", "linkRel", "jsonLd", "oEmbed", "manifest")

# Scores of fields by stage.
OG = {"title": 0.95, "description": 0.9, "siteName": 0.85, "locale": 0.7, "canonicalUrl": 0.75, "kind": 0.7, "images": 0.85, "videos": 0.7, "audios": 0.7, "publishedAt": 0.8, "modifiedAt": 0.75, "keywords": 0.6}
TWITTER = {"title": 0.85, "description": 0.8, "author": 0.45, "images": 0.75, "videos": 0.55}
STANDARD = {"title": 0.65, "h1": 0.35, "description": 0.6, "siteName": 0.4, "lang": 0.45, "locale": 0.35, "keywords": 0.4, "author": 0.45, "publishedAt": 0.45, "modifiedAt": 0.4}
LINK = {"canonicalUrl": 0.95, "manifestUrls": 0.9, "oembedEndpoints": 0.85, "apple": 0.8, "icon": 0.75, "mask": 0.7, "other": 0.65}
GRAPH = {
    "kind": (0.92, 0.8, 0.68), "canonicalUrl": (0.9, 0.78, 0.65), "title": (0.86, 0.74, 0.62), "description": (0.82, 0.7, 0.58), "locale": (0.78, 0.66, 0.54), "siteName": (0.74, 0.62, 0.5),
    "author": (0.9, 0.78, 0.66), "publishedAt": (0.92, 0.8, 0.68), "modifiedAt": (0.88, 0.76, 0.64), "keywords": (0.72, 0.6, 0.48), "images": (0.8, 0.68, 0.56),
    "videos": (0.86, 0.74, 0.62), "embeds": (0.84, 0.72, 0.6), "audios": (0.86, 0.74, 0.62), "structuredData": (0.85, 0.85, 0.85),
}


def item(url: Column, **more: Column) -> Column:
    values = {"url": url, **more}
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM.fields])


def _no_item() -> Column:
    return F.lit(None).cast(ITEM)


def candidate(field: str, stage: int, score: float | Column, value: Column | None = None, evidence: Column | str | None = None, it: Column | None = None) -> Column:
    """A candidate, or null where its value is."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    c = F.struct(
        F.lit(field).alias("field_name"), F.lit(stage).alias("stage_ord"), F.lit(STAGES[stage]).alias("source"), lit(score).cast("double").alias("score"),
        lit(evidence).cast("string").alias("evidence"), (value if value is not None else F.lit(None)).cast("string").alias("candidate_value"), (it if it is not None else _no_item()).alias("item"),
    )
    told = (lambda x: x["candidate_value"].isNotNull()) if value is not None else (lambda x: x["item"]["url"].isNotNull())
    return urls.let(c, lambda x: F.when(told(x), x))


def _legs(*candidates: tuple[str, Column]) -> list[Leg]:
    return [((field,), F.array(c)) for field, c in candidates]


def _of_texts(field: str, stage: int, score: float, values: Column, evidence: str) -> Column:
    return F.transform(values, lambda v: candidate(field, stage, score, v, evidence))


def _distinct_items(values: Column) -> Column:
    """Items of a list of URLs, each once."""
    return F.transform(F.array_distinct(F.array_compact(values)), lambda u: item(u))


def _instant(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def open_graph(e: Column, base: Column, document: Column) -> list[Leg]:
    say = lambda p: text.clean(content(meta(e, property=p, name=p)))
    key = lambda x: F.lower(F.trim(F.coalesce(x["attrs"]["property"], x["attrs"]["name"])))
    texts = [(f, candidate(f, 0, OG[f], say(p), p)) for f, p in (("title", "og:title"), ("description", "og:description"), ("siteName", "og:site_name"), ("locale", "og:locale"))]
    canonical = candidate("canonicalUrl", 0, OG["canonicalUrl"], urls.absolute(base, say("og:url")), "og:url")
    root = urls.path(document).isin("", "/")

    def kind_of(t: Column) -> Column:
        low = F.lower(t)
        kind = (
            F.when(low.isin("article", "product", "profile"), low).when(low == "website", F.when(root, "homepage").otherwise("other"))
            .when(low.startswith("video"), "video").when(low.startswith("music"), "audio")
        )
        return candidate("kind", 0, OG["kind"], kind, F.concat(F.lit("og:type="), t))

    kinds = urls.let(say("og:type"), kind_of)

    def media(prefix: str) -> Column:
        hits = F.filter(e, lambda x: (x["tag"] == "meta") & key(x).isin(prefix, f"{prefix}:url", f"{prefix}:secure_url"))
        return _distinct_items(F.transform(hits, lambda x: urls.absolute(base, content(x))))

    of_media = lambda f, p: F.transform(media(p), lambda i: candidate(f, 0, OG[f], it=i, evidence=p))
    images = F.transform(_og_images(e, base, key), lambda i: candidate("images", 0, OG["images"], it=i, evidence="og:image"))
    dated = lambda *ps: text.meta_date(text.clean(content(first(e, lambda x: (x["tag"] == "meta") & (x["attrs"]["property"].isin(*ps) | x["attrs"]["name"].isin(*ps))))))
    published = candidate("publishedAt", 0, OG["publishedAt"], _instant(dated("article:published_time", "og:published_time")), "article:published_time")
    modified = candidate("modifiedAt", 0, OG["modifiedAt"], _instant(dated("article:modified_time", "og:updated_time")), "article:modified_time")
    tags = F.filter(e, lambda x: (x["tag"] == "meta") & (x["attrs"]["property"].isin("article:tag", "book:tag", "video:tag") | x["attrs"]["name"].isin("article:tag", "book:tag", "video:tag")))
    keywords = _of_texts("keywords", 0, OG["keywords"], F.array_compact(F.transform(tags, lambda x: text.clean(content(x)))), "article:tag")
    return [
        *_legs(*texts, ("canonicalUrl", canonical), ("kind", kinds)), (("images",), images), (("videos",), of_media("videos", "og:video")), (("audios",), of_media("audios", "og:audio")),
        *_legs(("publishedAt", published), ("modifiedAt", modified)), (("keywords",), keywords),
    ]


def _og_images(e: Column, base: Column, key) -> Column:
    """Images in order: a root property opens one, the others tell of the one
    that is open. An URL that can't be resolved opens none."""
    hits = F.filter(e, lambda x: (x["tag"] == "meta") & key(x).startswith("og:image") & (F.trim(content(x)) != ""))
    start = F.struct(F.array().cast(T.ArrayType(ITEM)).alias("done"), _no_item().alias("open"))

    def fold(acc: Column, x: Column) -> Column:
        k, u, v, o = x["k"], x["u"], x["v"], acc["open"]
        is_root, secure = k.isin("og:image", "og:image:url") & u.isNotNull(), (k == "og:image:secure_url") & u.isNotNull()
        done = F.when(is_root & o.isNotNull(), F.concat(acc["done"], F.array(o))).otherwise(acc["done"])
        told = item(
            F.when(secure, u).otherwise(o["url"]), width=F.when(k == "og:image:width", x["n"]).otherwise(o["width"]), height=F.when(k == "og:image:height", x["n"]).otherwise(o["height"]),
            mime_type=F.when(k == "og:image:type", v).otherwise(o["mime_type"]), alt=F.when(k == "og:image:alt", v).otherwise(o["alt"]), byte_size=o["byte_size"],
        )
        return F.struct(done.alias("done"), F.when(is_root | (secure & o.isNull()), item(u)).when(o.isNotNull(), told).alias("open"))

    def read(x: Column) -> Column:
        url = F.when(x["k"].isin("og:image", "og:image:url", "og:image:secure_url"), urls.absolute(base, x["v"]))
        return F.struct(x["k"].alias("k"), x["v"].alias("v"), url.alias("u"), F.when(x["k"].isin("og:image:width", "og:image:height"), text.lenient_int(x["v"]).cast("int")).alias("n"))

    said = F.transform(hits, lambda x: F.struct(key(x).alias("k"), F.trim(content(x)).alias("v")))

    return F.aggregate(F.transform(said, read), start, fold, lambda acc: F.concat(acc["done"], F.filter(F.array(acc["open"]), lambda i: i.isNotNull())))


def twitter_card(e: Column, base: Column) -> list[Leg]:
    say = lambda p: F.coalesce(text.clean(content(meta(e, name=p))), text.clean(content(meta(e, property=p))))
    texts = [(f, candidate(f, 1, TWITTER[f], say(p), p)) for f, p in (("title", "twitter:title"), ("description", "twitter:description"), ("author", "twitter:creator"))]
    image = urls.absolute(base, F.coalesce(say("twitter:image"), say("twitter:image:src")))
    return _legs(*texts, ("images", candidate("images", 1, TWITTER["images"], it=item(image), evidence="twitter:image")), ("videos", candidate("videos", 1, TWITTER["videos"], it=item(urls.absolute(base, say("twitter:player"))), evidence="twitter:player")))


def standard_meta(e: Column) -> list[Leg]:
    of = lambda *selectors: F.coalesce(*[text.clean(content(meta(e, **s))) for s in selectors])
    tag = lambda t: text.clean(first(e, lambda x: x["tag"] == t)["text"])
    lang = text.clean(first(e, lambda x: x["tag"] == "html")["attrs"]["lang"])
    dates = [{"name": n} for n in ("pubdate", "publish-date", "publication_date", "date", "datePublished")] + [{"itemprop": "datePublished"}, {"property": "article:published_time"}]
    changes = [{"name": n} for n in ("last-modified", "modified", "dateModified")] + [{"itemprop": "dateModified"}, {"property": "article:modified_time"}]
    c = lambda f, v, score, ev: (f, candidate(f, 2, STANDARD[score], v, ev))
    singles = [
        c("title", tag("title"), "title", "title"), c("title", tag("h1"), "h1", "h1"), c("description", of({"name": "description"}, {"property": "description"}), "description", "meta[description]"),
        c("siteName", of({"name": "application-name"}, {"name": "apple-mobile-web-app-title"}), "siteName", "meta[application-name]"), c("locale", lang, "lang", "html[lang]"),
        c("locale", of({"http_equiv": "content-language"}, {"name": "language"}), "locale", "meta[content-language]"), c("author", of({"name": "author"}, {"property": "author"}), "author", "meta[author]"),
        c("publishedAt", _instant(text.meta_date(of(*dates))), "publishedAt", "meta[date]"), c("modifiedAt", _instant(text.meta_date(of(*changes))), "modifiedAt", "meta[last-modified]"),
    ]
    keywords = _of_texts("keywords", 2, STANDARD["keywords"], F.coalesce(text.split_keywords(of({"name": "keywords"})), F.array().cast("array<string>")), "meta[keywords]")
    return [*_legs(*singles), (("keywords",), keywords)]


def link_rel(e: Column, base: Column, links: bool = True, oembed: bool = True, manifest: bool = True) -> list[Leg]:
    """Of each link the first kind that fits, even where its URL doesn't."""
    hits = F.filter(e, lambda x: (x["tag"] == "link") & (F.trim(x["attrs"]["rel"]) != "") & (F.trim(x["attrs"]["href"]) != ""))

    def one(x: Column) -> Column:
        rel, kind, url = text.rel_tokens(x["attrs"]["rel"]), F.coalesce(F.lower(x["attrs"]["type"]), F.lit("")), urls.absolute(base, x["attrs"]["href"])
        has = lambda t: F.array_contains(rel, t)
        apple = has("apple-touch-icon") | has("apple-touch-icon-precomposed")
        score = F.when(apple, LINK["apple"]).when(has("mask-icon"), LINK["mask"]).when(has("icon"), LINK["icon"]).otherwise(LINK["other"])
        fmt = F.when(kind.contains("json"), "json").when(kind.contains("xml"), "xml").otherwise("json")
        icon = candidate("icons", 3, score, it=item(url, sizes=x["attrs"]["sizes"], mime_type=x["attrs"]["type"], rel=x["attrs"]["rel"]), evidence="link[rel=icon]")
        return (
            F.when(F.lit(links) & has("canonical"), candidate("canonicalUrl", 3, LINK["canonicalUrl"], url, "link[rel=canonical]"))
            .when(F.lit(manifest) & has("manifest"), candidate("manifestUrls", 3, LINK["manifestUrls"], url, "link[rel=manifest]"))
            .when(F.lit(oembed) & has("alternate") & kind.contains("oembed"), candidate("oembedEndpoints", 3, LINK["oembedEndpoints"], F.concat(fmt, F.lit(":"), url), "link[type*=oembed]"))
            .when(F.lit(links) & F.exists(rel, lambda t: t.contains("icon")), icon)
        )

    return [(("canonicalUrl", "manifestUrls", "oembedEndpoints", "icons"), F.transform(hits, one))]


# Kinds that types of linked data stand for, the first group that
# fits counts; and types that score as primary or secondary.
KINDS = {
    "article": "Article NewsArticle BlogPosting Report TechArticle ScholarlyArticle LiveBlogPosting", "video": "VideoObject Movie TVEpisode TVSeries Clip", "audio": "AudioObject MusicRecording PodcastEpisode PodcastSeries MusicAlbum",
    "product": "Product ProductGroup Offer", "profile": "Person ProfilePage Organization", "homepage": "WebSite", "other": "WebPage",
}
PRIMARY = frozenset("Article NewsArticle BlogPosting Report TechArticle ScholarlyArticle VideoObject AudioObject Product Recipe Event Movie".split())
SECONDARY = frozenset("WebPage ProfilePage Person Organization CollectionPage ItemPage AboutPage FAQPage".split())
LINK_KEYS = ("url", "@id", "contentUrl", "embedUrl", "thumbnailUrl", "logo", "sameAs", "mainEntityOfPage")


def _types(node: dict) -> list[str]:
    raw = node.get("@type")
    names = [raw] if isinstance(raw, str) else [t for t in raw if isinstance(t, str)] if isinstance(raw, list) else []
    return [t.rsplit(":", 1)[-1].rsplit("/", 1)[-1].strip() for t in names if t.strip()]


def _urls(value, base: str, depth: int = 0) -> list[str]:
    if depth > 64:
        return []
    if isinstance(value, str):
        t = value.strip()
        if not t or t.startswith("javascript:"):
            return []
        try:
            full = urljoin(base, t)
            parts = urlsplit(full)
        except ValueError:
            return []
        return [full.split("#")[0]] if parts.scheme in ("http", "https") and parts.hostname else []
    if isinstance(value, list):
        return [u for v in value for u in _urls(v, base, depth + 1)]
    if isinstance(value, dict):
        return [u for k in LINK_KEYS if k in value for u in _urls(value[k], base, depth + 1)]
    return []


def _names(value, depth: int = 0) -> list[str]:
    if depth > 64:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [value["name"]] if isinstance(value.get("name"), str) else []
    return [n for v in value for n in _names(v, depth + 1)] if isinstance(value, list) else []


def relevance(node: dict, base: str, document: str) -> float:
    """How much a node is about the page it is on; every URL of it counts."""
    def form(u: str) -> tuple[str, str, str]:
        p = urlsplit(u.split("#")[0])
        return p.scheme.lower(), p.netloc.lower(), p.path + ("?" + p.query if p.query else "")
    total, page = 0.0, form(document)
    for key in ("url", "@id", "mainEntityOfPage"):
        for u in _urls(node.get(key), base):
            mine = form(u)
            same_path = mine[1] == page[1] and mine[2].split("?")[0] == page[2].split("?")[0]
            total += 6 if mine == page else 3 if same_path else 1 if mine[1] == page[1] else 0
    kinds = set(_types(node))
    total += 3 if kinds & PRIMARY else 1.5 if kinds & SECONDARY else 0.5 if kinds else 0
    total += 0.75 * ("headline" in node or "name" in node) + 0.5 * ("description" in node)
    total += 0.5 * ("datePublished" in node or "uploadDate" in node) + 0.35 * ("image" in node or "thumbnailUrl" in node)
    return total


def graph_candidates(nodes: list[str], base: str, document: str, derived: int = 4000) -> list[dict]:
    """Candidates of the twelve most relevant nodes of a page."""
    parsed = [json.loads(n) for n in nodes]
    if not parsed:
        return []
    out: list[dict] = []

    def add(field: str, rank: int, value=None, url: str | None = None, key: str | None = None, evidence: str = "json-ld") -> None:
        value = " ".join(value.replace("\x00", "").split()) if isinstance(value, str) else value
        if (value or url) and len(out) < derived:
            it = {f.name: None for f in ITEM.fields} | {"url": url} if url else None
            out.append({"field_name": field, "stage_ord": 4, "source": STAGES[4], "score": GRAPH[key or field][rank], "evidence": evidence, "candidate_value": value, "item": it})

    add("structuredData", 0, f"nodes={len(parsed)}:" + ",".join(f"{n.get('@id', '')}|{'+'.join(_types(n))}" for n in parsed), evidence="script[type*=ld+json]")
    order = sorted(range(len(parsed)), key=lambda i: (-relevance(parsed[i], base, document), i))[:12]
    site = next((n for n in parsed if "WebSite" in _types(n)), None)
    for place, i in enumerate(order):
        n, rank = parsed[i], 0 if place == 0 else 1 if place < 4 else 2
        kinds, name = _types(n), n.get("@id")
        ev = " ".join(x for x in (f"@type={'|'.join(kinds)}" if kinds else "", f"@id={name}" if isinstance(name, str) and name.strip() else "") if x) or "json-ld"
        text_of = lambda *keys, n=n: next((n[k] for k in keys if isinstance(n.get(k), str) and n[k].strip()), None)
        kind = next((k for k, group in KINDS.items() if set(kinds) & set(group.split())), None)
        add("kind", rank, kind, evidence=ev)
        add("canonicalUrl", rank, next((u for k in ("mainEntityOfPage", "url", "@id") for u in _urls(n.get(k), base)), None), evidence=ev)
        add("title", rank, text_of("headline", "name", "title"), evidence=ev)
        add("description", rank, text_of("description"), evidence=ev)
        add("locale", rank, text_of("inLanguage", "@language"), evidence=ev)
        publisher = n.get("publisher")
        add("siteName", rank, next(iter(_names(publisher)), None) or (next((site[k] for k in ("name", "headline") if isinstance(site.get(k), str)), None) if site else None), evidence=ev)
        for a in _names(n.get("author")):
            add("author", rank, a, evidence=ev)
        for field, keys in (("publishedAt", ("datePublished", "uploadDate", "startDate")), ("modifiedAt", ("dateModified",))):
            for k in keys:
                if isinstance(n.get(k), (str, int)) and not isinstance(n.get(k), bool):
                    add(field, rank, f"{'s' if isinstance(n[k], str) else 'n'}{n[k]}", evidence=ev)
        words = n.get("keywords")
        for w in words.split(",") if isinstance(words, str) else words if isinstance(words, list) else []:
            if isinstance(w, str):
                add("keywords", rank, w, evidence=ev)
        for k in ("image", "thumbnailUrl", "logo"):
            for u in _urls(n.get(k), base):
                add("images", rank, url=u, evidence=ev)
        if "VideoObject" in kinds:
            for k, score in (("contentUrl", "videos"), ("embedUrl", "embeds")):
                for u in _urls(n.get(k), base):
                    add("videos", rank, url=u, key=score, evidence=ev)
        if "AudioObject" in kinds:
            for u in _urls(n.get("contentUrl"), base):
                add("audios", rank, url=u, evidence=ev)
    return out


@F.pandas_udf(T.ArrayType(CANDIDATE))
def _graph(nodes: pd.Series, base: pd.Series, document: pd.Series) -> pd.Series:
    return pd.Series([graph_candidates(list(n) if n is not None else [], b or "", d or "") for n, b, d in zip(nodes, base, document, strict=True)], dtype=object)


def linked_data(graph: Column, base: Column, document: Column) -> list[Leg]:
    """Candidates of a page's graph; times are read here, and those that say
    none are dropped, so that the next key of a node counts."""
    raw = _graph.asNondeterministic()(graph["nodes"], base, document)
    dated = lambda c: c["field_name"].isin("publishedAt", "modifiedAt")
    read = lambda c: _instant(text.graph_date(F.substring(c["candidate_value"], F.lit(2), F.length(c["candidate_value"])), c["candidate_value"].startswith("s")))
    fixed = F.transform(raw, lambda c: F.when(dated(c), c.withField("candidate_value", read(c))).otherwise(c))
    return [(tuple(dict.fromkeys(f for f in GRAPH if f != "embeds")), F.filter(fixed, lambda c: c["candidate_value"].isNotNull() | c["item"].isNotNull()))]


def all_legs(e: Column, base: Column, document: Column, graph: Column | None = None, skip: frozenset[str] = frozenset()) -> list[Leg]:
    """The legs of every stage that isn't skipped, in stage order."""
    legs: list[Leg] = []
    if "openGraph" not in skip:
        legs += open_graph(e, base, document)
    if "twitterCard" not in skip:
        legs += twitter_card(e, base)
    if "standardMeta" not in skip:
        legs += standard_meta(e)
    if "linkRel" not in skip:
        legs += link_rel(e, base)
    if graph is not None and "jsonLd" not in skip:
        legs += linked_data(graph, base, document)
    return legs


def candidates(legs: list[Leg]) -> Column:
    """The candidates of legs in their order."""
    return F.array_compact(F.concat(*[values for _, values in legs])) if legs else F.array().cast(T.ArrayType(CANDIDATE))


def candidates_for(legs: list[Leg], field: str) -> Column:
    """As ``candidates``, those of one field; other legs aren't looked at."""
    mine = [(names, values if names == (field,) else F.filter(values, lambda c: c["field_name"] == field)) for names, values in legs if field in names]
    return candidates(mine)
