"""Remote documents that add to a page: oEmbed and web app manifests."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, urls
from . import stages

# Scores, and what is read of a remote document at most.
OEMBED = {"title": 0.7, "author": 0.7, "siteName": 0.65, "images": 0.8}
MANIFEST = {"siteName": 0.6, "title": 0.55, "icons": 0.72}
OEMBED_BYTES, MANIFEST_BYTES = 262_144, 524_288
OEMBED_FIELDS = ("type", "version", "title", "author_name", "author_url", "provider_name", "provider_url", "thumbnail_url", "thumbnail_width", "thumbnail_height", "width", "height", "html", "url")
_RECORD = T.StructType([T.StructField(f, T.StringType()) for f in OEMBED_FIELDS])
_MANIFEST = T.StructType([*[T.StructField(f, T.StringType()) for f in ("name", "short_name", "start_url", "display", "background_color", "theme_color")], T.StructField("icons", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("src", "sizes", "type", "purpose")])))])


@F.pandas_udf(_RECORD)
def _from_xml(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        row = dict.fromkeys(OEMBED_FIELDS)
        try:
            root = ET.fromstring(t) if t and "<!DOCTYPE" not in t[:2000].upper() else None
        except ET.ParseError:
            root = None
        if root is not None:
            for e in root.iter():
                name = e.tag.rsplit("}", 1)[-1]
                if name in row and row[name] is None:
                    row[name] = ("".join(e.itertext()).strip()) or None
        rows.append(row)
    return pd.DataFrame(rows, columns=list(OEMBED_FIELDS))


def oembed_json(body: Column) -> Column:
    """An oEmbed record of a JSON text, numbers as texts; null if it is none."""
    return F.from_json(F.substring(body, F.lit(1), F.lit(OEMBED_BYTES)), _RECORD)


def oembed_xml(body: Column) -> Column:
    return _from_xml.asNondeterministic()(F.substring(body, F.lit(1), F.lit(OEMBED_BYTES)))


def manifest_json(body: Column, manifest_url: Column) -> Column:
    """A manifest with its links resolved against its own address; icons
    without a source are left out."""
    m = F.from_json(F.substring(body, F.lit(1), F.lit(MANIFEST_BYTES)), _MANIFEST)
    icons = F.filter(F.transform(m["icons"], lambda i: F.struct(urls.resolve_any(manifest_url, i["src"]).alias("src"), i["sizes"].alias("sizes"), i["type"].alias("type"), i["purpose"].alias("purpose"))), lambda i: F.trim(i["src"]) != "")
    return F.when(m.isNotNull(), F.struct(*[text.clean(m[f]).alias(f) for f in ("name", "short_name", "display", "background_color", "theme_color")], urls.resolve_any(manifest_url, m["start_url"]).alias("start_url"), icons.alias("icons")))


def oembed_candidates(r: Column, base: Column) -> Column:
    size = {"width": text.lenient_int(r["thumbnail_width"]), "height": text.lenient_int(r["thumbnail_height"])}
    return F.array_compact(F.array(
        stages.candidate("title", 5, OEMBED["title"], text.clean(r["title"]), "oembed"), stages.candidate("author", 5, OEMBED["author"], text.clean(r["author_name"]), "oembed"),
        stages.candidate("siteName", 5, OEMBED["siteName"], text.clean(r["provider_name"]), "oembed"), stages.candidate("images", 5, OEMBED["images"], it=stages.item(urls.absolute(base, r["thumbnail_url"]), **size), evidence="oembed"),
    ))


def manifest_candidates(m: Column) -> Column:
    icons = F.transform(m["icons"], lambda i: stages.candidate("icons", 6, MANIFEST["icons"], it=stages.item(urls.remove_fragment(i["src"]), sizes=i["sizes"], mime_type=i["type"], rel=F.lit("manifest")), evidence="manifest"))
    return F.array_compact(F.concat(F.array(stages.candidate("siteName", 6, MANIFEST["siteName"], m["name"], "manifest"), stages.candidate("title", 6, MANIFEST["title"], m["short_name"], "manifest")), F.coalesce(icons, F.array().cast(T.ArrayType(stages.CANDIDATE)))))


def enrich(pages: DataFrame, responses: DataFrame, oembed: bool = True, manifest: bool = True) -> DataFrame:
    """``pages`` with ``candidates`` and ``base_url`` joined with the best
    oEmbed endpoint's and manifest's responses (``url``, ``status``, ``text``);
    their candidates come behind the others, and ``enrich_warnings`` tells what
    failed. Responses other than 2xx count as failed; one of a URL is read."""
    one = responses.filter(F.col("status").between(200, 299)).groupBy("url").agg(F.min("text").alias("text"))
    best = lambda f: F.get(F.transform(F.array_sort(F.transform(F.filter("candidates", lambda c: c["field_name"] == f), lambda c, i: F.struct((-c["score"]).alias("s"), i.alias("i"), c["candidate_value"].alias("v")))), lambda x: x["v"]), F.lit(0))
    out = pages.withColumn("enrich_warnings", F.array().cast("array<struct<code: string, message: string>>"))
    warn = lambda code: F.array(F.struct(F.lit(code).alias("code"), F.lit(code).alias("message")))
    if oembed:
        out = out.withColumn("_enrich_endpoint", best("oembedEndpoints")).withColumn("_enrich_url", F.regexp_replace("_enrich_endpoint", "^(?:json|xml):", ""))
        out = out.join(one.select(F.col("url").alias("_enrich_url"), F.col("text").alias("_enrich_text")), "_enrich_url", "left")
        rec = F.when(F.col("_enrich_endpoint").startswith("xml:"), oembed_xml(F.col("_enrich_text"))).otherwise(oembed_json(F.col("_enrich_text")))
        out = out.withColumn("oembed", rec)
        good = F.col("_enrich_text").isNotNull() & F.coalesce(*[F.col("oembed")[f] for f in OEMBED_FIELDS]).isNotNull()
        out = out.withColumn("oembed", F.when(good, F.col("oembed"))).withColumn("candidates", F.when(good, F.concat("candidates", oembed_candidates(F.col("oembed"), F.col("base_url")))).otherwise(F.col("candidates")))
        out = out.withColumn("enrich_warnings", F.when(F.col("_enrich_endpoint").isNotNull() & ~good, F.concat("enrich_warnings", warn("oembedFailed"))).otherwise(F.col("enrich_warnings"))).drop("_enrich_endpoint", "_enrich_url", "_enrich_text")
    if manifest:
        out = out.withColumn("_enrich_url", best("manifestUrls")).join(one.select(F.col("url").alias("_enrich_url"), F.col("text").alias("_enrich_text")), "_enrich_url", "left")
        out = out.withColumn("manifest", manifest_json(F.col("_enrich_text"), F.col("_enrich_url")))
        good = F.col("manifest").isNotNull()
        out = out.withColumn("candidates", F.when(good, F.concat("candidates", manifest_candidates(F.col("manifest")))).otherwise(F.col("candidates")))
        out = out.withColumn("enrich_warnings", F.when(F.col("_enrich_url").isNotNull() & ~good, F.concat("enrich_warnings", warn("manifestFailed"))).otherwise(F.col("enrich_warnings"))).drop("_enrich_url", "_enrich_text")
    return out
