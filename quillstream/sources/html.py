"""HTML texts as element arrays, in one pass over each text."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENT = T.ArrayType(T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()),
]))
KEPT = frozenset({"html", "base", "meta", "link", "title", "h1", "script"})
#: Elements whose content is text up to their end tag; entities count in two.
RAW_TEXT = frozenset({"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"})
ENTITIES_IN = frozenset({"title", "textarea"})

_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        name, *values = m.groups()
        out.setdefault(name.lower(), html.unescape(values[0] or values[1] or values[2] or ""))  # of repeated ones the first counts
    return out


def tokenize(text: str | None) -> list[dict]:
    """The kept elements of a text in document order, with the text of
    ``title``, ``h1`` and ``script``. Unclosed ones take what follows."""
    out: list[dict] = []
    headings: list[dict] = []  # open h1, which gather text
    at, n = 0, 0
    text = text or ""
    while m := _MARKUP.search(text, at):
        for h in headings:
            h["text"] += html.unescape(text[at : m.start()])
        at = m.end()
        if m.group(1):
            if m.group(1).lower() == "h1" and headings:
                headings.pop()
            continue
        if not m.group(2):
            continue
        tag, attrs, content = m.group(2).lower(), m.group(3) or "", None
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            content = text[at : end.start() if end else len(text)]
            at = end.end() if end else len(text)
            if tag in ENTITIES_IN:
                content = html.unescape(content)
                for h in headings:
                    h["text"] += content
        if tag in KEPT:
            element = {"idx": n, "tag": tag, "attrs": _attributes(attrs), "text": content if content is not None else "" if tag == "h1" else None}
            out.append(element)
            if tag == "h1":
                headings.append(element)
        n += 1
    for h in headings:
        h["text"] += html.unescape(text[at:])
    return out


@F.arrow_udf(ELEMENT)
def _elements(texts: pa.Array) -> pa.Array:
    """The elements as flat columns with offsets, not as an object for each."""
    ends, found = [0], []
    for t in texts.to_pylist():
        found += tokenize(t)
        ends.append(len(found))
    attrs, stops = [e["attrs"] for e in found], [0]
    for a in attrs:
        stops.append(stops[-1] + len(a))
    text = lambda values: pa.array(values, pa.string())
    maps = pa.MapArray.from_arrays(pa.array(stops, pa.int32()), text([k for a in attrs for k in a]), text([v for a in attrs for v in a.values()]))
    columns = [pa.array([e["idx"] for e in found], pa.int32()), text([e["tag"] for e in found]), maps, text([e["text"] for e in found])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["idx", "tag", "attrs", "text"]))


def html_elements(text: Column) -> Column:
    """Elements of an HTML column; evaluated once for each row, however many
    columns are derived from it."""
    return _elements.asNondeterministic()(text)


def elements_table(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row for each kept element: id, ``idx``, ``tag``, ``attrs``, ``text``."""
    return df.select(id_col, F.explode(html_elements(F.col(html_col))).alias("e")).select(id_col, "e.*")


def first(elements: Column, condition) -> Column:
    return F.get(F.filter(elements, condition), F.lit(0))


def content(element: Column) -> Column:
    """What a meta element says: ``content``, or ``value`` where that is
    missing; an empty one counts."""
    return F.coalesce(element["attrs"]["content"], element["attrs"]["value"])


def meta(elements: Column, **attributes: str) -> Column:
    """The first meta element with one of the attributes of that value."""
    def fits(e: Column) -> Column:
        hit = F.lit(False)
        for name, value in attributes.items():
            hit = hit | F.coalesce(e["attrs"][name.replace("_", "-")] == value, F.lit(False))
        return (e["tag"] == "meta") & hit
    return first(elements, fits)


def base_url(elements: Column, document_url: Column) -> Column:
    """What the links of a page are resolved from."""
    from ..functions import urls

    href = F.trim(first(elements, lambda e: (e["tag"] == "base") & e["attrs"]["href"].isNotNull())["attrs"]["href"])
    return F.coalesce(F.when(href != "", urls.resolve(document_url, href)), document_url)


def raw_metadata(elements: Column) -> Column:
    """All that the metas and links of a page say: ``meta`` (key in lower case,
    and its values in order) and ``links``."""
    metas = F.filter(elements, lambda e: (e["tag"] == "meta") & e["attrs"]["content"].isNotNull())
    key = lambda e: F.lower(F.coalesce(*[F.when(F.trim(e["attrs"][k]) != "", e["attrs"][k]) for k in ("name", "property", "http-equiv")]))
    pairs = F.filter(F.transform(metas, lambda e: F.struct(key(e).alias("k"), e["attrs"]["content"].alias("v"))), lambda p: p["k"].isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))))
    links = F.filter(elements, lambda e: (e["tag"] == "link") & (F.trim(e["attrs"]["rel"]) != "") & (F.trim(e["attrs"]["href"]) != ""))
    fields = ("rel", "href", "type", "sizes", "title")
    return F.struct(grouped.alias("meta"), F.transform(links, lambda e: F.struct(*[e["attrs"][f].alias(f) for f in fields])).alias("links"))
