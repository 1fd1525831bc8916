"""Bytes of responses as text: byte order mark, header, meta, UTF-8."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html

DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType()), T.StructField("charset_source", T.StringType())])
#: Bytes in which a page may declare its charset.
PROBE = 4096
_HEADER = re.compile(r"charset\s*=\s*[\"']?\s*([^\s\"';,]+)", re.I)
_MARKS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
# Labels that stand for a charset as browsers read them.
LABELS = {
    "windows-1252": "latin1 latin-1 iso-8859-1 iso8859-1 iso_8859-1 l1 ascii us-ascii ansi_x3.4-1968 windows-1252 cp1252 x-cp1252",
    "shift_jis": "shift_jis shift-jis sjis x-sjis ms_kanji windows-31j csshiftjis", "utf-8": "utf-8 utf8 unicode-1-1-utf-8",
}
# Charsets that pages are in, by the names of their codecs. No other
# codec reads a page, whatever its label.
CODECS = frozenset(
    "utf-8 utf-16 utf-16-le utf-16-be utf-32 utf-32-le utf-32-be cp866 cp874 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 cp437 cp850 cp852 cp932 cp949 "
    "iso8859-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-9 iso8859-10 iso8859-11 iso8859-13 iso8859-14 iso8859-15 iso8859-16 "
    "koi8-r koi8-u mac-roman mac-cyrillic gb2312 gbk gb18030 big5 big5hkscs euc_jp iso2022_jp shift_jis euc_kr tis-620".split()
)
_LABEL = {label: name for name, labels in LABELS.items() for label in labels.split()}


def canonical_label(label: str | None) -> str | None:
    """The charset that a label stands for; null if it is unknown."""
    if not label:
        return None
    low = label.strip().lower()
    if low in _LABEL:
        return _LABEL[low]
    try:
        return low if codecs.lookup(low).name in CODECS else None
    except (LookupError, ValueError):
        return None


def _declared(raw: bytes) -> str | None:
    """The charset that a page's first meta elements declare, by ``charset`` or
    as a content type; comments, scripts and texts declare nothing."""
    probe = raw[:PROBE]
    if b"charset" not in probe.lower():
        return None
    for e in html.tokenize(probe.decode("latin-1")):
        attrs = (e["attrs"] or {}) if e["tag"] == "meta" else {}
        if (label := (attrs.get("charset") or "").strip()):
            return label
        if (attrs.get("http-equiv") or "").strip().lower() == "content-type" and (m := _HEADER.search(attrs.get("content") or "")):
            return m.group(1)
    return None


def _decode_as(raw: bytes, charset: str) -> str:
    codec = {"windows-1252": "cp1252", "shift_jis": "cp932"}.get(charset, charset)
    text = raw.decode(codec, "replace")
    return text


def decode(raw: bytes | None, content_type: str | None) -> tuple[str, str | None, str]:
    """(text, charset, where it was said): by mark, header, meta, or as UTF-8
    with what is no UTF-8 replaced."""
    if not raw:
        return "", "utf-8", "fallback"
    for mark, codec in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace"), codec.removesuffix("-le").removesuffix("-be") if codec != "utf-8" else codec, "bom"
    m = _HEADER.search(content_type or "")
    if m and (name := canonical_label(m.group(1))):
        return _decode_as(raw, name), name, "header"
    if name := canonical_label(_declared(raw)):
        return _decode_as(raw, name), name, "meta"
    return raw.decode("utf-8", "replace"), "utf-8", "fallback"


@F.pandas_udf(DECODED)
def _decoded(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    rows = [decode(bytes(b) if b is not None else None, c if isinstance(c, str) else None) for b, c in zip(body, content_type, strict=True)]
    return pd.DataFrame(rows, columns=["text", "charset", "charset_source"])


def decode_body(body: Column, content_type: Column) -> Column:
    """Struct of text, charset and source; evaluated once for each row."""
    return _decoded.asNondeterministic()(body, content_type)


def header_charset(content_type: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?\s*([^\s\"';,]+)", 1)), F.lit(""))
