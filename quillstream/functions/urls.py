"""URLs as Column expressions. Null stands for what is no acceptable URL."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Schemes that a loosely typed URL may not have.
REJECTED_SCHEMES = ("mailto", "tel", "sms", "javascript", "data", "file", "ftp", "about", "chrome", "blob")
# What a link in a page is not resolved from.
UNRESOLVED_SCHEMES = ("javascript", "mailto", "tel", "data")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return _host_in(authority(url))


def port(url: Column) -> Column:
    """The port as written; empty if none is."""
    return F.regexp_extract(authority(url), r":(\d*)$", 1)


def path(url: Column) -> Column:
    return _part(url, 3)


def has_query(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "").contains("?")


def remove_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def is_web(url: Column) -> Column:
    """http or https with a host, and nothing that no URL has."""
    return _is_web(url, scheme(url), authority(url))


def _is_web(url: Column, scheme: Column, authority: Column) -> Column:
    return scheme.isin("http", "https") & (_host_in(authority) != "") & ~url.rlike(r"^[^?#]*[\s<>\"{}|\\^`]")


def encode_beyond_ascii(url: Column) -> Column:
    """Characters beyond ASCII as percent-escaped UTF-8."""
    letters = lambda u: F.array_join(F.transform(F.split(u, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), F.url_encode(c)).otherwise(c)), "")
    return let(url, lambda u: F.when(u.rlike(r"[^\x00-\x7f]"), letters(u)).otherwise(u))


def _tidy_authority(url: Column) -> Column:
    return _tidied(scheme(url), authority(url))


def _tidied(scheme: Column, authority: Column) -> Column:
    """The host in lower case, without a port that is the scheme's own."""
    def tidy(x: Column) -> Column:
        s, a = x["s"], x["a"]
        user, host, port = F.regexp_extract(a, r"^([^@]*@)", 1), _host_in(a), F.regexp_extract(a, r":(\d*)$", 1)
        return let(port, lambda p: F.concat(user, host, F.when((p == "") | (s == "http") & (p == "80") | (s == "https") & (p == "443"), "").otherwise(F.concat(F.lit(":"), p))))

    return let(F.struct(scheme.alias("s"), authority.alias("a")), tidy)


def _host_in(authority: Column) -> Column:
    return F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def normalize_for_request(url: Column) -> Column:
    """No fragment, scheme and host in lower case, https where no scheme is
    given, a path of at least ``/``, no default port; the query as it is."""
    def tidy(u: Column) -> Column:
        query = F.when(has_query(u), F.concat(F.lit("?"), _part(u, 4))).otherwise("")
        return F.concat(scheme(u), F.lit("://"), _tidy_authority(u), F.when(path(u) == "", "/").otherwise(path(u)), query)

    fix = lambda u: F.when(scheme(u) == "", F.concat(F.lit("https:"), F.when(u.startswith("//"), u).otherwise(F.concat(F.lit("//"), u)))).otherwise(u)
    return let(remove_fragment(encode_beyond_ascii(url)), lambda u: let(fix(u), tidy))


normalize_for_cache_key = normalize_for_request


def parse_loose(raw: Column) -> Column:
    """A URL as people type it: schemes that lead to no page are rejected,
    those of the web need a host, a rooted path is none, and anything else is
    taken for a host with a path."""
    def read(t: Column) -> Column:
        rejected = F.lower(t).rlike(f"^(?:{'|'.join(REJECTED_SCHEMES)}):")
        full = t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
        return (
            F.when(rejected | (t == ""), None).when(t.startswith("//"), F.concat(F.lit("https:"), t))
            .when(full, t).when(t.startswith("/"), None).otherwise(F.concat(F.lit("https://"), t))
        )

    return let(let(trimmed(raw), read), lambda u: F.when(is_web(u), normalize_for_request(u)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def ensure_https(url: Column) -> Column:
    return F.when(scheme(url) == "http", F.regexp_replace(url, "^(?i)http:", "https:")).when(scheme(url) == "", F.concat(F.lit("https://"), F.regexp_replace(url, "^//", ""))).otherwise(url)


def apply_proxy(url: Column, template: str | None) -> Column:
    """``template`` with the URL in place of ``{urlEncoded}``, else of
    ``{url}``, else behind it; null where that is no URL of the web. A blank
    template leaves the URL as it is."""
    if not template or not template.strip():
        return url
    encoded = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    if "{urlEncoded}" in template:
        out = F.replace(F.lit(template), F.lit("{urlEncoded}"), encoded)
    elif "{url}" in template:
        out = F.replace(F.lit(template), F.lit("{url}"), url)
    else:
        out = F.concat(F.lit(template), url)
    return F.when(is_web(out), out)


def remove_dots(p: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    kept = F.aggregate(
        F.split(p, "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    ended = lambda joined: F.concat(joined, F.when(p.rlike(r"(?:^|/)\.{1,2}$") & ~joined.endswith("/"), "/").otherwise(""))
    return F.when(p.contains("."), let(F.array_join(kept, "/"), ended)).otherwise(p)


def resolve_any(base: Column, ref: Column) -> Column:
    """A reference against a base, as the standard has it; any scheme."""
    fields = lambda u, tag: [F.lower(_part(u, 1)).alias(f"{tag}s"), authority(u).alias(f"{tag}a"), path(u).alias(f"{tag}p"), F.when(has_query(u), F.concat(F.lit("?"), _part(u, 4))).otherwise("").alias(f"{tag}q")]

    def join(x: Column) -> Column:
        root = F.concat(x["bs"], F.lit("://"), x["ba"])
        folder = F.regexp_replace(x["bp"], r"[^/]*$", "")
        merged = F.when(x["rp"].startswith("/"), x["rp"]).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), x["rp"]))
        own = F.concat(root, x["bp"], F.when(x["rq"] != "", x["rq"]).otherwise(x["bq"]))
        relative = F.when(x["rp"] == "", own).otherwise(F.concat(root, let(merged, remove_dots), x["rq"]))
        fragment = F.when(x["r"].contains("#"), F.concat(F.lit("#"), _part(x["r"], 5))).otherwise("")
        return F.when(x["rs"] != "", x["r"]).when(x["r"].startswith("//"), F.concat(x["bs"], F.lit(":"), x["r"])).otherwise(F.concat(relative, fragment))

    both = lambda y: let(F.struct(*fields(y["b"], "b"), *fields(y["r"], "r"), y["r"].alias("r")), join)
    return F.when(base.isNotNull() & ref.isNotNull(), let(F.struct(base.alias("b"), ref.alias("r")), both))


def resolve(base: Column, raw: Column) -> Column:
    """A link of a page against its base: null for blank ones, fragments and
    schemes that lead to no page; http and https with a host only."""
    def of_parts(x: Column) -> Column:
        u, s, a = x["u"], x["s"], x["a"]
        return F.when(_is_web(u, s, a), F.concat(s, F.lit("://"), _tidied(s, a), F.substring(u, F.length(s) + F.length(a) + 4, F.length(u))))

    tidy = lambda u: let(F.struct(u.alias("u"), scheme(u).alias("s"), authority(u).alias("a")), of_parts)
    unfit = lambda t: (t == "") | t.startswith("#") | F.lower(t).rlike(f"^(?:{'|'.join(UNRESOLVED_SCHEMES)}):")
    return let(trimmed(raw), lambda t: F.when(~unfit(t), let(encode_beyond_ascii(resolve_any(base, t)), tidy)))


def absolute(base: Column, raw: Column) -> Column:
    """As ``resolve``, without the fragment: what becomes a candidate."""
    return remove_fragment(resolve(base, raw))


def resolve_all(base: Column, raws: Column) -> Column:
    return F.array_compact(F.transform(raws, lambda r: resolve(base, r)))


def compare_form(url: Column) -> Column:
    """For telling equal pages: no fragment, scheme and host in lower case."""
    u = remove_fragment(url)
    rest = F.substring(u, F.length(scheme(u)) + F.length(authority(u)) + 4, F.length(u))
    return F.when(authority(u) != "", F.concat(scheme(u), F.lit("://"), F.lower(authority(u)), rest)).otherwise(u)


def effective_port(url: Column) -> Column:
    return F.when(port(url) != "", port(url).cast("int")).when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & effective_port(a).eqNullSafe(effective_port(b))


def cache_key(signature: Column, prefix: str = "meta:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(signature, 256))


def _octet(h: Column, n: int) -> Column:
    return F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", n).try_cast("int")


def unsafe_host(h: Column) -> Column:
    """Why a host is no public target, by its form alone; null if nothing
    speaks against it. Case and a stop at the end don't matter. Four plain
    octets are an IPv4 address; any other host that is all figures, stops and
    hexadecimal parts might be read as one and is refused."""
    def read(h: Column) -> Column:
        a, b, c = _octet(h, 1), _octet(h, 2), _octet(h, 3)
        octet = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
        v4 = h.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
        numeric = h.rlike(r"^[0-9.]+$") | h.rlike(r"^(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+))*$")
        private = (a == 10) | (a == 127) | (a == 0) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168) | (a == 169) & (b == 254) | (a == 100) & b.between(64, 127)
        reserved = (a >= 224) | (a == 192) & (b == 0) & c.isin(0, 2) | (a == 198) & (b.isin(18, 19) | (b == 51) & (c == 100)) | (a == 203) & (b == 0) & (c == 113)
        local = h.rlike(r"^(?:localhost|metadata|.*\.localhost|.*\.local|.*\.internal)$")
        return (
            F.when(h == "", "missing_host").when(local, "local_name").when(v4 & private, "private_ipv4").when(v4 & reserved, "reserved_ipv4")
            .when(numeric & ~v4, "ambiguous_numeric")
        )

    bare = F.regexp_replace(F.lower(h), r"\.$", "")
    return F.coalesce(let(bare, read), F.when(h.contains(":"), unsafe_ipv6(bare)))


@F.pandas_udf(T.StringType())
def unsafe_ipv6(hosts: pd.Series) -> pd.Series:
    """Why an IPv6 literal is no public target; null if nothing speaks
    against it or it is none."""
    return pd.Series([_ipv6_reason(h) for h in hosts], dtype=object)


def _ipv6_reason(h: str | None) -> str | None:
    if h is None or ":" not in h:
        return None
    text = h[1:-1] if h.startswith("[") and h.endswith("]") else h
    if "%" in text:
        return "scoped_ipv6"
    try:
        ip = ipaddress.IPv6Address(text)
    except ValueError:
        return "invalid_ipv6"
    raw = ip.packed
    if ip.is_unspecified or ip.is_loopback:
        return "local_ipv6"
    inside = lambda net: ip in ipaddress.IPv6Network(net)
    if any(inside(n) for n in ("fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8", "2001:db8::/32")):
        return "reserved_ipv6"
    # Prefixes behind which an IPv4 address stands.
    if inside("::ffff:0:0/96") or inside("::/96") or inside("64:ff9b::/96"):
        v4 = ipaddress.IPv4Address(raw[12:])
        return "embedded_ipv4" if v4.is_private or v4.is_multicast or v4.is_reserved or v4.is_link_local or not v4.is_global else None
    return None
