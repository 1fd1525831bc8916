import pytest
from pyspark.sql import functions as F
from quillstream.functions import text, urls
from quillstream.operators import cache, ranking, redirects
from quillstream.plans import extract, parse, queries
from quillstream.sources import charset, html, linked_data


def column(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_loose_urls(spark):
    got = column(spark, urls.parse_loose, "", "mailto:a@b", "/only/path", "example.com/abc", "//example.com/foo", "HTTP://EXAMPLE.com:80?q#f", None, "ftp://x", "file:8080", " http://a.b/ü ", "http://a b/")
    assert got == [None, None, None, "https://example.com/abc", "https://example.com/foo", "http://example.com/?q", None, None, None, "http://a.b/%C3%BC", None]


@pytest.mark.parametrize(("base", "ref", "want"), [
    ("https://a.b/c/d?q", "../x", "https://a.b/x"), ("https://a.b/c/d", "e#f", "https://a.b/c/e#f"), ("http://a.b/c", "//h/p", "http://h/p"), ("http://a.b", "x", "http://a.b/x"),
    ("http://a.b/c", "javascript:1", None), ("http://a.b/c", "#x", None), ("http://a.b/c", "  ", None), ("http://a.b/c/d", "?z", "http://a.b/c/d?z"), ("http://a.b/c/", "./../..", "http://a.b/"), ("http://a.b/c", "https:/canonical", None),
])
def test_resolution(spark, base, ref, want):
    assert column(spark, lambda x: urls.resolve(F.lit(base), x), ref) == [want]


def test_unsafe_hosts(spark):
    refused = [
        "localhost", "LOCALHOST.", "a.localhost", "printer.local", "db.internal", "metadata", "metadata.", "127.1", "2130706433", "0x7f000001", "0x7f.0.0.1", "127.0x0.0.1", "0x7f.0x0.0x0.0x1", "1.2.3.4.5",
        "010.0.0.1", "256.1.1.1", "1..2.3", "10.0.0.1", "192.0.0.1", "192.0.2.1", "198.18.0.1", "203.0.113.9", "224.0.0.1", "[::1]", "[0:0:0:0:0:0:0:1]", "[::]", "[::ffff:127.0.0.1]", "[0:0:0:0:0:ffff:0a00:0001]",
        "[::127.0.0.1]", "[64:ff9b::192.168.1.1]", "[fc00::1]", "[fd12:3456::1]", "[fe80::1]", "[fe80::1%1]", "[fec0::1]", "[ff02::1]", "[2001:db8::1]", "2001:db8:1", ":::", "",
    ]
    allowed = ["example.com", "0x.example", "192.0.1.1", "192.0.16.1", "8.8.8.8", "8.8.8.8.", "nas.lan", "hub.home.arpa", "metadata.example", "[2001:4860:4860::8888]", "[2606:4700:4700:0:0:0:0:1111]", "[::ffff:8.8.8.8]"]
    got = column(spark, urls.unsafe_host, *refused, *allowed, None)
    assert [h for h, why in zip(refused, got, strict=False) if why is None] == []
    assert [h for h, why in zip(allowed, got[len(refused) :], strict=False) if why is not None] == [] and got[-1] is None


def test_texts_and_dates(spark):
    assert column(spark, text.clean, " a 　b\x00 ", "  ", None) == ["a b", None, None]
    assert column(spark, text.split_keywords, "a; B,b ,,c") == [["a", "B", "c"]]
    assert column(spark, text.lenient_int, "0x10", "-5", "12.9", "x") == [16, -5, 12, None]
    stamp = lambda x: F.date_format(text.meta_date(x), "yyyy-MM-dd'T'HH:mm:ss")
    assert column(spark, stamp, "1700000000", "1700000000000", "20240105", "2024-01-05 10:00:00", "junk") == ["2023-11-14T22:13:20", "2023-11-14T22:13:20", "2024-01-05T00:00:00", "2024-01-05T10:00:00", None]


def test_tokenizer():
    got = html.tokenize('<!-- <title>no</title> --><html LANG=en><title>A &amp; <b>B</title><meta content=1 content=2 name="x"><script>var a="</p><h1>";</script><h1>Big <i>word</i></h1><script type="application/ld+json">{"a":1}')
    assert [(e["tag"], e["text"]) for e in got] == [("html", None), ("title", "A & <b>B"), ("meta", None), ("script", 'var a="</p><h1>";'), ("h1", "Big word"), ("script", '{"a":1}')]
    assert got[0]["attrs"] == {"lang": "en"} and got[2]["attrs"]["content"] == "1" and html.tokenize(None) == []


def test_charsets():
    assert charset.decode(b"\x80", "text/html; charset=iso-8859-1") == ("€", "windows-1252", "header")
    assert charset.decode(b"\xef\xbb\xbfa", "text/html; charset=latin1")[2] == "bom" and charset.decode(b'<meta charset="latin1">\xe9', None)[0].endswith("é")
    for label in ("rot13", "hex", "undefined", "base64", "idna", "unicode_escape", "utf-7", "no such", "a\x00b"):
        assert charset.decode(b"<p>a", f"text/html; charset={label}") == ("<p>a", "utf-8", "fallback")
    assert charset.decode(b"<!-- <meta charset=koi8-r> --><meta http-equiv=Content-Type content='text/html; charset=windows-1251'>\xe0", None)[1:] == ("windows-1251", "meta")
    assert charset.decode(b"<!-- <meta charset=koi8-r> --><p>", None)[2] == "fallback" and charset.canonical_label("EUC-JP") == "euc-jp"
    assert charset.decode(b"\xff", None) == ("�", "utf-8", "fallback") and charset.decode(None, None)[0] == ""


def test_graph_limits():
    many = ["[" + ",".join('{"name":"x"}' for _ in range(400)) + "]", '{"name":"y"}']
    assert len(linked_data.collect(many, linked_data.Limits())["nodes"]) == 250
    got = linked_data.collect(["{bad", "null", '{"@id":"a","x":{"name":"n"}}', '{"@id":" a ","y":{"url":"u"}}', None], linked_data.Limits())
    assert got["malformed"] == 2 and len(got["nodes"]) == 3 and not got["limit_reached"]
    assert linked_data.collect(['{"name":"' + "x" * 40 + '"}'], linked_data.Limits(characters=16))["limit_reached"]


def test_page(spark):
    page = (
        '<html lang="en"><base href="/base/"><title> T </title><meta property="og:title" content="OG"><meta name="twitter:title" content="TW"><meta property="og:type" content="website">'
        '<meta property="og:image" content="a.png"><meta property="og:image:secure_url" content="https://s.example/a.png"><meta property="og:image:width" content="1200"><meta name="keywords" content="x; y,X">'
        '<link rel="canonical icon" href="/c#f"><link rel="apple-touch-icon" href="i.svg"><script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"Site"},{"@type":"Article","headline":"Head","datePublished":1700000000}]}</script>'
    )
    df = spark.createDataFrame([(1, "https://e.example/", page), (2, "https://e.example/x", None), (3, "https://e.example/x", "")], "title_id int, url string, html string")
    rows = {r["title_id"]: r for r in parse.parse_html(df, options=parse.Options(raw=True)).collect()}
    r = rows[1]
    assert (r["title"], r["site_name"], r["locale"], r["kind"], r["canonical_url"]) == ("OG", "Site", "en", "article", "https://e.example/c")
    assert [i["url"] for i in r["images"]] == ["https://s.example/a.png"] and r["images"][0]["width"] == 1200 and [i["url"] for i in r["icons"]] == ["https://e.example/base/i.svg"]
    assert r["keywords"] == ["x", "y"] and str(r["published_at"]) == "2023-11-14 22:13:20" and r["status"] == "success" and r["raw"]["meta"]["og:title"] == ["OG"]
    assert rows[2]["is_empty"] and rows[3]["title"] is None


def test_fields_not_asked_for_are_not_made(spark):
    page = '<meta property="og:image" content="a.png"><meta property="og:image:alt" content="x"><meta name="twitter:image" content="/a.png"><meta name="twitter:image" content="/b.png"><link rel=icon href=i.png>'
    made = parse.parse_html(spark.createDataFrame([(1, "https://e.example/", page)], "id int, url string, html string")).select("images")
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    assert "og:image" in plan and "twitter:image" in plan and [t for t in ("og:description", "twitter:title", "html[lang]", "link[rel=icon]", "article:tag") if t in plan] == []
    assert [(i["url"], i["alt"]) for i in made.collect()[0]["images"]] == [("https://e.example/a.png", "x")]


def test_pages_of_parts_are_spread(spark, tmp_path):
    spark.range(1, 201).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = queries.open_graph_images(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(made) == 400 and len({r["task"] for r in made}) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    k7 = sorted((r["place"], r["url"], r["width"], r["height"], r["alt"]) for r in made if r["p_partkey"] == 7)
    assert k7 == [(0, "https://p.example/a/7.png", 7, None, "one"), (1, "https://p.example/x/b/7.png", None, 7, None)]


def test_ranking(spark):
    item = "struct<url: string, width: int, height: int, mime_type: string, alt: string, byte_size: bigint>"
    i = lambda u, w=None, h=None, a=None: (u, w, h, None, a, None)
    rows = [(1, "title", 0, 0, "a", 0.5, None, "first", None), (1, "title", 0, 1, "a", 0.5, None, "second", None), (1, "title", 0, 2, "a", float("nan"), None, "nan", None), (1, "title", 0, 0, "a", 0.5, None, "first", None),
            (1, "images", 0, 0, "og", 0.8, None, None, i("u", 1)), (1, "images", 0, 1, "tw", 0.8, None, None, i("u", None, 2, "p")), (1, "images", 0, 2, "x", 0.8, None, None, i("u", 9, None, "q")), (1, "images", 0, 3, "x", 0.7, None, None, i("v"))]
    df = spark.createDataFrame(rows, f"doc_id int, field_name string, stage_ord int, seq int, source string, score double, evidence string, candidate_value string, item {item}")
    ranked = ranking.rank(ranking.with_index(df))
    assert ranking.winners(ranked).collect()[0]["title"] == "first" and ranked.count() == 6
    images = ranking.collections(ranked, {"images": 1}).collect()
    assert [(r["url"], r["width"], r["height"], r["alt"]) for r in images] == [("u", 1, 2, "p")]
    chosen = {(r["source"], r["value_key"]): r["selected"] for r in ranking.decisions(ranked, {"images": 1}).filter("field_name = 'images'").collect()}
    assert chosen == {("og", "u"): True, ("tw", "u"): True, ("x", "u"): False, ("x", "v"): False}
    assert ranking.collections(ranked, {"images": 0}).count() == 0


def test_redirects(spark):
    u = lambda x: f"https://e.example/{x}"
    edges = spark.createDataFrame([(u("a"), 302, "/b"), (u("b"), 301, "c"), (u("c"), 302, "b"), (u("bad"), 302, "mailto:x"), (u("d"), 302, "/e"), (u("e"), 200, None)], "from_url string, status int, location string")
    asked = spark.createDataFrame([(u("a"), 1), (u("d"), 2), (u("bad"), 3), (None, 4), (u("none"), 5), (u("d"), 2)], "url string, hops_id int")
    got = sorted(((r["hops_id"], r["final_url"], len(r["hops"]), r["failure"]) for r in redirects.follow(asked, edges).collect()), key=str)
    assert got == sorted([(1, u("c"), 2, "redirectLoop"), (2, u("e"), 1, None), (2, u("e"), 1, None), (3, u("bad"), 0, "invalidRedirect"), (4, None, 0, None), (5, u("none"), 0, None)], key=str)
    assert redirects.follow(asked.filter("hops_id = 1"), edges, 1).collect()[0]["failure"] == "redirectLimit" and redirects.follow(asked.filter("hops_id = 2"), edges, 0).collect()[0]["failure"] == "redirectLimit"


def test_cache(spark):
    schema = "cache_key string, kind string, created_at_ms bigint, lifetime_kind string, duration_ms bigint, last_access_ms bigint, payload string"
    rows = [("a", "k", 0, "expiresAfter", 10, 1, "{}"), ("b", "k", 0, "neverExpires", None, 2, "{}"), ("c", "k", 0, "expiresAfter", 0, 3, "{bad"), ("d", "k", 0, "storeDefault", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    keys = lambda x: sorted(r["cache_key"] for r in x.collect())
    assert keys(cache.purge(df, 11, 5)) == ["b"] and keys(cache.purge(df, 10, 20)) == ["a", "b"] and keys(cache.evict(df, 2)) == ["b", "c"] and keys(cache.evict(df, 0)) == []
    assert cache.read(spark.createDataFrame([("a",), ("b",)], "cache_key string"), df, 11, 0, 5).filter("hit").count() == 1
    new = cache.write(df, spark.createDataFrame([("a", "k", 5, "neverExpires", None, 0, "[1]"), ("z", "k", -99, "expiresAfter", 1, 0, "{}")], schema), 6)
    assert keys(new) == ["a", "b", "c", "d"] and new.filter("cache_key = 'a'").collect()[0]["payload"] == "[1]"


def test_batch(spark):
    kind = {"Content-Type": "text/html; charset=utf-8"}
    page = lambda title, more="": f"<title>{title}</title>{more}".encode()
    endpoint = '<link rel="alternate" type="application/json+oembed" href="/o.json"><link rel=manifest href="/m.json">'
    responses = spark.createDataFrame(
        [
            ("https://A.example/x", 302, {"LOCATION": "/Y#part"}, None, None), ("https://a.example:443/Y", 200, {**kind, "content-type": "text/html"}, page("Moved"), None),
            ("https://b.example/", 200, kind, page("Long", "<p>" + "x" * 600_000), None), ("https://c.example/", 200, {"Content-Type": "text/html"}, page("No charset"), None), ("https://d.example/", 500, kind, page("Bad"), None),
            ("https://e.example/", 200, {"content-type": "text/html; charset=rot13"}, page("Odd"), None), ("https://f.example/", 200, kind, page("Enriched", endpoint), None), ("https://g.example/", 200, kind, page("Broken", endpoint), None),
        ],
        "url string, status int, headers map<string,string>, body binary, error string",
    )
    remote = spark.createDataFrame([("https://f.example/o.json", 200, '{"type":"rich","title":"t","author_name":"A. Writer","provider_name":"P"}'), ("https://f.example/m.json", 200, '{"name":"App"}'), ("https://g.example/o.json", 404, "")], "url string, status int, text string")
    asked = ["HTTPS://a.example/x", "https://b.example", "c.example", "https://d.example/", "https://e.example/", "https://f.example/", "https://g.example/", "https://h.example/", "mailto:x", "https://a.example/x#top", None]
    requests = spark.createDataFrame(list(enumerate(asked)), "input_pos int, url string")
    rows = {r["input_pos"]: r for r in extract.extract_batch(requests, responses, remote=remote).collect()}
    codes = lambda i: [w["code"] for w in rows[i]["warnings"] or []]
    assert len(rows) == len(asked) and rows[0]["title"] == "Moved" and rows[9]["title"] == "Moved" and rows[0]["final_url"].startswith("https://a.example/Y")
    assert (rows[1]["title"], rows[1]["status"], codes(1)) == ("Long", "partial", ["truncatedHtml"]) and (rows[2]["status"], codes(2)) == ("success", ["charsetFallback"])
    assert (rows[3]["error_code"], rows[3]["retryable"], rows[3]["title"], codes(3)) == ("httpStatus", True, None, []) and (rows[4]["title"], codes(4)) == ("Odd", ["charsetFallback"])
    assert (rows[5]["title"], rows[5]["site_name"], rows[5]["status"], codes(5)) == ("t", "P", "success", []) and (rows[6]["status"], codes(6)) == ("partial", ["oembedFailed", "manifestFailed"])
    assert rows[7]["error_code"] == "network" and rows[8]["error_code"] == "invalidUrl" == rows[10]["error_code"] and rows[8]["final_url"] == "about:blank"
    # Other spellings of one header don't end the job.
    assert parse.parse_response(responses.filter("url = 'https://a.example:443/Y'")).collect()[0]["title"] == "Moved"
    merged = spark.range(1).select(redirects.merge_headers(F.create_map(F.lit("Accept"), F.lit("a"), F.lit("accept"), F.lit("b")), F.create_map(F.lit("X"), F.lit("1"), F.lit("x"), F.lit("2"))).alias("m"))
    assert merged.collect()[0]["m"] == {"accept": "a", "x": "1"}
