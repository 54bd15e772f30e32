"""Content parsing and string functions."""

import gzip

import duckdb
from pyspark.sql import functions as F

from siltstone.functions import content as C
from siltstone.functions import strings as S
from siltstone.operators import content, store
from siltstone.plans import catalog


def test_charsets():
    assert C.detect_charset("é".encode(), "text/html; charset=ISO-8859-1") == ("cp1252", "header")
    assert C.detect_charset(b"\xef\xbb\xbfx") == ("utf-8", "mark")
    assert C.detect_charset(b'<meta http-equiv=x content="text/html; charset=gb2312">') == ("gb18030", "meta")
    assert C.detect_charset(b'<?xml version="1.0" encoding="EUC-JP"?>', "text/xml; charset=none-such") == ("euc_jp", "meta")
    assert C.detect_charset("naïve".encode()) == C.detect_charset("naïve €".encode()[:-1]) == ("utf-8", "guess")
    assert C.detect_charset("日本語の文章です".encode("shift_jis")) == ("shift_jis", "guess")
    assert C.detect_charset("un café à la carte".encode("latin-1")) == ("cp1252", "guess")
    assert C.detect_charset(b"") == ("utf-8", "guess")


def test_inflate():
    data = gzip.compress(b"x" * 5000)
    assert C.inflate(data) == (b"x" * 5000, False) and C.inflate(b"plain") == (b"plain", False)
    part, cut = C.inflate(data[:-10])
    assert cut and part and set(part) == {120}
    assert C.inflate(data, 100)[1]


def test_html():
    page = '<html><head><title> A  &amp; B</title><base href="/d/"><meta name=Keywords content="k"><link rel=Stylesheet href=s.css></head><body><p>one<b>two</b><table><tr><td>c<td><a href="x?y=1&amp;z">go <i>on</i></a></table><script src=j.js>var a = "<p>";</script><a name=n>no</a></body>'
    p = C.parse_html(page, "http://h.com/a/b")
    assert p["title"] == "A & B" and p["base"] == "http://h.com/d/" and p["metas"] == [{"name": "keywords", "content": "k"}]
    assert [(x["type"], x["href"], x["rel"], x["text"], x["row"], x["cell"]) for x in p["links"]] == [("link", "http://h.com/d/s.css", "stylesheet", "", None, None), ("a", "http://h.com/d/x?y=1&z", None, "go on", 1, 2), ("script", "http://h.com/d/j.js", None, "", None, None)]
    assert p["text"] == "one two\nc\ngo on\nno"
    assert C.parse_html(None, None)["links"] == [] and C.parse_html("<a href='http://[x'>", "http://h")["links"][0]["href"] == "http://[x"


def test_feeds():
    rss = '<?xml version="1.0"?><!DOCTYPE rss [<!ENTITY a "b">]><rss><channel><title>T</title><link>http://h/</link><item><title>one &lt;b&gt;x&lt;/b&gt;</title><link>http://h/1</link><category>c</category><description>&lt;a href="2"&gt;in&lt;/a&gt;</description><pubDate>d</pubDate></item>'
    whole = C.parse_feed(rss + "</channel></rss>")
    assert (whole["kind"], whole["title"], whole["link"], whole["truncated"]) == ("rss", "T", "http://h/", False)
    assert whole["items"] == [{"title": "one x", "link": "http://h/1", "published": "d", "author": None, "categories": ["c"], "description": "in", "links": ["http://h/2"]}]
    cut = C.parse_feed(rss + "<item><title>tw")
    assert cut["truncated"] and cut["items"] == whole["items"] and cut["title"] == "T"
    atom = C.parse_feed('<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><link rel="self" href="s"/><link href="http://h/"/><entry><title>e</title><link href="http://h/e"/><author><name>N</name></author><updated>u</updated></entry></feed>')
    assert atom["kind"] == "atom" and atom["link"] == "http://h/" and atom["items"][0]["author"] == "N"
    assert C.parse_feed("<html>") is None and C.parse_feed(None) is None and C.parse_feed("<rss><chan")["truncated"]


def test_parsed_records(spark, tmp_path):
    rows = [(1, "http://h/a", "text/html", b"<title>t</title><a href=/b>x</a>"), (2, "http://h/f", "text/xml", b"<rss><channel><title>F</title><item><link>http://h/1</link></item></channel></rss>"), (3, "http://h/robots.txt", "text/plain", b"User-agent: *"), (4, "http://h/t", "text/plain", gzip.compress(b"plain")), (5, None, None, None), (6, "http://h/e", None, None), (7, "http://h/p", "image/png", b"\x89PNG")]
    df = spark.createDataFrame(rows, "id long, url string, content_type string, body binary")
    got = {r.id: r for r in content.parse_records(df).collect()}
    assert {i: r.parsed_as for i, r in got.items()} == {1: "HTML", 2: "FEED", 4: "TEXT", 6: "OTHER", 7: "REJECT"}
    assert got[1].title == "t" and got[1].links == ["http://h/b"] and got[2].links == ["http://h/1"] and got[4].plain == "plain"
    out = content.multi_output(content.parse_records(df), str(tmp_path / "o"))
    assert {n: t.count() for n, t in out.items()} == {"metadata": 5, "text": 3, "links": 2}


def first(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_strings(spark):
    f = lambda column, **v: first(spark, column, **v)
    fields = ["a\tb", "c\\", "", "d\ne"]
    assert f(S.split_escaped(S.join_escaped([F.col(c) for c in "wxyz"])), **dict(zip("wxyz", fields, strict=True))) == fields
    assert bytes(f(S.from_base64(F.col("a")), a="-_8")) == b"\xfb\xff" and bytes(f(S.from_hex(F.col("a")), a="0a FF")) == b"\n\xff"
    assert f(S.from_hex(F.col("a")), a="0g") is None and f(S.to_hex(S.from_hex(F.col("a"))), a="AB") == "ab"
    p = F.array(F.lit("a"), F.lit("abc"), F.lit("x"))
    assert f(F.struct(S.matches_prefix(F.col("a"), p), S.shortest_prefix(F.col("a"), p), S.longest_prefix(F.col("a"), p), S.longest_suffix(F.col("a"), p)), a="abcx") == (True, "a", "abc", "x")
    assert f(F.struct(S.index_of(F.col("a"), F.lit("c")), S.index_of(F.col("a"), F.lit("q")), S.leading_long(F.lit(" -12x"))), a="abc") == (2, -1, -12)
    c = f(S.cookie(F.col("a")), a='id="v=1"; Domain=.Foo.com; Path=/p; Max-Age=60; Secure')
    assert (c.name, c.value, c.domain, c.path, c.max_age, c.secure, c.http_only) == ("id", "v=1", "foo.com", "/p", 60, True, False)
    assert f(F.struct(S.cookie_domain_matches(F.lit("a.foo.com"), F.col("a")), S.cookie_domain_matches(F.lit("afoo.com"), F.col("a")), S.cookie_path_matches(F.lit("/pq"), F.lit("/p")), S.cookie_path_matches(F.lit("/p/q"), F.lit("/p"))), a="foo.com") == (True, False, False, True)
    assert f(S.repaired_url(F.col("a")), a=" http://h/a b/%7e//x/./%zz%c3 ") == "http://h/a%20b/~/x/%25zz%C3"
    assert f(S.marked_www(F.col("a")), a="http://www.foo.com/p") == "http://foo.com!www/p" and f(S.unmarked_www(S.marked_www(F.col("a"))), a="http://www.foo.com/p") == "http://www.foo.com/p"
    assert [f(S.valid_domain(F.col("a")), a=x) for x in ("foo.com", "-a.com", "a..com", "foo.1", "x")] == [True, False, False, False, False]
    hosts = spark.createDataFrame([("b.a.com",), ("a.com",), ("c.com",), ("a.a.com",)], "h string")
    assert [r.h for r in hosts.orderBy(*S.host_order(F.col("h"))).collect()] == ["a.com", "a.a.com", "b.a.com", "c.com"]

    def fmix(x):
        for shift, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            x = ((x ^ x >> shift) * m) & 0xFFFFFFFF
        return x ^ x >> 16

    for x in (0, 1, 77, 2**31, 2**32 - 1, -5):
        assert f(S.murmur_int(F.col("a")), a=x) % 2**32 == fmix(x & 0xFFFFFFFF)


def test_segments(spark, tmp_path):
    rows = [(f"http://h/{i % 7}", i, i, 200 if i % 3 else 404, i) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, attempt_time long, fetch_id long, http_result int, content_len long")
    s = store.Segments(spark, str(tmp_path))
    for k in range(7):
        s.add(f"s{k}", df.where(f"fetch_id % 7 = {k}"))
    merged = s.merge("t", at_once=3)
    want = {r.url: (r.n, r.ok) for r in df.groupBy("url").agg(F.count("*").alias("n"), F.count_if(F.col("http_result") == 200).alias("ok")).collect()}
    assert {r.url: (r.attempt_count, r.crawl_count) for r in merged.collect()} == want and s.whole() == ["t"]
    assert [r.key for r in store.key_index(merged, "url", 1).orderBy("key").collect()] == sorted(want)
    assert store.key_range(merged, "url", "http://h/2", "http://h/4").count() == 3
    bad = spark.createDataFrame([(0.5, 100.0, 20.0, 80, ["1.1.1.1", "2.2.2.2"], "p"), (0.1, 1.0, 20.0, 80, ["3.3.3.3"], "q")], "spam_ip double, mean_length double, mean_distance double, roots long, ips array<string>, pattern string")
    assert {r.ip for r in store.bad_ips(bad).collect()} == {"1.1.1.1", "2.2.2.2"}


def test_titles_as_sql_has_them(spark, tmp_path):
    rows = [(1, "http://h/a?x=1&amp;y", "<head><title> A&amp;&lt;b&gt; &quot;c&amp</title></head><a href=\"/q?a=1&amp;b=2\">x</a>"), (2, "http://h/", None), (3, "http://h/", "<title> </title>"), (4, "http://h/", "<title>&amp;lt; &copy;&#65;</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(c.execute(catalog.oracle_sql()["html_title_links_parsed"]).fetchall())
    assert want[0][1] == 'A&<b> &quot;c&amp' and sorted(map(tuple, content.html_title_links_parsed(spark, str(tmp_path)).collect())) == want
