import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import hashing, http, urls
from siltstone.operators.dedupe import lsh_keys
from siltstone.operators.filters import crawlable


def one(spark, column, **values):
    types = {bool: "boolean", int: "long", str: "string", list: "array<string>"}
    schema = ", ".join(f"{k} {'string' if v is None else types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("url", "want"), [
    ("http://www.Example.com:80/a;x=1/b?sid=12&q=1", "http://www.example.com/a?q=1"),
    ("https://u:p@h.org:8080/p?PHPSESSID=abc", "https://u:p@h.org:8080/p"),
    ("http://h.org./p;jsessionid=77?a=b#frag", "http://h.org/p?a=b"),
    ("http://h.org/p#!state", "http://h.org/p#!state"),
    ("nothing", None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(("host", "root", "tld"), [("a.b.example.com", "example.com", "com"), ("x.y.co.uk", "y.co.uk", "co.uk"), ("co.uk", None, "co.uk"), ("1.2.3.4", "1.2.3.4", "inaddr-arpa.arpa"), ("www.ck", "www.ck", "ck"), ("a.b.ck", "a.b.ck", "b.ck")])
def test_root_domain(spark, host, root, tld):
    assert one(spark, urls.root_domain(F.col("h")), h=host) == root
    if host != "a.b.ck":
        assert one(spark, urls.tld(F.col("h")), h=host) == tld


def test_hosts(spark):
    assert one(spark, urls.strip_www(F.col("h")), h="www.a.com") == "a.com"
    assert one(spark, urls.strip_www(F.col("h")), h="www.com") == "www.com"
    assert one(spark, urls.normalize_host(F.col("h")), h=" .A%20b.com.") == "ab.com"
    assert one(spark, urls.invert_host(F.col("h")), h="a.b.c") == "c.b.a"
    assert one(spark, urls.int_to_ip(urls.ip_to_int(F.col("h"))), h="200.1.2.3") == "200.1.2.3"
    assert one(spark, urls.home_page(F.col("h")), h="https://X.org/a/b?c") == "https://x.org/"


@pytest.mark.parametrize(("kind", "want"), [("text/html; charset=x", "HTML"), ("application/atom+xml", "FEED"), ("text/xml", "XML"), ("text/csv", "TEXT"), ("image/png", "REJECT"), ("", "OTHER")])
def test_disposition(spark, kind, want):
    assert one(spark, http.disposition(F.col("m")), m=kind) == want


def test_headers_and_dates(spark):
    block = "HTTP/1.1 302 Found\r\nContent-Type: text/html; charset=\"UTF-8\"\r\nX: 1\r\nx: 2"
    assert one(spark, http.status_code(F.col("b")), b=block) == 302
    assert one(spark, http.header_map(F.col("b")), b=block) == {"content-type": 'text/html; charset="UTF-8"', "x": "2"}
    assert one(spark, http.charset(F.col("b")), b='text/html; charset="UTF-8"') == "utf-8"
    assert one(spark, http.http_date(F.col("t")), t="1970-01-02T00:00:00Z") == 86400
    assert one(spark, http.http_date(F.col("t")), t="Fri, 02 Jan 1970 00:00:00 GMT") == 86400
    assert one(spark, http.http_date(F.col("t")), t="junk") is None
    none = F.lit(None).cast("long")
    assert one(spark, http.freshness_seconds(F.lit(200), F.col("c"), none, none, none, none), c="max-age=60") == 60
    assert one(spark, http.freshness_seconds(F.lit(200), F.col("c"), none, none, none, none), c="no-cache") == 0


def test_robots(spark):
    text = "User-agent: *\nDisallow: /all\n\nUser-agent: mybot\nAllow: /all/ok\nDisallow: /all\nDisallow:\n"
    rules = http.robots_rules(F.col("t"), "mybot")
    assert one(spark, http.robots_allow(rules, F.lit("/all/ok/x")), t=text) is True
    assert one(spark, http.robots_allow(rules, F.lit("/all/x")), t=text) is False
    assert one(spark, http.robots_allow(http.robots_rules(F.col("t"), "other"), F.lit("/allx")), t=text) is False
    assert one(spark, http.robots_allow(rules, F.lit("/free")), t=text) is True


@pytest.mark.parametrize(("url", "code", "mime", "kinds", "want"), [
    ("http://a.com/test.jpg", 200, None, [], False), ("http://a.com/test.pdf", 200, None, [], True), ("http://a.com/x", 404, None, [], False), ("http://a.com/x", 200, "image/png", [], False),
    ("http://a.com/x", 200, "text/plain", [], True), ("http://a.com/x", 200, None, ["html:a:nofollow"], False), ("http://a.com/x", 200, None, ["html:img", "html:a"], True), ("http://a.com/x", 200, None, ["html:img"], False), ("http://a.com/x", 200, None, [], True),
])
def test_crawlable(spark, url, code, mime, kinds, want):
    assert one(spark, crawlable(F.col("u"), F.array(F.lit(code)), F.col("m"), F.col("k")), u=url, m=mime, k=kinds) is want


def test_lsh_keys_share_within_three_bits(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(50):
        a = rng.getrandbits(63)
        b = a
        for bit in rng.sample(range(63), 3):
            b ^= 1 << bit
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(F.size(F.array_intersect(lsh_keys(F.col("a")), lsh_keys(F.col("b")))) == 0).count() == 0


def test_codes():
    values = [0, 1, 5, 17, 100]
    assert hashing.rice_decode(hashing.rice_encode(values, 3), 3) == values
    assert hashing.crc16(b"123456789") == 0xBB3D
    b = hashing.BloomFilter(100, 0.01)
    for i in range(100):
        b.add(f"x{i}")
    assert all(f"x{i}" in b for i in range(100)) and sum(f"y{i}" in b for i in range(1000)) < 60
    assert hashing.simhash("the same text") == hashing.simhash("the same text") and hashing.simhash(None) is None
