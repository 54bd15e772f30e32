"""Filters, rule tables and the URL crawlability cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import http, urls
from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query


def matches(column, pattern: str):
    """Whole-string match; ``rlike`` alone finds the pattern anywhere."""
    return F.col(column).rlike(f"^(?:{pattern})$")


@query("SELECT concat('Key:', url) AS key FROM hosts WHERE regexp_full_match(url, 'https?://www[.].*/en/.*')")
def regex_key_filter(spark, d):
    return view(spark, d, "hosts").where(matches("url", "https?://www[.].*/en/.*")).select(F.concat(F.lit("Key:"), "url").alias("key"))


@query("SELECT DISTINCT source, target FROM links WHERE regexp_full_match(source, 's[0-9]*1[.]dom[0-9]+[.]com')")
def graph_link_dump(spark, d):
    return view(spark, d, "links").where(matches("source", "s[0-9]*1[.]dom[0-9]+[.]com")).select("source", "target").distinct()


def crawlable(url, results, mime, kinds):
    """The first rule that decides wins: results, MIME type, path extension, link kinds, else yes.

    ``results``: codes seen; ``kinds``: ``source:type[:rel]`` of links to the URL.
    The kinds are folded in order and the first decisive one counts.
    """
    ext = http.extension(urls.path(url))
    step = lambda acc, k: F.when(acc != "", acc).when(~k.startswith("html:a"), acc).when(k.rlike("nofollow|trackback|(^|:)tag(:|$)|multimedia"), F.lit("no")).otherwise(F.lit("yes"))
    folded = F.aggregate(F.coalesce(kinds, F.array().cast("array<string>")), F.lit(""), step)
    kind = http.disposition(mime)
    return (
        F.when(F.coalesce(F.exists(results, lambda r: r.isin(301, 404)), F.lit(False)), False)
        .when(mime.isNotNull() & (kind == "REJECT"), False)
        .when(ext.isin(http.BINARY_EXTENSIONS), False)
        .when(ext.isin(http.TEXT_EXTENSIONS), True)
        .when(folded != "", folded == "yes")
        .when(mime.isNotNull() & kind.isin("TEXT", "HTML", "XML", "FEED"), True)
        .when(F.size(F.coalesce(kinds, F.array().cast("array<string>"))) > 0, False)
        .otherwise(True)
    )


@query("""WITH f AS (SELECT url, list(http_result) AS results, min(fetch_id) AS i FROM fetches GROUP BY url)
SELECT url, CASE WHEN list_contains(results, 301) OR list_contains(results, 404) THEN false WHEN i % 7 = 0 THEN false WHEN i % 3 = 0 THEN i % 2 = 0 ELSE true END AS crawlable FROM f""")
def url_filter_cascade(spark, d):
    f = view(spark, d, "fetches").groupBy("url").agg(F.collect_list("http_result").alias("results"), F.min("fetch_id").alias("i"))
    mime = F.when(F.col("i") % 7 == 0, "image/png").otherwise("text/html; charset=utf-8")
    kinds = F.when(F.col("i") % 3 == 0, F.array(F.lit("html:img"), F.when(F.col("i") % 2 == 0, "html:a").otherwise("html:a:nofollow"))).otherwise(F.array(F.lit("html:link")))
    return f.select("url", crawlable(F.col("url"), F.col("results"), mime, kinds).alias("crawlable"))


@query("""SELECT page_id, url FROM hosts WHERE (NOT contains(url, '?') OR (contains(url, 'page=') AND NOT contains(url, 'ref=')) OR contains(url, 'utm_source=feed')) AND regexp_extract(url, '^([a-z]+):', 1) IN ('http', 'https')""")
def query_string_gate(spark, d):
    """URLs with a query stay only if ranked by a frontier or crawled from it; only http and https."""
    gate = ~F.contains("url", F.lit("?")) | (F.contains("url", F.lit("page=")) & ~F.contains("url", F.lit("ref="))) | F.contains("url", F.lit("utm_source=feed"))
    return view(spark, d, "hosts").where(gate & F.regexp_extract("url", "^([a-z]+):", 1).isin("http", "https")).select("page_id", "url")


@query("""SELECT url, max(attempt_time) AS at FROM fetches WHERE http_result = 200 AND content_len > 0 AND NOT regexp_matches(url, 'robots[.]txt$|[.]js$|[.]css$') GROUP BY url""")
def dedupe_eligibility(spark, d):
    f = view(spark, d, "fetches").where("http_result = 200 and content_len > 0").where(~F.col("url").rlike(r"robots[.]txt$|[.]js$|[.]css$"))
    return f.groupBy("url").agg(F.max("attempt_time").alias("at"))


_RULES = [("site1.com", ".*[13]", 2.0), ("site1.com", ".*", 0.5), ("*", "/p[0-9]", 1.0), ("site4.com", "/p5.*", 3.0)]
_RULES_SQL = "rules(root, path, v) AS (VALUES " + ", ".join(f"('{a}', '{b}', {v}::DOUBLE)" for a, b, v in _RULES) + ")"
_MATCHED = _RULES_SQL + ", u AS (SELECT DISTINCT url, root, regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) AS path FROM fetches), m AS (SELECT u.url, r.v FROM u JOIN rules r ON (r.root = u.root OR r.root = '*') AND regexp_full_match(u.path, r.path))"


def matched_rules(spark, pages, rules=None):
    """(url, v) for each rule of the URL's root, or global one, whose path pattern matches.

    The list of rules is an operator's argument, checked to be small.
    """
    rules = rules or _RULES
    if len(rules) > 100_000:
        raise ValueError("too many rules to broadcast")
    r = spark.createDataFrame(rules, "root string, pattern string, v double")
    keyed = pages.select("url", F.explode(F.array(F.col("root"), F.lit("*"))).alias("root"), F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1).alias("path"))
    return keyed.join(F.broadcast(r), "root").where(F.expr("path rlike concat('^(?:', pattern, ')$')")).select("url", "v")


def _urls(spark, d):
    return view(spark, d, "fetches").select("url", "root").distinct()


@query(f"WITH {_MATCHED} SELECT u.url FROM u WHERE u.url NOT IN (SELECT url FROM m)")
def url_pattern_block(spark, d):
    """URLs that no rule rejects."""
    u = _urls(spark, d)
    return u.select("url").join(matched_rules(spark, u), "url", "left_anti")


@query(f"WITH {_MATCHED} SELECT u.url, coalesce(sum(m.v), 0.0::DOUBLE) AS boost FROM u LEFT JOIN m USING (url) GROUP BY u.url")
def pagerank_boost(spark, d):
    """The sum of all matching rules' boosts."""
    u = _urls(spark, d)
    m = matched_rules(spark, u).groupBy("url").agg(F.sum("v").alias("boost"))
    return u.select("url").join(m, "url", "left").select("url", F.coalesce("boost", F.lit(0.0)).alias("boost"))


@query(f"WITH {_MATCHED} SELECT u.url, min(m.v) AS recrawl FROM u LEFT JOIN m USING (url) GROUP BY u.url")
def recrawl_time_modifier(spark, d):
    """The least of all matching rules."""
    u = _urls(spark, d)
    return u.select("url").join(matched_rules(spark, u).groupBy("url").agg(F.min("v").alias("recrawl")), "url", "left")


@query("""WITH r(root, rate) AS (VALUES ('site1.com', 5), ('site1.com', 2), ('site3.com', 9)) SELECT f.root, min(r.rate) AS rate FROM (SELECT DISTINCT root FROM fetches) f LEFT JOIN r USING (root) GROUP BY f.root""")
def crawl_rate_override(spark, d):
    r = spark.createDataFrame([("site1.com", 5), ("site1.com", 2), ("site3.com", 9)], "root string, rate int").groupBy("root").agg(F.min("rate").alias("rate"))
    return view(spark, d, "fetches").select("root").distinct().join(F.broadcast(r), "root", "left")


@query("SELECT url, CASE WHEN root IN ('site1.com', 'site2.com') THEN 'Reject' WHEN root IN ('site3.com') THEN 'Accept' ELSE 'NoAction' END AS result FROM (SELECT DISTINCT url, root FROM fetches)")
def domain_include_exclude(spark, d):
    rules = spark.createDataFrame([("site1.com", "Reject"), ("site2.com", "Reject"), ("site3.com", "Accept")], "root string, result string")
    return _urls(spark, d).join(F.broadcast(rules), "root", "left").select("url", F.coalesce("result", F.lit("NoAction")).alias("result"))


@query("SELECT host, CASE WHEN p IS NULL THEN 'Reject' ELSE 'Accept' END AS result, p AS position FROM (SELECT DISTINCT host FROM fetches) LEFT JOIN (VALUES ('h1.site1.com', 1), ('h5.site5.com', 2), ('h7.site7.com', 3)) t(host, p) USING (host)")
def domain_hash_list(spark, d):
    """Position in a list of names; a miss rejects."""
    names = spark.createDataFrame([("h1.site1.com", 1), ("h5.site5.com", 2), ("h7.site7.com", 3)], "host string, position int")
    j = view(spark, d, "fetches").select("host").distinct().join(F.broadcast(names), "host", "left")
    return j.select("host", F.when(F.col("position").isNull(), "Reject").otherwise("Accept").alias("result"), "position")


@query("""WITH f AS (SELECT DISTINCT server_ip, string_split(server_ip, '.') AS p FROM fetches), n AS (SELECT server_ip, p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT AS ip FROM f)
SELECT server_ip FROM n WHERE NOT (ip & 4294967292 = 167772420 OR ip & 4294967040 = 167773184)""")
def ip_block(spark, d):
    """Addresses outside all (subnet, mask) rules."""
    rules = spark.createDataFrame([(167772420, 4294967292), (167773184, 4294967040)], "subnet long, mask long")
    f = view(spark, d, "fetches").select("server_ip").distinct().withColumn("ip", urls.ip_to_int(F.col("server_ip")))
    return outside(f, rules).select("server_ip")


def outside(addresses, rules, most: int = 64):
    """Rows of ``addresses`` (with a number ``ip``) that no rule (subnet, mask) holds; a join by equality for each of at most ``most`` masks."""
    masks = [r["mask"] for r in rules.select("mask").distinct().limit(most + 1).collect()]
    if len(masks) > most:
        raise ValueError(f"more than {most} different masks")
    out = addresses
    for m in masks:
        own = rules.where(F.col("mask") == m).select((F.col("subnet").bitwiseAND(m)).alias("_net")).distinct()
        own = F.broadcast(own) if own.count() <= 100_000 else own
        out = out.join(own, F.col("ip").bitwiseAND(m) == F.col("_net"), "left_anti")
    return out


@query("SELECT host, coalesce(hint, server_ip) AS ip FROM (SELECT host, min(server_ip) AS server_ip FROM fetches GROUP BY host) LEFT JOIN (VALUES ('h1.site1.com', '9.9.9.9')) t(host, hint) USING (host)")
def ip_hint(spark, d):
    hints = spark.createDataFrame([("h1.site1.com", "9.9.9.9")], "host string, hint string")
    f = view(spark, d, "fetches").groupBy("host").agg(F.min("server_ip").alias("server_ip"))
    return f.join(F.broadcast(hints), "host", "left").select("host", F.coalesce("hint", "server_ip").alias("ip"))


@query("SELECT DISTINCT regexp_replace(host, '^www[.](h1[0-9]*[.])', 'cdn.\\1') AS host FROM fetches WHERE NOT regexp_matches(host, 'blog|tumblr')")
def dns_rewrite(spark, d):
    """Hosts rewritten by rule, blog platforms excluded."""
    f = view(spark, d, "fetches").where(~F.col("host").rlike("blog|tumblr"))
    return f.select(F.regexp_replace("host", "^www[.](h1[0-9]*[.])", "cdn.$1").alias("host")).distinct()


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)")
def blocked_domain_set(spark, d):
    return read(spark, d, "nation").where(~F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name")
