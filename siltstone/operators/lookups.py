"""Metadata queries, scalar functions over tables, statistics of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import http, urls
from siltstone.functions.hashing import rabin_udf
from siltstone.operators.windows import page
from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query


@query("SELECT domain, count(*) AS urls FROM hosts WHERE regexp_full_match(domain, '.*[.]example[.]com') GROUP BY domain ORDER BY urls, domain LIMIT 10 OFFSET 0")
def domain_list_query(spark, d):
    """Domains by pattern, sorted by URL count, one page of them."""
    h = view(spark, d, "hosts").where(F.col("domain").rlike("^(?:.*[.]example[.]com)$")).groupBy("domain").agg(F.count("*").alias("urls"))
    return page(h, 0, 10, ["urls", "domain"])[0]


@query("SELECT url, count(*) AS n FROM fetches WHERE host = 'h1.site1.com' GROUP BY url ORDER BY n DESC, url LIMIT 20")
def url_list_query(spark, d):
    u = view(spark, d, "fetches").where("host = 'h1.site1.com'").groupBy("url").agg(F.count("*").alias("n"))
    return u.orderBy(F.desc("n"), "url").limit(20)


@query("SELECT DISTINCT target FROM links WHERE source = 's1.dom1.com'")
def outlinks_query(spark, d):
    return view(spark, d, "links").where("source = 's1.dom1.com'").select("target").distinct()


@query("SELECT source_root, count(*) AS n, min(source) AS sample FROM links WHERE target_root = 'dom5.com' GROUP BY 1")
def inlinks_by_domain_query(spark, d):
    return view(spark, d, "links").where("target_root = 'dom5.com'").groupBy("source_root").agg(F.count("*").alias("n"), F.min("source").alias("sample"))


@query("SELECT fetch_id, url, http_result FROM fetches WHERE url = 'http://h1.site1.com/p1'")
def point_lookup(spark, d):
    return view(spark, d, "fetches").where("url = 'http://h1.site1.com/p1'").select("fetch_id", "url", "http_result")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, sum(value) FILTER (WHERE event_type = 'click') AS click, sum(value) FILTER (WHERE event_type = 'view') AS view_, sum(value) FILTER (WHERE event_type = 'error') AS error FROM (SELECT ts, event_type, round(value)::BIGINT AS value FROM events) GROUP BY 1")
def stats_chart_query(spark, d):
    """A chart's table: one column per series."""
    e = read(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type", F.round("value").cast("long").alias("value"))
    return e.groupBy("hour").pivot("event_type", ["click", "view", "error"]).agg(F.sum("value")).withColumnRenamed("view", "view_")


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS key, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def hourly_stats(spark, d):
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS key, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2)
SELECT date_trunc('day', hour)::TIMESTAMP AS day, key, sum(n)::BIGINT AS n, round(avg(mean), 6) AS mean, count(*) AS hours FROM h GROUP BY 1, 2""")
def daily_rollup(spark, d):
    """Counters add up over hours; rates are means over the hours that are present."""
    h = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return h.groupBy(F.date_trunc("day", "hour").cast("timestamp_ntz").alias("day"), "key").agg(F.sum("n").alias("n"), F.round(F.avg("mean"), 6).alias("mean"), F.count("*").alias("hours"))


@query("""WITH b AS (SELECT date_trunc('hour', min(ts))::TIMESTAMP AS lo, date_trunc('hour', max(ts))::TIMESTAMP AS hi FROM events), s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM b),
h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT s.hour, coalesce(n, 0) AS n FROM s LEFT JOIN h USING (hour)""")
def gap_filling(spark, d):
    """Empty records for hours without any."""
    e = read(spark, d, "events")
    hour = F.date_trunc("hour", "ts")
    spine = e.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour")).select(F.col("hour").cast("timestamp_ntz").alias("hour"))
    h = e.where("event_type = 'error'").groupBy(hour.cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return spine.join(h, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '.')), '.') AS inverted,
regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '([^.]+[.][^.]+)$', 1) AS root, 'com' IN (regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '([^.]+)$', 1)) AS is_com FROM pages""")
def url_functions(spark, d):
    p = read(spark, d, "pages")
    h = urls.host(F.col("url"))
    return p.select("page_id", h.alias("host"), urls.invert_host(h).alias("inverted"), urls.root_domain(h).alias("root"), (urls.tld(h) == "com").alias("is_com"))


@query("SELECT DISTINCT server_ip, string_split(server_ip, '.')[1]::BIGINT * 16777216 + string_split(server_ip, '.')[2]::BIGINT * 65536 + string_split(server_ip, '.')[3]::BIGINT * 256 + string_split(server_ip, '.')[4]::BIGINT AS n, server_ip AS back FROM fetches")
def ip_functions(spark, d):
    f = view(spark, d, "fetches").select("server_ip").distinct().withColumn("n", urls.ip_to_int(F.col("server_ip")))
    return f.withColumn("back", urls.int_to_ip(F.col("n")))


@query("SELECT o_orderkey, bit_count(o_orderkey)::INTEGER AS ones, (o_orderkey & (o_orderkey - 1)) = 0 AS power2, md5(o_orderkey::VARCHAR) AS digest, lpad(o_orderkey::VARCHAR, 8, '0') AS padded FROM orders")
def bit_functions(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.bit_count(k).alias("ones"), (k.bitwiseAND(k - 1) == 0).alias("power2"), F.md5(k.cast("string")).alias("digest"), F.lpad(k.cast("string"), 8, "0").alias("padded"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.none')::BIGINT, -1) AS none FROM events")
def json_getters(spark, d):
    g = lambda p: F.get_json_object("props", p).cast("long")
    return read(spark, d, "events").select("event_id", g("$.k").alias("k"), F.coalesce(g("$.none"), F.lit(-1)).alias("none"))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, quarter(o_orderdate) AS quarter, weekofyear(o_orderdate) AS week, (o_orderdate::DATE + INTERVAL 1 MONTH)::TIMESTAMP AS next FROM orders""")
def calendar_periods(spark, d):
    t = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.date_trunc("month", t).cast("timestamp_ntz").alias("month"), F.quarter(t).cast("long").alias("quarter"), F.weekofyear(t).cast("long").alias("week"), F.add_months(t.cast("date"), 1).cast("timestamp_ntz").alias("next"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INTEGER AS links FROM pages""")
def html_title_and_links(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("links"))


@query("SELECT fetch_id, CASE WHEN fetch_id % 4 = 0 THEN 'HTML' WHEN fetch_id % 4 = 1 THEN 'FEED' WHEN fetch_id % 4 = 2 THEN 'REJECT' ELSE 'TEXT' END AS disposition FROM fetches")
def mime_disposition(spark, d):
    m = F.element_at(F.array(F.lit("text/html; charset=UTF-8"), F.lit("application/rss+xml"), F.lit("image/png"), F.lit("text/plain")), (F.col("fetch_id") % 4 + 1).cast("int"))
    return view(spark, d, "fetches").select("fetch_id", http.disposition(m).alias("disposition"))


@query()
def rabin_fingerprints(spark, d):
    """64-bit Rabin fingerprints of URLs."""
    return read(spark, d, "pages").select("page_id", rabin_udf("url").alias("fingerprint"))
