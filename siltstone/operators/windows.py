"""Ranking, ordering, pagination, bundling and running totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query


def page(df, number: int, size: int, order, descending: bool = False):
    """One page of a sorted result and the count of all rows.

    Descending pages are windows counted from the end and reversed; the last may
    be partial. Ascending or not, only ``offset + limit`` rows reach the driver.
    """
    if descending:
        order = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    return df.orderBy(*order).offset(number * size).limit(size), df.count()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def paginate_desc(spark, d):
    return page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 2, 25, ["o_totalprice", "o_orderkey"], descending=True)[0]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def paginate_asc(spark, d):
    return page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 2, 25, ["o_totalprice", "o_orderkey"])[0]


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def tail_read(spark, d):
    """The last rows by key."""
    return read(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("SELECT url, fetch_id, attempt_time, http_result FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY attempt_time DESC, fetch_id) AS r FROM fetches WHERE content_len > 0) WHERE r = 1")
def latest_by_ts(spark, d):
    """The latest detail of each URL; the first one on ties."""
    f = view(spark, d, "fetches").where("content_len > 0")
    best = f.groupBy("url").agg(F.max_by(F.struct("fetch_id", "attempt_time", "http_result"), F.struct("attempt_time", F.negative("fetch_id").alias("o"))).alias("b"))
    return best.select("url", "b.fetch_id", "b.attempt_time", "b.http_result")


@query("SELECT url, arg_max(server_ip, (attempt_time, fetch_id)) AS server_ip, max(attempt_time) AS at FROM fetches WHERE http_result = 200 GROUP BY url")
def latest_success_headers(spark, d):
    return view(spark, d, "fetches").where("http_result = 200").groupBy("url").agg(F.max_by("server_ip", F.struct("attempt_time", "fetch_id")).alias("server_ip"), F.max("attempt_time").alias("at"))


@query("SELECT root, host, url, fetch_id, row_number() OVER (PARTITION BY root ORDER BY host, url, attempt_time, fetch_id) AS place FROM fetches")
def composite_key_sort(spark, d):
    """Order within a root by (host, url, time)."""
    w = Window.partitionBy("root").orderBy("host", "url", "attempt_time", "fetch_id")
    return view(spark, d, "fetches").select("root", "host", "url", "fetch_id", F.row_number().over(w).alias("place"))


@query("""WITH n AS (SELECT o_custkey AS root, o_orderkey, o_totalprice, (row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_totalprice DESC, o_orderkey) - 1) // 250 AS bundle, o_custkey % 10 AS k FROM orders)
SELECT k, bundle::BIGINT AS bundle, count(*) AS size, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS least FROM n GROUP BY k, bundle""")
def bundle_250(spark, d):
    """Every 250 items of a root become a bundle, numbered from 0 in each root."""
    k = F.col("o_custkey") % 10
    w = Window.partitionBy("k").orderBy(F.desc("o_totalprice"), "o_orderkey")
    n = read(spark, d, "orders").withColumn("k", k).withColumn("bundle", F.floor((F.row_number().over(w) - 1) / 250).cast("long"))
    return n.groupBy("k", "bundle").agg(F.count("*").alias("size"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_orderkey").alias("least"))


@query("""WITH b AS (SELECT l_suppkey AS part, l_orderkey AS o, count(*) AS urls FROM lineitem GROUP BY 1, 2), s AS (SELECT part, o, urls, coalesce(sum(urls) OVER (PARTITION BY part ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT part, (before // 100)::BIGINT AS segment, count(*) AS bundles, sum(urls)::BIGINT AS urls FROM s GROUP BY 1, 2""")
def running_total_segments(spark, d, size: int = 100):
    """A segment rolls when the running total of URLs passes its size."""
    b = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("part"), F.col("l_orderkey").alias("o")).agg(F.count("*").alias("urls"))
    before = F.coalesce(F.sum("urls").over(Window.partitionBy("part").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("segment", F.floor(before / size).cast("long")).groupBy("part", "segment").agg(F.count("*").alias("bundles"), F.sum("urls").alias("urls"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_linestatus, l_quantity DESC, l_discount, l_orderkey, l_linenumber) AS place FROM lineitem")
def crawl_list_order(spark, d):
    """Ordinary domain, type ascending, first rank descending, second ascending."""
    w = Window.partitionBy("l_suppkey").orderBy("l_returnflag", "l_linestatus", F.desc("l_quantity"), "l_discount", "l_orderkey", "l_linenumber")
    return read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("SELECT source_root, list(target ORDER BY target) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY source_root ORDER BY target) AS r FROM (SELECT DISTINCT source_root, target FROM links)) WHERE r <= 5 GROUP BY 1")
def capped_samples(spark, d):
    """The first five values of each group, without gathering the others."""
    u = view(spark, d, "links").select("source_root", "target").distinct()
    w = Window.partitionBy("source_root").orderBy("target")
    return u.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("source_root").agg(F.sort_array(F.collect_list("target")).alias("samples"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_average(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return read(spark, d, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("""WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
e(user_id, i, x) AS (SELECT user_id, i, value FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, 0.25 * s.value + 0.75 * e.x FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1)
SELECT user_id, round(arg_max(x, i), 6) AS ewma FROM e GROUP BY user_id""")
def ewma(spark, d, alpha: float = 0.25):
    """a * x + (1 - a) * s, the first sample seeds: weights are powers of (1 - a) from the end."""
    e = read(spark, d, "events").where("value is not null")
    w = Window.partitionBy("user_id")
    i = F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))
    e = e.withColumn("i", i).withColumn("n", F.count("*").over(w))
    weight = F.pow(F.lit(1 - alpha), F.col("i") - 1) * F.when(F.col("i") == F.col("n"), 1.0).otherwise(alpha)
    return e.groupBy("user_id").agg(F.round(F.sum(weight * F.col("value")), 6).alias("ewma"))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 4) AS bytes FROM events")
def bandwidth_last_hour(spark, d):
    """Bytes of the last hour at each event."""
    us = F.expr("unix_micros(cast(ts as timestamp))")
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return read(spark, d, "events").withColumn("us", us).select("event_id", "user_id", F.round(F.sum("value").over(w), 4).alias("bytes"))


@query("SELECT url, fetch_id FROM (SELECT url, fetch_id, row_number() OVER (PARTITION BY url ORDER BY content_len DESC, fetch_id) AS r FROM fetches) WHERE r = 1")
def emitted_url_dedupe(spark, d):
    """The best ranked row of each URL."""
    f = view(spark, d, "fetches").groupBy("url").agg(F.min_by("fetch_id", F.struct(F.negative("content_len").alias("c"), "fetch_id")).alias("fetch_id"))
    return f


@query("SELECT url, min(fetch_id) AS fetch_id FROM fetches WHERE http_result = 301 GROUP BY url")
def redirect_dedupe(spark, d):
    return view(spark, d, "fetches").where("http_result = 301").groupBy("url").agg(F.min("fetch_id").alias("fetch_id"))
