"""Crawl-database construction: details, links and the merge into one record per URL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.plans.adapters import view
from siltstone.plans.registry import query


@query("""WITH raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM hosts)
SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS target, md5(href) AS digest FROM raw WHERE starts_with(href, '/')""")
def emit_links(spark, d):
    """One link per page and target, with the digest of its text."""
    raw = view(spark, d, "hosts").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).where("startswith(href, '/')")
    return raw.select("page_id", F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), "href").alias("target"), F.md5("href").alias("digest")).distinct()


@query("SELECT target, md5(source) AS digest, min(linked_at) AS first FROM links GROUP BY 1, 2")
def link_dedupe(spark, d):
    """The first of each (target, digest)."""
    return view(spark, d, "links").groupBy("target", F.md5("source").alias("digest")).agg(F.min("linked_at").alias("first"))


@query("""SELECT url, attempt_time, http_result, 'fetch' AS origin FROM fetches UNION ALL SELECT url || '/old', attempt_time, 301, 'redirect' FROM fetches WHERE http_result = 301""")
def redirect_fan_out(spark, d):
    """A redirected fetch also reports on the URL that it came from."""
    f = view(spark, d, "fetches")
    own = f.select("url", "attempt_time", "http_result", F.lit("fetch").alias("origin"))
    return own.unionByName(f.where("http_result = 301").select(F.concat("url", F.lit("/old")).alias("url"), "attempt_time", F.lit(301).alias("http_result"), F.lit("redirect").alias("origin")))


@query("""SELECT fetch_id, http_result, CASE WHEN http_result = 200 THEN content_len END AS content_len, CASE WHEN http_result = 301 THEN url || '/new' END AS redirect_to,
CASE WHEN http_result >= 400 THEN 'http' END AS failure, epoch_us(attempt_time) // 1000000 AS at FROM fetches""")
def crawl_detail(spark, d):
    """What a fetch tells, by kind of result."""
    on = lambda c, x: F.when(F.expr(c), x)
    at = F.floor(F.unix_micros(F.col("attempt_time").cast("timestamp")) / 1_000_000).cast("long")
    return view(spark, d, "fetches").select("fetch_id", "http_result", on("http_result = 200", F.col("content_len")).alias("content_len"), on("http_result = 301", F.concat("url", F.lit("/new"))).alias("redirect_to"), on("http_result >= 400", F.lit("http")).alias("failure"), at.alias("at"))


@query("""SELECT source, count(*) FILTER (WHERE source = target) AS intra_domain, count(*) FILTER (WHERE source <> target AND source_root = target_root) AS intra_root, count(*) FILTER (WHERE source_root <> target_root) AS inter_domain FROM links GROUP BY source""")
def link_classification(spark, d):
    e = lambda x: F.count_if(F.expr(x))
    return view(spark, d, "links").groupBy("source").agg(e("source = target").alias("intra_domain"), e("source <> target and source_root = target_root").alias("intra_root"), e("source_root <> target_root").alias("inter_domain"))


def merge_statuses(statuses, *by):
    """Statuses (url, attempt_time, fetch_id, http_result, content_len) -> one summary per URL, and per value of the columns ``by``.

    Results of the latest attempt by (time, id) count; ``crawl_count`` is the
    number of 2xx attempts, as for records folded in time order.
    """
    key = F.struct("attempt_time", "fetch_id")
    ok = F.expr("http_result between 200 and 299")
    return statuses.groupBy("url", *by).agg(
        F.count("*").alias("attempt_count"), F.max("attempt_time").alias("latest_attempt"), F.max_by("http_result", key).alias("http_result"),
        F.count_if(ok).alias("crawl_count"), F.max(F.when(ok, F.col("attempt_time"))).alias("latest_crawl"),
        F.max_by("content_len", F.when(ok, key)).alias("content_len"),
    )


_MERGE = """SELECT url, count(*) AS attempt_count, max(attempt_time) AS latest_attempt, arg_max(http_result, (attempt_time, fetch_id)) AS http_result, count(*) FILTER (WHERE http_result BETWEEN 200 AND 299) AS crawl_count,
max(attempt_time) FILTER (WHERE http_result BETWEEN 200 AND 299) AS latest_crawl, arg_max(content_len, (attempt_time, fetch_id)) FILTER (WHERE http_result BETWEEN 200 AND 299) AS content_len FROM fetches GROUP BY url"""


@query(_MERGE)
def summary_fold(spark, d):
    return merge_statuses(view(spark, d, "fetches"))


@query("""SELECT target, count(*) FILTER (WHERE source_root <> target_root) AS ext_src_count, count(*) FILTER (WHERE source_root = target_root) AS int_src_count, min(linked_at) AS earliest, max(linked_at) AS latest,
list_sort(list(DISTINCT rel))[1:5] AS type_and_rels FROM links GROUP BY target""")
def link_status_fold(spark, d):
    e = lambda x: F.count_if(F.expr(x))
    return view(spark, d, "links").groupBy("target").agg(e("source_root <> target_root").alias("ext_src_count"), e("source_root = target_root").alias("int_src_count"), F.min("linked_at").alias("earliest"), F.max("linked_at").alias("latest"), F.slice(F.sort_array(F.collect_set("rel")), 1, 5).alias("type_and_rels"))


@query("""SELECT target, source_root || chr(9) || source AS line FROM (SELECT target, source_root, min(source) AS source FROM links WHERE source_root <> target_root GROUP BY 1, 2)""")
def external_source_sample(spark, d):
    """One source per linking root and target, as sample lines."""
    s = view(spark, d, "links").where("source_root <> target_root").groupBy("target", "source_root").agg(F.min("source").alias("source"))
    return s.select("target", F.concat("source_root", F.lit("\t"), "source").alias("line"))


def merge_records(records):
    """Merged records of several segments -> one per URL: counters add up, the latest wins."""
    key = F.struct("latest_attempt", "segment")
    return records.groupBy("url").agg(F.sum("attempt_count").alias("attempt_count"), F.sum("crawl_count").alias("crawl_count"), F.max("latest_attempt").alias("latest_attempt"), F.max_by("http_result", key).alias("http_result"), F.max("latest_crawl").alias("latest_crawl"))


@query("""WITH r AS (SELECT url, fetch_id % 5 AS segment, count(*) AS attempt_count, max(attempt_time) AS latest_attempt, arg_max(http_result, (attempt_time, fetch_id)) AS http_result, count(*) FILTER (WHERE http_result BETWEEN 200 AND 299) AS crawl_count, max(attempt_time) FILTER (WHERE http_result BETWEEN 200 AND 299) AS latest_crawl FROM fetches GROUP BY 1, 2)
SELECT url, sum(attempt_count)::BIGINT AS attempt_count, sum(crawl_count)::BIGINT AS crawl_count, max(latest_attempt) AS latest_attempt, arg_max(http_result, (latest_attempt, segment)) AS http_result, max(latest_crawl) AS latest_crawl FROM r GROUP BY url""")
def merge_of_merged(spark, d):
    f = view(spark, d, "fetches").withColumn("segment", F.col("fetch_id") % 5)
    return merge_records(merge_statuses(f, "segment"))


@query("""SELECT coalesce(m.url, s.url, l.url) AS url, CASE WHEN m.url IS NOT NULL THEN 'merged' WHEN s.url IS NOT NULL THEN 'status' ELSE 'link' END AS elected
FROM (SELECT DISTINCT url FROM fetches WHERE http_result = 200) m FULL JOIN (SELECT DISTINCT url FROM fetches) s ON m.url = s.url FULL JOIN (SELECT DISTINCT url FROM hosts) l ON l.url = coalesce(m.url, s.url)""")
def source_url_election(spark, d):
    """A merged record's URL before a status's before a link's."""
    f = view(spark, d, "fetches")
    rows = f.where("http_result = 200").select("url", F.lit(0).alias("p")).union(f.select("url", F.lit(1))).union(view(spark, d, "hosts").select("url", F.lit(2)))
    return rows.groupBy("url").agg(F.min("p").alias("p")).select("url", F.element_at(F.array(F.lit("merged"), F.lit("status"), F.lit("link")), F.col("p") + 1).alias("elected"))


@query("""SELECT root, host, url, count(*) > 0 AS has_status, bool_or(http_result = 200) AS has_content, bool_or(http_result = 301) AS has_redirect FROM fetches WHERE root >= 'site2.com' AND root <= 'site4.com' GROUP BY 1, 2, 3""")
def key_range_search(spark, d):
    """Presence report over a range of keys."""
    f = view(spark, d, "fetches").where("root >= 'site2.com' and root <= 'site4.com'")
    return f.groupBy("root", "host", "url").agg((F.count("*") > 0).alias("has_status"), F.bool_or(F.expr("http_result = 200")).alias("has_content"), F.bool_or(F.expr("http_result = 301")).alias("has_redirect"))


@query("""WITH m AS (SELECT 'rank=' || (fetch_id % 4)::VARCHAR || '.0 rank10=' || (fetch_id % 3)::VARCHAR || '.50 ' || kind AS line, fetch_id FROM fetches)
SELECT fetch_id, regexp_extract(line, '^rank=([0-9.]*)\\s*rank10=([0-9.]*)[ ]*([^\\s]*)', 1)::DOUBLE AS rank, regexp_extract(line, '^rank=([0-9.]*)\\s*rank10=([0-9.]*)[ ]*([^\\s]*)', 2)::DOUBLE AS rank10, regexp_extract(line, '^rank=([0-9.]*)\\s*rank10=([0-9.]*)[ ]*([^\\s]*)', 3) AS status FROM m""".replace("\\\\s", "\\s"))
def frontier_metadata_import(spark, d):
    line = F.expr("concat('rank=', cast(fetch_id % 4 as string), '.0 rank10=', cast(fetch_id % 3 as string), '.50 ', kind)")
    p = r"^rank=([0-9.]*)\s*rank10=([0-9.]*)[ ]*([^\s]*)"
    f = view(spark, d, "fetches").select("fetch_id", line.alias("line"))
    return f.select("fetch_id", F.regexp_extract("line", p, 1).cast("double").alias("rank"), F.regexp_extract("line", p, 2).cast("double").alias("rank10"), F.regexp_extract("line", p, 3).alias("status"))


@query("""SELECT url, fetch_id, running FROM (SELECT url, fetch_id, http_result, max(attempt_time) OVER (PARTITION BY url ORDER BY fetch_id ROWS UNBOUNDED PRECEDING) AS running, attempt_time FROM fetches) WHERE running = attempt_time""")
def running_latest(spark, d):
    """Details that were the latest when they arrived, in order of arrival."""
    w = Window.partitionBy("url").orderBy("fetch_id").rowsBetween(Window.unboundedPreceding, 0)
    f = view(spark, d, "fetches").withColumn("running", F.max("attempt_time").over(w))
    return f.where("running = attempt_time").select("url", "fetch_id", "running")
