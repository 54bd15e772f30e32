"""Joins of crawl statistics, ranks and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query


def _rank(spark, d):
    return view(spark, d, "links").groupBy(F.col("target_root").alias("root")).agg(F.count("*").alias("rank"))


def _stats(spark, d):
    return view(spark, d, "fetches").groupBy("host", "root").agg(F.count("*").alias("n"))


_RANK = "rank AS (SELECT target_root AS root, count(*) AS rank FROM links GROUP BY 1)"
_NATION = "SELECT n_nationkey % 10 AS k, count(*) AS a FROM nation GROUP BY 1"


@query("""WITH a AS (SELECT n_nationkey % 10 AS k, count(*) AS rank FROM nation GROUP BY 1), b AS (SELECT c_nationkey % 14 AS k, count(*) AS stats FROM customer GROUP BY 1),
c AS (SELECT s_nationkey % 6 + 5 AS k, count(*) AS meta FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k, c.k) AS k, rank, stats, meta FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""")
def outer_join_3way(spark, d):
    """Rank, crawl statistics and third-party metadata by key, each optional."""
    a = read(spark, d, "nation").groupBy(F.expr("n_nationkey % 10").alias("k")).agg(F.count("*").alias("rank"))
    b = read(spark, d, "customer").groupBy(F.expr("c_nationkey % 14").alias("k")).agg(F.count("*").alias("stats"))
    c = read(spark, d, "supplier").groupBy(F.expr("s_nationkey % 6 + 5").alias("k")).agg(F.count("*").alias("meta"))
    return a.join(b, "k", "full_outer").join(c, "k", "full_outer")


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, l.quality, d.lang, CASE WHEN l.doc_id IS NULL THEN 'd' WHEN d.doc_id IS NULL THEN 'l' ELSE 'dl' END AS tags
FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id""")
def tagged_full_outer_join(spark, d):
    """All values of a key with the tags of the inputs that hold it."""
    docs = read(spark, d, "documents").select("doc_id", "lang", F.lit(True).alias("in_d"))
    j = read(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("in_l")).join(docs, "doc_id", "full_outer")
    return j.select("doc_id", "quality", "lang", F.when(F.col("in_l").isNull(), "d").when(F.col("in_d").isNull(), "l").otherwise("dl").alias("tags"))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def tag_ordered_join(spark, d):
    """Many rows per key against at most one: an ordinary left equi-join."""
    return read(spark, d, "orders").join(read(spark, d, "customer"), F.expr("o_custkey = c_custkey"), "left").select("o_orderkey", "c_name", "o_totalprice")


@query(f"WITH {_RANK}, s AS (SELECT host, replace(root, 'site', 'dom') AS root, count(*) AS n FROM fetches GROUP BY 1, 2) SELECT s.host, s.root, n, rank FROM s LEFT JOIN rank USING (root)")
def rank_crawl_stats_join(spark, d):
    """Rank by root attached to each host's row; hosts without rank stay."""
    s = _stats(spark, d).withColumn("root", F.replace("root", F.lit("site"), F.lit("dom")))
    return s.join(_rank(spark, d), "root", "left").select("host", "root", "n", "rank")


@query(f"WITH {_RANK}, q AS (SELECT DISTINCT source_root AS root, length(source_root)::BIGINT AS q FROM links) SELECT coalesce(r.root, q.root) AS root, coalesce(rank, 0) AS dr, coalesce(q, 0) AS qr FROM rank r FULL JOIN q ON r.root = q.root")
def rank_rank_list_join(spark, d):
    """Both ranks of a root, 0 where one is missing."""
    q = view(spark, d, "links").select(F.col("source_root").alias("root")).distinct().withColumn("q", F.length("root").cast("long"))
    j = _rank(spark, d).join(q, "root", "full_outer")
    return j.select("root", F.coalesce("rank", F.lit(0)).alias("dr"), F.coalesce("q", F.lit(0)).alias("qr"))


@query("""WITH r AS (SELECT host, count(*) AS redirects FROM fetches WHERE http_result = 301 GROUP BY 1), s AS (SELECT host, count(*) AS ok FROM fetches WHERE kind = 'purchase' GROUP BY 1)
SELECT coalesce(r.host, s.host) AS host, redirects, ok FROM r FULL JOIN s ON r.host = s.host""")
def redirect_stats_join(spark, d):
    f = view(spark, d, "fetches")
    r = f.where("http_result = 301").groupBy("host").agg(F.count("*").alias("redirects"))
    return r.join(f.where("kind = 'purchase'").groupBy("host").agg(F.count("*").alias("ok")), "host", "full_outer")


@query("""WITH w AS (SELECT domain, count(*) FILTER (WHERE starts_with(host, 'www.')) AS www, count(*) FILTER (WHERE NOT starts_with(host, 'www.')) AS non_www FROM hosts GROUP BY 1), s AS (SELECT domain, max(length(html))::BIGINT AS longest FROM hosts WHERE starts_with(url, 'https') GROUP BY 1)
SELECT domain, www, non_www, longest FROM w FULL JOIN s USING (domain)""")
def www_prefix_join(spark, d):
    h, www = view(spark, d, "hosts"), F.startswith("host", F.lit("www."))
    w = h.groupBy("domain").agg(F.count_if(www).alias("www"), F.count_if(~www).alias("non_www"))
    return w.join(h.where("startswith(url, 'https')").groupBy("domain").agg(F.max(F.length("html")).cast("long").alias("longest")), "domain", "full_outer")


@query("""WITH f AS (SELECT root, regexp_replace(host, '^www[.]', '') AS domain, count(*) AS n FROM fetches WHERE kind = 'error' GROUP BY 1, 2), s AS (SELECT root, count(*) AS total FROM fetches GROUP BY 1)
SELECT s.root, total, list_sort(list(domain || '=' || n::VARCHAR) FILTER (WHERE domain IS NOT NULL)) AS dns FROM s LEFT JOIN f USING (root) GROUP BY s.root, total""")
def dns_failure_join(spark, d):
    """Failures nested under each root."""
    f = view(spark, d, "fetches")
    e = f.where("kind = 'error'").groupBy("root", F.regexp_replace("host", "^www[.]", "").alias("domain")).agg(F.count("*").alias("n"))
    e = e.groupBy("root").agg(F.sort_array(F.collect_list(F.concat("domain", F.lit("="), F.col("n").cast("string")))).alias("dns"))
    return f.groupBy("root").agg(F.count("*").alias("total")).join(e, "root", "left")


@query("""WITH s AS (SELECT root, list_sort(list(DISTINCT domain)) AS subdomains FROM hosts GROUP BY 1), n AS (SELECT root, count(*) AS urls FROM hosts WHERE contains(url, '?') GROUP BY 1)
SELECT root, urls, subdomains FROM n FULL JOIN s USING (root)""")
def subdomain_list_join(spark, d):
    h = view(spark, d, "hosts")
    s = h.groupBy("root").agg(F.sort_array(F.collect_set("domain")).alias("subdomains"))
    return h.where("contains(url, '?')").groupBy("root").agg(F.count("*").alias("urls")).join(s, "root", "full_outer")


@query("""WITH i AS (SELECT root, list_sort(list(DISTINCT server_ip)) AS ips FROM fetches WHERE http_result = 200 GROUP BY 1), n AS (SELECT root, count(*) AS urls FROM fetches GROUP BY 1) SELECT root, urls, ips FROM n FULL JOIN i USING (root)""")
def ip_list_join(spark, d):
    f = view(spark, d, "fetches")
    return f.groupBy("root").agg(F.count("*").alias("urls")).join(f.where("http_result = 200").groupBy("root").agg(F.sort_array(F.collect_set("server_ip")).alias("ips")), "root", "full_outer")


@query(f"WITH {_RANK}, i AS (SELECT DISTINCT replace(root, 'site', 'dom') AS root, server_ip FROM fetches) SELECT server_ip, root, rank FROM i JOIN rank USING (root)")
def rank_ip_inner_join(spark, d):
    i = view(spark, d, "fetches").select(F.replace("root", F.lit("site"), F.lit("dom")).alias("root"), "server_ip").distinct()
    return i.join(_rank(spark, d), "root").select("server_ip", "root", "rank")


@query("""WITH sub AS (SELECT target_root AS root, count(DISTINCT target) AS subdomains FROM links GROUP BY 1), inl AS (SELECT target_root AS root, count(DISTINCT source_root) AS inlinks FROM links GROUP BY 1),
ranked AS (SELECT DISTINCT source_root AS root FROM links)
SELECT root, subdomains, inlinks FROM sub LEFT JOIN inl USING (root) WHERE subdomains >= 10 AND root NOT IN (SELECT root FROM ranked)""")
def join_4way_unranked(spark, d):
    """Roots with ten subdomains or more that no rank list holds."""
    links = view(spark, d, "links")
    per = links.groupBy(F.col("target_root").alias("root")).agg(F.countDistinct("target").alias("subdomains"), F.countDistinct("source_root").alias("inlinks"))
    return per.where("subdomains >= 10").join(links.select(F.col("source_root").alias("root")).distinct(), "root", "left_anti")


@query("""WITH bad AS (SELECT server_ip, host, count(*) AS hits FROM fetches WHERE http_result = 404 GROUP BY 1, 2), w AS (SELECT DISTINCT root FROM fetches WHERE root IN ('site1.com', 'site2.com')), h AS (SELECT DISTINCT server_ip, host, root FROM fetches)
SELECT h.server_ip, count(DISTINCT b.host) AS bad_hosts, bool_or(w.root IS NOT NULL) AS whitelisted, count(DISTINCT h.host) AS hosts, coalesce(sum(b.hits), 0)::BIGINT AS hits
FROM h LEFT JOIN bad b ON h.server_ip = b.server_ip AND h.host = b.host LEFT JOIN w ON h.root = w.root GROUP BY h.server_ip HAVING coalesce(sum(b.hits), 0) > 0""")
def bad_ip_join(spark, d):
    """Per address: bad hosts, whitelist flag and all hosts, where something bad was seen."""
    f = view(spark, d, "fetches")
    bad = f.where("http_result = 404").groupBy("server_ip", "host").agg(F.count("*").alias("hits"))
    white = spark.createDataFrame([("site1.com", True), ("site2.com", True)], "root string, white boolean")
    j = f.select("server_ip", "host", "root").distinct().join(bad, ["server_ip", "host"], "left").join(F.broadcast(white), "root", "left")
    out = j.groupBy("server_ip").agg(F.countDistinct(F.when(F.col("hits").isNotNull(), F.col("host"))).alias("bad_hosts"), F.bool_or(F.col("white").isNotNull()).alias("whitelisted"), F.countDistinct("host").alias("hosts"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return out.where("hits > 0")


@query("""WITH o AS (SELECT source, count(*) FILTER (WHERE target LIKE 'p1%') AS a, count(*) FILTER (WHERE target LIKE 'p2%') AS b, count(*) FILTER (WHERE target LIKE 'p3%') AS c FROM links GROUP BY 1)
SELECT s_suppkey, a, b, c, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'one' WHEN b >= c THEN 'two' ELSE 'three' END AS type
FROM supplier LEFT JOIN o ON source = 's' || s_suppkey::VARCHAR || '.dom' || (s_suppkey % 7)::VARCHAR || '.com'""")
def blog_platform_join(spark, d):
    """Platform hits among outlinks, the most frequent one as type."""
    o = view(spark, d, "links").groupBy("source").agg(*(F.count_if(F.col("target").like(f"p{i}%")).alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))))
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".dom"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".com"))
    kind = F.expr("case when greatest(a, b, c) = 0 then null when a >= b and a >= c then 'one' when b >= c then 'two' when c is not null then 'three' end")
    kind = F.expr("case when greatest(a, b, c) = 0 then null when a >= b and a >= c then 'one' when b >= c then 'two' else 'three' end")
    return read(spark, d, "supplier").withColumn("source", key).join(o, "source", "left").select("s_suppkey", "a", "b", "c", kind.alias("type"))


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""")
def mapside_3way_join(spark, d):
    """Records against root and host metadata; rows whose keys miss are dropped."""
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).join(read(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey"))
    return j.select("l_orderkey", "l_linenumber", "o_orderstatus", "s_name")


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.n_chars > 500")
def link_record_join(spark, d):
    """Inner join of two records of a key, then a threshold."""
    return read(spark, d, "documents").where("n_chars > 500").join(read(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "quality")


@query("SELECT DISTINCT target, target_root FROM links WHERE target_root IN (SELECT source_root FROM links)")
def super_domain_semi_join(spark, d):
    links = view(spark, d, "links")
    return links.select("target", "target_root").distinct().join(links.select(F.col("source_root").alias("target_root")).distinct(), "target_root", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def anti_join_segments(spark, d):
    """Ids that are valid and not yet merged."""
    done = read(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def union_all_inputs(spark, d):
    parts = [read(spark, d, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT DISTINCT source, target FROM links WHERE target <> ''")
def edge_dedupe(spark, d):
    """Distinct edges, exact at any size."""
    return view(spark, d, "links").where("target <> ''").select("source", "target").dropDuplicates()
