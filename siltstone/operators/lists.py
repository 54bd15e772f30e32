"""Crawl-list generation: scores, homepages, bundles, feeds and probes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query

_CC = "least(sqrt(power(ln(greatest(1, i + 1)) * 0.2, 2) + power(ln(greatest(1, e + 1)), 2)), 14) / 14 * 10"


@query(f"""WITH s AS (SELECT target, count(*) FILTER (WHERE source_root = target_root) AS i, count(*) FILTER (WHERE source_root <> target_root) AS e FROM links GROUP BY 1)
SELECT target, round({_CC}, 6) AS cc_rank, round(10000 * (CASE WHEN e % 3 = 0 THEN 0 ELSE 1 END) + 1000 * (i % 5) + 10 * ({_CC}), 5) AS score FROM s""")
def url_scoring(spark, d):
    """Own rank from links, and the cumulative score with frontier flags."""
    s = view(spark, d, "links").groupBy("target").agg(F.count_if(F.expr("source_root = target_root")).alias("i"), F.count_if(F.expr("source_root <> target_root")).alias("e"))
    cc = F.expr(_CC)
    return s.select("target", F.round(cc, 6).alias("cc_rank"), F.round(10000 * F.when(F.col("e") % 3 == 0, 0).otherwise(1) + 1000 * (F.col("i") % 5) + 10 * cc, 5).alias("score"))


@query("SELECT DISTINCT host, CASE WHEN root IN ('site1.com', 'site4.com') THEN host ELSE root END AS part FROM fetches")
def partition_domain(spark, d):
    """The host itself under super domains, else the root."""
    return view(spark, d, "fetches").select("host", F.when(F.col("root").isin("site1.com", "site4.com"), F.col("host")).otherwise(F.col("root")).alias("part")).distinct()


@query("SELECT host, 'http://' || host || '/' AS url, 10000 AS rank FROM fetches GROUP BY host")
def homepage_injection(spark, d):
    """One homepage for each host with a valid URL."""
    f = view(spark, d, "fetches").groupBy("host").agg(F.min("url").alias("u"))
    return f.select("host", F.concat(F.regexp_extract("u", "^([a-z]+://)", 1), "host", F.lit("/")).alias("url"), F.lit(10000).alias("rank"))


@query("SELECT DISTINCT 'http://' || domain || '/' AS url, 100000 AS rank FROM hosts UNION ALL SELECT DISTINCT url, 100000 FROM hosts")
def wiki_url_scoring(spark, d):
    h = view(spark, d, "hosts")
    homes = h.select(F.concat(F.lit("http://"), "domain", F.lit("/")).alias("url")).distinct()
    return homes.union(h.select("url").distinct()).select("url", F.lit(100000).alias("rank"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1) // 5 AS bundle FROM orders)
SELECT o_custkey % 32 AS crawler, o_custkey, bundle::BIGINT AS bundle, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS urls, round(avg(o_totalprice), 4) AS rank FROM n GROUP BY o_custkey, bundle""")
def bundle_assembly(spark, d, size: int = 5):
    """Bundles of a host's best URLs, each for one crawler."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    n = read(spark, d, "orders").withColumn("bundle", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    g = n.groupBy("o_custkey", "bundle").agg(F.sort_array(F.collect_list(F.struct(F.negative("o_totalprice").alias("p"), "o_orderkey"))).alias("b"), F.round(F.avg("o_totalprice"), 4).alias("rank"))
    return g.select((F.col("o_custkey") % 32).alias("crawler"), "o_custkey", "bundle", F.col("b.o_orderkey").alias("urls"), "rank")


@query("""WITH s AS (SELECT DISTINCT o_custkey % 4 AS crawler, o_custkey AS host FROM orders), g AS (SELECT crawler, host, row_number() OVER (PARTITION BY crawler ORDER BY host) AS place FROM s)
SELECT crawler, host, place, row_number() OVER (ORDER BY crawler, place) AS number FROM g""")
def move_segments(spark, d):
    """Segments renumbered in order; per-crawler counts give each crawler's first number."""
    s = read(spark, d, "orders").select((F.col("o_custkey") % 4).alias("crawler"), F.col("o_custkey").alias("host")).distinct()
    g = s.withColumn("place", F.row_number().over(Window.partitionBy("crawler").orderBy("host")))
    counts = s.groupBy("crawler").agg(F.count("*").alias("n"))  # one row a crawler
    before = F.coalesce(F.sum("n").over(Window.orderBy("crawler").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("crawler", before.alias("before"))
    return g.join(F.broadcast(starts), "crawler").select("crawler", "host", "place", (F.col("before") + F.col("place")).cast("long").alias("number"))


@query("""WITH s AS (SELECT root, count(*) AS n, count(*) FILTER (WHERE starts_with(host, 'www.')) AS www, count(*) FILTER (WHERE kind = 'error') AS bad FROM fetches GROUP BY root)
SELECT root, CASE WHEN n > 100 AND www * 10 >= n * 4 THEN 'http://www.' || root || '/' ELSE 'http://' || root || '/' END AS url FROM s WHERE bad < n""")
def legacy_homepages(spark, d):
    s = view(spark, d, "fetches").groupBy("root").agg(F.count("*").alias("n"), F.count_if(F.startswith("host", F.lit("www."))).alias("www"), F.count_if(F.expr("kind = 'error'")).alias("bad")).where("bad < n")
    return s.select("root", F.concat(F.when(F.expr("n > 100 and www * 10 >= n * 4"), "http://www.").otherwise("http://"), "root", F.lit("/")).alias("url"))


@query("""WITH f AS (SELECT DISTINCT url || '/feed' AS feed FROM fetches WHERE kind = 'purchase') SELECT feed AS url, 'feed' AS kind FROM f UNION ALL SELECT regexp_replace(feed, '[^/]*$', ''), 'parent' FROM f""")
def legacy_feed_urls(spark, d):
    """A feed and its parent path."""
    f = view(spark, d, "fetches").where("kind = 'purchase'").select(F.concat("url", F.lit("/feed")).alias("feed")).distinct()
    return f.select(F.col("feed").alias("url"), F.lit("feed").alias("kind")).union(f.select(F.regexp_replace("feed", "[^/]*$", ""), F.lit("parent")))


@query("""WITH b AS (SELECT DISTINCT root FROM fetches), m AS (SELECT unnest(range(0, 24)) AS k)
SELECT 'http://' || root || strftime(DATE '2012-01-01' - to_months(k::INTEGER), '/%Y/%m/') AS url FROM b, m""")
def blog_probes(spark, d, last: str = "2012-01-01", months: int = 24):
    """Month archives of the last two years of each blog."""
    b = view(spark, d, "fetches").select("root").distinct()
    at = F.explode(F.sequence(F.add_months(F.lit(last).cast("date"), -(months - 1)), F.lit(last).cast("date"), F.expr("interval 1 month")))
    return b.select("root", at.alias("m")).select(F.concat(F.lit("http://"), "root", F.date_format("m", "/yyyy/MM/")).alias("url"))


@query("""WITH g AS (SELECT root, url, bit_or(CASE http_result WHEN 200 THEN 1 WHEN 301 THEN 2 ELSE 4 END) AS flags FROM fetches GROUP BY 1, 2), c AS (SELECT root, count(*) AS urls, count(*) FILTER (WHERE flags & 1 = 1) AS ok FROM g GROUP BY root)
SELECT url, flags FROM g JOIN c USING (root) WHERE length(url) < 4097 AND ok > 0 AND flags & 2 = 0 AND NOT (urls > 100000 AND ok < 3)""")
def legacy_bundles(spark, d):
    """Flags of all records of a URL, then the domain's and the record's gates."""
    g = view(spark, d, "fetches").groupBy("root", "url").agg(F.bit_or(F.expr("case http_result when 200 then 1 when 301 then 2 else 4 end")).alias("flags"))
    c = g.groupBy("root").agg(F.count("*").alias("urls"), F.count_if(F.expr("flags & 1 = 1")).alias("ok"))
    return g.join(c, "root").where("length(url) < 4097 and ok > 0 and flags & 2 = 0 and not (urls > 100000 and ok < 3)").select("url", "flags")


@query("""WITH f AS (SELECT DISTINCT host, url || CASE WHEN fetch_id % 2 = 0 THEN '/feed' ELSE '/a/feed' END AS feed FROM fetches WHERE kind = 'purchase'),
x AS (SELECT host, feed, length(feed) - length(replace(feed, '/', '')) AS depth FROM f), m AS (SELECT host, depth, min(depth) OVER (PARTITION BY host) AS least, feed FROM x)
SELECT host, feed FROM m WHERE depth = least AND host IN (SELECT host FROM m WHERE depth = least GROUP BY host HAVING count(*) <= 5)""")
def feed_discovery(spark, d):
    """Feeds of the shallowest level of each host, if they are five at most; purchases stand for fetches of feeds."""
    f = view(spark, d, "fetches").where("kind = 'purchase'").select("host", F.concat("url", F.when(F.col("fetch_id") % 2 == 0, "/feed").otherwise("/a/feed")).alias("feed")).distinct()
    x = f.withColumn("depth", F.length("feed") - F.length(F.replace("feed", F.lit("/"), F.lit(""))))
    level = x.groupBy("host", "depth").agg(F.count("*").alias("n")).groupBy("host").agg(F.min(F.struct("depth", "n")).alias("m")).where("m.n <= 5").select("host", F.col("m.depth").alias("depth"))
    return x.join(level, ["host", "depth"]).select("host", "feed")


@query("""SELECT url, CASE WHEN regexp_matches(url, '/[0-9]{4}/[0-9]{2}/[^/]+/?$') THEN 'post' WHEN regexp_matches(url, '/post/[0-9]+') THEN 'tumblr' WHEN regexp_matches(url, '/p[0-9]+$') THEN 'nested' ELSE 'index' END AS kind FROM (SELECT DISTINCT url FROM fetches)""")
def post_detection(spark, d):
    """Post URLs by pattern, in order."""
    u = F.col("url")
    k = F.when(u.rlike("/[0-9]{4}/[0-9]{2}/[^/]+/?$"), "post").when(u.rlike("/post/[0-9]+"), "tumblr").when(u.rlike("/p[0-9]+$"), "nested").otherwise("index")
    return view(spark, d, "fetches").select("url").distinct().select("url", k.alias("kind"))
