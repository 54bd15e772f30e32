"""Host, root-domain and link statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query

r6 = lambda c: F.round(c, 6)


@query("SELECT host, root, count(*) AS urls, count(DISTINCT url) AS distinct_urls FROM hosts GROUP BY host, root")
def host_url_counts(spark, d):
    """URLs per host; www. hosts count apart."""
    return view(spark, d, "hosts").groupBy("host", "root").agg(F.count("*").alias("urls"), F.countDistinct("url").alias("distinct_urls"))


COUNTERS = {"http_200": "http_result = 200", "http_301": "http_result = 301", "http_404": "http_result = 404", "big": "content_len > 500"}
_HOST_STATS = "SELECT regexp_replace(host, '^www[.]', '') AS domain, min(root) AS root, count(*) AS attempts, count(DISTINCT url) AS urls, " + ", ".join(f"count(*) FILTER (WHERE {e}) AS {c}" for c, e in COUNTERS.items())


def host_stats(fetches):
    domain = F.regexp_replace("host", "^www[.]", "").alias("domain")
    return fetches.groupBy(domain).agg(F.min("root").alias("root"), F.count("*").alias("attempts"), F.countDistinct("url").alias("urls"), *(F.count_if(F.expr(e)).alias(c) for c, e in COUNTERS.items()), F.sort_array(F.collect_set("server_ip")).alias("ips"))


@query(_HOST_STATS + ", list_sort(list(DISTINCT server_ip)) AS ips FROM fetches GROUP BY 1")
def host_crawl_stats(spark, d):
    """Counters per host, www. folded, with the distinct server addresses."""
    return host_stats(view(spark, d, "fetches"))


@query("""WITH part AS (SELECT host, extract('day' FROM attempt_time) AS day, count(*) AS n, list(DISTINCT server_ip) AS ips FROM fetches GROUP BY 1, 2)
SELECT host, sum(n)::BIGINT AS attempts, list_sort(list_distinct(flatten(list(ips)))) AS ips FROM part GROUP BY host""")
def counter_merge(spark, d):
    """Partial counters and address sets merged into final ones."""
    part = view(spark, d, "fetches").groupBy("host", F.dayofmonth("attempt_time").alias("day")).agg(F.count("*").alias("n"), F.collect_set("server_ip").alias("ips"))
    return part.groupBy("host").agg(F.sum("n").alias("attempts"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ips")))).alias("ips"))


def rollup(hosts, key, value, prefix):
    """N, sum, mean, max and sample deviation (0 for one) of a value; NaN is no value."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return hosts.groupBy(key).agg(F.count(v).alias(f"{prefix}_n"), r6(F.sum(v)).alias(f"{prefix}_sum"), r6(F.avg(v)).alias(f"{prefix}_mean"), F.max(v).alias(f"{prefix}_max"), r6(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"{prefix}_sd"))


@query("""WITH h AS (SELECT host, root, count(*)::DOUBLE AS urls FROM hosts GROUP BY host, root)
SELECT root, count(urls) AS urls_n, round(sum(urls), 6) AS urls_sum, round(avg(urls), 6) AS urls_mean, max(urls) AS urls_max, round(coalesce(stddev_samp(urls), 0), 6) AS urls_sd FROM h GROUP BY root""")
def root_rollup_stats(spark, d):
    """Descriptive statistics of hosts' URL counts per root domain."""
    return rollup(host_url_counts(spark, d), "root", "urls", "urls")


@query("""WITH h AS (SELECT host, root, count(*) AS attempts, count(*) FILTER (WHERE http_result = 200) AS ok, count(*) FILTER (WHERE http_result = 404) AS gone FROM fetches GROUP BY host, root),
r AS (SELECT root, count(*) AS hosts, sum(attempts)::BIGINT AS attempts, sum(ok)::BIGINT AS ok, sum(gone)::BIGINT AS gone FROM h GROUP BY root)
SELECT root, hosts, attempts, round(ok::DOUBLE / attempts, 6) AS ok_share, CASE WHEN ok = 0 THEN 'blacklist' WHEN gone * 4 > attempts THEN 'limited' WHEN hosts >= 10 THEN 'super' ELSE 'normal' END AS class FROM r""")
def classify_domains(spark, d):
    """Root domains by a cascade of rules; the first that holds decides."""
    h = view(spark, d, "fetches").groupBy("host", "root").agg(F.count("*").alias("attempts"), F.count_if(F.expr("http_result = 200")).alias("ok"), F.count_if(F.expr("http_result = 404")).alias("gone"))
    r = h.groupBy("root").agg(F.count("*").alias("hosts"), *(F.sum(c).alias(c) for c in ("attempts", "ok", "gone")))
    rule = F.when(F.col("ok") == 0, "blacklist").when(F.col("gone") * 4 > F.col("attempts"), "limited").when(F.col("hosts") >= 10, "super").otherwise("normal")
    return r.select("root", "hosts", "attempts", r6(F.col("ok") / F.col("attempts")).alias("ok_share"), rule.alias("class"))


@query("""SELECT root, count(*) AS urls, count(*) FILTER (WHERE http_result = 200) AS ok, count(*) FILTER (WHERE http_result = 404) AS gone,
count(*) FILTER (WHERE attempt_time > TIMESTAMP '2024-01-20 00:00:00') AS recent FROM fetches GROUP BY root""")
def v1_stats(spark, d, as_of: str = "2024-01-20 00:00:00"):
    """Counters per root with what is recent at ``as_of``."""
    return view(spark, d, "fetches").groupBy("root").agg(F.count("*").alias("urls"), F.count_if(F.expr("http_result = 200")).alias("ok"), F.count_if(F.expr("http_result = 404")).alias("gone"), F.count_if(F.col("attempt_time") > F.lit(as_of).cast("timestamp_ntz")).alias("recent"))


@query("SELECT source_root, rel, count(*) AS n FROM links GROUP BY 1, 2 HAVING count(*) >= 10")
def having_ge_10(spark, d):
    """Histogram of link kinds that occur ten times or more."""
    return view(spark, d, "links").groupBy("source_root", "rel").agg(F.count("*").alias("n")).where("n >= 10")


@query("""SELECT root, count(*) FILTER (WHERE starts_with(host, 'www.')) AS www, count(*) FILTER (WHERE NOT starts_with(host, 'www.')) AS non_www,
sum(CASE WHEN starts_with(host, 'www.') THEN 1 ELSE -1 END)::BIGINT AS balance, count(*) FILTER (WHERE starts_with(host, 'www.')) * 10 >= count(*) * 3 AS use_www FROM hosts GROUP BY root""")
def www_prefix_share(spark, d):
    """www. against other hosts per root; www. is used from a share of 0.3."""
    w = F.startswith("host", F.lit("www."))
    return view(spark, d, "hosts").groupBy("root").agg(F.count_if(w).alias("www"), F.count_if(~w).alias("non_www"), F.sum(F.when(w, 1).otherwise(-1)).alias("balance"), (F.count_if(w) * 10 >= F.count("*") * 3).alias("use_www"))


@query("""SELECT root, count(*) FILTER (WHERE kind = 'error' AND fetch_id % 2 = 0) AS nxdomain, count(*) FILTER (WHERE kind = 'error' AND fetch_id % 2 = 1) AS servfail,
count(*) FILTER (WHERE kind <> 'error') AS noerror FROM fetches GROUP BY root""")
def dns_failure_counts(spark, d):
    """Name resolution outcomes per root."""
    e = lambda x: F.count_if(F.expr(x))
    return view(spark, d, "fetches").groupBy("root").agg(e("kind = 'error' and fetch_id % 2 = 0").alias("nxdomain"), e("kind = 'error' and fetch_id % 2 = 1").alias("servfail"), e("kind <> 'error'").alias("noerror"))


@query("SELECT root, list_sort(list(DISTINCT domain)) AS subdomains FROM hosts WHERE domain <> root GROUP BY root HAVING count(DISTINCT domain) < 100")
def subdomain_list_capped(spark, d):
    """Distinct subdomains of roots that have fewer than a hundred."""
    h = view(spark, d, "hosts").where("domain <> root").select("root", "domain").distinct()
    few = h.groupBy("root").agg(F.count("*").alias("n")).where("n < 100")
    return h.join(few, "root").groupBy("root").agg(F.sort_array(F.collect_list("domain")).alias("subdomains"))


@query("SELECT root, count(DISTINCT domain) AS n FROM hosts GROUP BY root HAVING count(DISTINCT domain) > 1")
def subdomain_count(spark, d):
    return view(spark, d, "hosts").groupBy("root").agg(F.countDistinct("domain").alias("n")).where("n > 1")


@query("SELECT root, count(*) AS urls FROM hosts WHERE NOT contains(url, '?') GROUP BY root")
def url_count_per_root(spark, d):
    """URLs without a query string per root."""
    return view(spark, d, "hosts").where(~F.contains("url", F.lit("?"))).groupBy("root").agg(F.count("*").alias("urls"))


@query("SELECT target_root, count(DISTINCT source_root) AS n, list_sort(list(DISTINCT source_root)) AS roots FROM links WHERE source_root <> target_root GROUP BY 1")
def distinct_inlink_roots(spark, d):
    """Distinct linking root domains per target root."""
    pairs = view(spark, d, "links").where("source_root <> target_root").select("target_root", "source_root").distinct()
    return pairs.groupBy("target_root").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("source_root")).alias("roots"))


@query("SELECT DISTINCT server_ip, host FROM fetches WHERE http_result = 200")
def ip_host_pairs(spark, d):
    return view(spark, d, "fetches").where("http_result = 200").select("server_ip", "host").distinct()


@query("SELECT host, list_sort(list(DISTINCT server_ip))[1:10] AS ips FROM fetches GROUP BY host")
def host_ips_max10(spark, d):
    pairs = view(spark, d, "fetches").select("host", "server_ip").distinct()
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("server_ip"))).where("r <= 10")
    return first.groupBy("host").agg(F.sort_array(F.collect_list("server_ip")).alias("ips"))


def rank_score(same, diff):
    s, x = F.log(F.greatest(F.lit(1.0), same)) * 0.2, F.log(F.greatest(F.lit(1.0), diff))
    return F.least(F.sqrt(s * s + x * x), F.lit(14.0)) / 14 * 10


@query("""WITH p AS (SELECT target_root, count(DISTINCT CASE WHEN source_root <> target_root THEN source_root END) AS diff, count(*) FILTER (WHERE source_root = target_root) AS same FROM links GROUP BY 1)
SELECT target_root, diff, same, round(least(sqrt(power(ln(greatest(1, same)) * 0.2, 2) + power(ln(greatest(1, diff)), 2)), 14) / 14 * 10, 6) AS score FROM p""")
def domain_rank(spark, d):
    """Score of a root from links of its own and of other roots."""
    other = F.col("source_root") != F.col("target_root")
    p = view(spark, d, "links").groupBy("target_root").agg(F.countDistinct(F.when(other, F.col("source_root"))).alias("diff"), F.count_if(~other).alias("same"))
    return p.select("target_root", "diff", "same", r6(rank_score(F.col("same").cast("double"), F.col("diff").cast("double"))).alias("score"))


@query("""WITH h AS (SELECT target_root AS root, target AS host, count(DISTINCT source_root) AS n FROM links WHERE source_root <> target_root GROUP BY 1, 2)
SELECT root, count(*) AS hosts, round(stddev_samp(n), 6) AS sd, ceil(log10(count(*)))::BIGINT AS rank, max(n) AS most, list_sort(list(host))[1:5] AS samples
FROM h GROUP BY root HAVING count(*) >= 15 AND stddev_samp(n) >= 0.1""")
def super_domains(spark, d):
    """Roots with many hosts whose inlink counts differ."""
    h = view(spark, d, "links").where("source_root <> target_root").groupBy(F.col("target_root").alias("root"), F.col("target").alias("host")).agg(F.countDistinct("source_root").alias("n"))
    stats = h.groupBy("root").agg(F.count("*").alias("hosts"), F.stddev_samp("n").alias("sd"), F.max("n").alias("most"))
    stats = stats.where("hosts >= 15 and sd >= 0.1")
    from pyspark.sql import Window
    low = h.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("host"))).where("r <= 5").groupBy("root").agg(F.sort_array(F.collect_list("host")).alias("samples"))
    return stats.join(low, "root").select("root", "hosts", r6("sd").alias("sd"), F.ceil(F.log10("hosts")).cast("long").alias("rank"), "most", "samples")


@query("SELECT host, year(attempt_time) AS year, month(attempt_time) AS month, count(*) AS hits, bit_or(CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 4 END) AS flags FROM fetches GROUP BY 1, 2, 3")
def posts_per_month(spark, d):
    flag = F.expr("case kind when 'click' then 1 when 'view' then 2 else 4 end")
    return view(spark, d, "fetches").groupBy("host", F.year("attempt_time").alias("year"), F.month("attempt_time").alias("month")).agg(F.count("*").alias("hits"), F.bit_or(flag).alias("flags"))


@query("""WITH m AS (SELECT c_custkey AS blog, year(o_orderdate) AS y, month(o_orderdate) AS mo, count(*) AS hits FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
SELECT blog, min(hits) AS lo, max(hits) AS hi, round(avg(hits), 6) AS mean, count(*) AS months, max(y) AS last_year FROM m WHERE hits <> 0 GROUP BY blog""")
def post_frequency_summary(spark, d):
    m = read(spark, d, "orders").join(read(spark, d, "customer"), F.expr("o_custkey = c_custkey")).groupBy(F.col("c_custkey").alias("blog"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")).agg(F.count("*").alias("hits"))
    return m.where("hits <> 0").groupBy("blog").agg(F.min("hits").alias("lo"), F.max("hits").alias("hi"), r6(F.avg("hits")).alias("mean"), F.count("*").alias("months"), F.max("y").alias("last_year"))


@query("""SELECT regexp_replace(host, '^www[.]', '') AS domain, count(*) AS n, sum(content_len)::BIGINT AS bytes, max(attempt_time) AS latest, arg_max(url, (attempt_time, fetch_id)) AS latest_url,
count(*) FILTER (WHERE http_result = 200) AS fetched FROM fetches GROUP BY 1""")
def subdomain_metadata_rollup(spark, d):
    return view(spark, d, "fetches").groupBy(F.regexp_replace("host", "^www[.]", "").alias("domain")).agg(F.count("*").alias("n"), F.sum("content_len").alias("bytes"), F.max("attempt_time").alias("latest"), F.max_by("url", F.struct("attempt_time", "fetch_id")).alias("latest_url"), F.count_if(F.expr("http_result = 200")).alias("fetched"))


@query("""WITH u AS (SELECT DISTINCT target, target_root, source, source_root FROM links),
n AS (SELECT target, count(DISTINCT source_root) AS roots, count(*) AS total, count(*) FILTER (WHERE source_root <> target_root) AS external FROM u GROUP BY target),
k AS (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS r FROM u)
SELECT k.target, list(k.source ORDER BY k.source) AS sources, any_value(total) AS total, any_value(external) AS external, floor(log10(any_value(total)))::BIGINT AS scale
FROM k JOIN n USING (target) WHERE roots <= 10000 AND r <= 5 GROUP BY k.target""")
def inverse_link_grouping(spark, d, cap: int = 5, max_roots: int = 10_000):
    """Unique sources per target, at most ``cap`` listed, with counts and their scale."""
    from pyspark.sql import Window
    u = view(spark, d, "links").select("target", "target_root", "source", "source_root").distinct()
    n = u.groupBy("target").agg(F.countDistinct("source_root").alias("roots"), F.count("*").alias("total"), F.count_if(F.expr("source_root <> target_root")).alias("external")).where(F.col("roots") <= max_roots)
    k = u.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("source"))).where(F.col("r") <= cap).groupBy("target").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    return k.join(n, "target").select("target", "sources", "total", "external", F.floor(F.log10("total")).cast("long").alias("scale"))


@query("""SELECT l_returnflag AS list, l_linestatus AS sub, count(*) AS n, count(*) FILTER (WHERE l_quantity < 10) AS r200, count(*) FILTER (WHERE l_quantity >= 10 AND l_quantity < 20) AS r301,
count(*) FILTER (WHERE l_quantity >= 20) AS other FROM lineitem GROUP BY 1, 2""")
def crawl_list_metadata(spark, d):
    e = lambda x: F.count_if(F.expr(x))
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("list"), F.col("l_linestatus").alias("sub")).agg(F.count("*").alias("n"), e("l_quantity < 10").alias("r200"), e("l_quantity >= 10 and l_quantity < 20").alias("r301"), e("l_quantity >= 20").alias("other"))
