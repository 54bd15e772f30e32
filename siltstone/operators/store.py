"""The crawl database as tables: flush, incremental merge, compaction, key index, lookups and caches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators.crawldb import merge_records, merge_statuses
from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query

#: Lookup tables of at most so many rows are broadcast, by their count; longer ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def flush(merged: DataFrame, samples: DataFrame) -> DataFrame:
    """Merged records (url, ...) and incoming samples (url, line) as one keyed table; records without a valid URL go."""
    valid = F.expr("url is not null and rlike(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')")
    body = F.to_json(F.struct(*(c for c in merged.columns if c != "url")))
    records = merged.where(valid).select("url", F.lit("MERGED_RECORD").alias("kind"), body.alias("value"))
    return records.unionByName(samples.where(valid).select("url", F.lit("INCOMING_URLS_SAMPLE").alias("kind"), F.col("line").alias("value")))


@dataclass
class Segments:
    """Merged segments under a folder, a table each; a segment is whole once its ``_SUCCESS`` file is there."""

    spark: SparkSession
    folder: str
    names: list[str] = field(default_factory=list)

    def add(self, name: str, statuses: DataFrame) -> None:
        """Merge a segment's statuses and write them, sorted by URL within their files."""
        merge_statuses(statuses).repartitionByRange("url").sortWithinPartitions("url").write.mode("errorifexists").parquet(f"{self.folder}/{name}")
        self.names.append(name)

    def whole(self) -> list[str]:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        there = lambda n: (p := fs.Path(f"{self.folder}/{n}/_SUCCESS")).getFileSystem(conf).exists(p)
        return [n for n in self.names if there(n)]

    def merge(self, name: str, since: str = "", at_once: int = 5) -> DataFrame:
        """Merge the whole segments after ``since`` in groups of ``at_once``, then the groups, into a new segment."""
        wanted = [n for n in self.whole() if n > since]
        groups = [wanted[i : i + at_once] for i in range(0, len(wanted), at_once)]
        parts = []
        for k, group in enumerate(groups):
            rows = [self.spark.read.parquet(f"{self.folder}/{n}").withColumn("segment", F.lit(n)) for n in group]
            out = rows[0]
            for r in rows[1:]:
                out = out.unionByName(r, allowMissingColumns=True)
            path = f"{self.folder}/{name}-{k}"
            merge_records(out).withColumn("segment", F.lit(group[-1])).write.mode("overwrite").parquet(path)
            parts.append(path)
        merged = merge_records(self.spark.read.parquet(*parts))
        compact(merged, "url", f"{self.folder}/{name}", max(1, len(parts)))
        self.names = [n for n in self.names if n not in wanted] + [name]
        return self.spark.read.parquet(f"{self.folder}/{name}")


def compact(table: DataFrame, key: str, path: str, shards: int) -> None:
    """Write a table as ``shards`` ranges of ``key``, sorted: file statistics are the key index."""
    table.repartitionByRange(shards, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def key_index(table: DataFrame, key: str, every: int = 100) -> DataFrame:
    """(file, place, key) of each ``every``-th row of each file, and the file's first one."""
    rows = table.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"), F.col(key).alias("key"))
    return rows.where(F.col("place") % every == 0)


def key_range(table: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with keys from ``low`` to ``high``; the comparison reaches the scan, so files and row groups outside are skipped."""
    return table.where((F.col(key) >= low) & (F.col(key) <= high))


def bulk_lookup(wanted: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Metadata of wanted keys; each key once, keys that aren't there with nulls."""
    return metadata.join(sized(wanted.select(key).distinct()), key, "right")


@dataclass(frozen=True)
class Rule:
    """A filter step: rows that meet ``when`` get ``action`` (Reject, Accept or Modified) and, if given, new values."""

    when: Column
    action: str
    values: dict = field(default_factory=dict)


def filter_chain(items: DataFrame, rules: list[Rule]) -> DataFrame:
    """``items`` with ``action``: rules apply in order, the first Reject or Accept ends the chain, Modified sets values and goes on."""
    done = items.withColumn("action", F.lit("NoAction"))
    for rule in rules:
        hit = F.coalesce(rule.when, F.lit(False)) & ~F.col("action").isin("Reject", "Accept")
        done = done.withColumns({"action": F.when(hit, rule.action).otherwise(F.col("action"))} | {c: F.when(hit, v).otherwise(F.col(c) if c in done.columns else F.lit(None)) for c, v in rule.values.items()})
    return done


def in_list(items: DataFrame, column: str, listed: DataFrame, name: str) -> DataFrame:
    """``items`` with a boolean ``name``: whether the value of ``column`` is in the one-column table ``listed``."""
    keys = listed.select(F.col(listed.columns[0]).alias("_key")).where("_key is not null").distinct().withColumn(name, F.lit(True))
    joined = items.join(sized(keys), F.col(column) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(name, F.coalesce(name, F.lit(False)))


def bad_ips(dupes: DataFrame) -> DataFrame:
    """(ip, pattern) of near-duplicate sets whose addresses look like spam: a share of one address of .40, short texts, sample paths far apart, many roots."""
    bad = dupes.where("spam_ip >= 0.40 and mean_length <= 500 and mean_distance >= 15 and roots >= 75")
    return bad.select(F.explode("ips").alias("ip"), "pattern").distinct()


def latest_names(answers: DataFrame, at: Column) -> DataFrame:
    """A name cache: the last answer (host, ip, cname, ttl, seen) of each host that hasn't run out at ``at``."""
    best = answers.groupBy("host").agg(F.max_by(F.struct("ip", "cname", "ttl", "seen"), F.struct("seen", "ip")).alias("a")).select("host", "a.*")
    return best.where(F.col("seen") + F.make_dt_interval(secs=F.col("ttl")) > at)


def history_sync(items: DataFrame, log: DataFrame) -> DataFrame:
    """Listed URLs with the state of their latest fetch in ``log`` (url, attempt_time, fetch_id, http_result); null if there is none."""
    last = log.join(items.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.count("*").alias("attempts"), F.max_by(F.struct("attempt_time", "http_result"), F.struct("attempt_time", "fetch_id")).alias("s"))
    return items.join(last.select("url", "attempts", "s.*"), "url", "left")


def import_domain_metadata(lines: DataFrame, host: str = "host", text: str = "text") -> DataFrame:
    """(host, line of flags) -> domain without ``www.``, had_www, rank10, ip, porn, spam."""
    number = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    name = F.lower(F.col(host))
    return lines.select(urls.strip_www(name).alias("domain"), (urls.strip_www(name) != name).alias("had_www"), number(r"rank10=([0-9.]+)").cast("double").alias("rank10"), number(r"(?:^|\s)ip=([0-9.]+)").alias("ip"), F.col(text).rlike(r"(?:^|\s)bool_porn=1\b").alias("porn"), F.col(text).rlike(r"(?:^|\s)bool_spam=1\b").alias("spam"))


@query("""WITH m AS (SELECT url, count(*) AS n FROM fetches GROUP BY 1), s AS (SELECT DISTINCT 'http://' || target || '/' AS url, source AS line FROM links)
SELECT kind, count(*) AS n, count(DISTINCT url) AS urls FROM (SELECT url, 'MERGED_RECORD' AS kind FROM m UNION ALL SELECT url, 'INCOMING_URLS_SAMPLE' FROM s) GROUP BY 1""")
def crawldb_flush(spark, d):
    merged = view(spark, d, "fetches").groupBy("url").agg(F.count("*").alias("n"))
    links = view(spark, d, "links").select(F.concat(F.lit("http://"), "target", F.lit("/")).alias("url"), F.col("source").alias("line")).distinct()
    return flush(merged, links).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("""SELECT root, fetch_id, CASE WHEN http_result >= 400 THEN 'Reject' WHEN big THEN 'Accept' WHEN kind = 'view' THEN 'Modified' ELSE 'NoAction' END AS action, CASE WHEN kind = 'view' AND http_result < 400 AND NOT big THEN 2.0::DOUBLE END AS boost
FROM (SELECT *, root IN (SELECT root FROM fetches GROUP BY root HAVING count(DISTINCT host) >= 2) AS big FROM fetches)""")
def online_filter_chain(spark, d):
    """Status, big-domain list and boost as one chain of rules."""
    f = view(spark, d, "fetches").select("root", "fetch_id", "http_result", "kind", "host")
    big = f.groupBy("root").agg(F.count_distinct("host").alias("n")).where("n >= 2").select("root")
    rules = [Rule(F.col("http_result") >= 400, "Reject"), Rule(F.col("big"), "Accept"), Rule(F.col("kind") == "view", "Modified", {"boost": F.lit(2.0)})]
    return filter_chain(in_list(f, "root", big, "big"), rules).select("root", "fetch_id", "action", "boost")


@query("""WITH w AS (SELECT DISTINCT 'http://h' || (o_custkey % 40)::VARCHAR || '.site' || ((o_custkey % 40) % 12)::VARCHAR || '.com/p' || (o_orderkey % 60)::VARCHAR AS url FROM orders), m AS (SELECT url, count(*) AS attempts, max(attempt_time) AS latest FROM fetches GROUP BY 1)
SELECT w.url, attempts, latest FROM w LEFT JOIN m USING (url)""")
def bulk_metadata_lookup(spark, d):
    """Metadata of a long list of keys."""
    w = read(spark, d, "orders").select(F.expr("concat('http://h', cast(o_custkey % 40 as string), '.site', cast((o_custkey % 40) % 12 as string), '.com/p', cast(o_orderkey % 60 as string))").alias("url"))
    m = view(spark, d, "fetches").groupBy("url").agg(F.count("*").alias("attempts"), F.max("attempt_time").alias("latest"))
    return bulk_lookup(w, m, "url")


@query("""SELECT url, (SELECT count(*) FROM fetches f WHERE f.url = i.url) AS attempts, (SELECT arg_max(http_result, (attempt_time, fetch_id)) FROM fetches f WHERE f.url = i.url) AS http_result
FROM (SELECT DISTINCT url FROM fetches WHERE fetch_id % 3 = 0 UNION SELECT 'http://nowhere.com/') i""")
def list_history_sync(spark, d):
    f = view(spark, d, "fetches")
    items = f.where("fetch_id % 3 = 0").select("url").union(spark.sql("select 'http://nowhere.com/'")).distinct()
    return history_sync(items, f).select("url", F.coalesce("attempts", F.lit(0)).alias("attempts"), "http_result")


@query("""WITH a AS (SELECT host, server_ip AS ip, 3600 * (1 + fetch_id % 48) AS ttl, attempt_time AS seen FROM fetches), b AS (SELECT host, arg_max(ip, (seen, ip)) AS ip, max(seen) AS seen, arg_max(ttl, (seen, ip)) AS ttl FROM a GROUP BY 1)
SELECT host, ip, seen FROM b WHERE seen + to_seconds(ttl) > TIMESTAMP '2024-01-30 12:00:00'""")
def dns_cache_lookup(spark, d):
    """Answers that still hold at a time."""
    a = view(spark, d, "fetches").select("host", F.col("server_ip").alias("ip"), F.lit(None).cast("string").alias("cname"), F.expr("3600 * (1 + fetch_id % 48)").alias("ttl"), F.col("attempt_time").alias("seen"))
    return latest_names(a, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("host", "ip", "seen")


@query("""SELECT 'h' || c_custkey::VARCHAR || '.com' AS domain, c_custkey % 3 = 0 AS had_www, (c_custkey % 7 + 0.5)::DOUBLE AS rank10, '10.0.0.' || (c_nationkey)::VARCHAR AS ip, c_custkey % 5 = 0 AS porn, c_custkey % 4 = 0 AS spam FROM customer""")
def domain_metadata_import(spark, d):
    c = read(spark, d, "customer")
    host = F.expr("concat(case when c_custkey % 3 = 0 then 'WWW.' else '' end, 'h', cast(c_custkey as string), '.com')")
    text = F.expr("concat('rank10=', cast(c_custkey % 7 as string), '.5 ip=10.0.0.', cast(c_nationkey as string), case when c_custkey % 5 = 0 then ' bool_porn=1' else '' end, case when c_custkey % 4 = 0 then ' bool_spam=1' else ' bool_spam=0' end)")
    return import_domain_metadata(c.select(host.alias("host"), text.alias("text")))


@query("""SELECT url, root, host FROM fetches WHERE NOT regexp_matches(url, '/robots[.]txt$|[.](jpg|gif|png|css|js|zip)$') AND http_result = 200 GROUP BY url, root, host HAVING bool_and(kind <> 'purchase')""")
def crawldb_partition_filter(spark, d):
    """URLs to crawl of a partition: no robots file, no binary extension, all their kinds allowed."""
    f = view(spark, d, "fetches").where("http_result = 200 and not rlike(url, '/robots[.]txt$|[.](jpg|gif|png|css|js|zip)$')")
    return f.groupBy("url", "root", "host").agg(F.bool_and(F.col("kind") != "purchase").alias("fine")).where("fine").select("url", "root", "host")


@query("SELECT regexp_replace(split_part(url, '/', 3), '^www[.]', '') AS domain, kind, count(*) AS n, sum(content_len)::BIGINT AS bytes FROM fetches GROUP BY 1, 2")
def archive_size_stats(spark, d):
    """Counts and bytes of each segment of an archive."""
    f = view(spark, d, "fetches").select(urls.strip_www(urls.host(F.col("url"))).alias("domain"), "kind", "content_len")
    return f.groupBy("domain", "kind").agg(F.count("*").alias("n"), F.sum("content_len").alias("bytes"))


@query("SELECT o_custkey AS key, o_orderkey AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM (SELECT * FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)")
def merge_sorted_runs(spark, d):
    """Several sorted runs merged by key; within a key by time."""
    o = read(spark, d, "orders")
    runs = o.unionByName(o.where("o_orderkey % 2 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return runs.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.row_number().over(w).alias("place"))
