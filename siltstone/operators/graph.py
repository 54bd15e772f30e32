"""Graphs: page rank, inverse links, components, URL pattern induction."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; only a session on one machine, as in tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder; iterations start from it. ``last``, a table made so before, is deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._siltstone_path = path
    if old := getattr(last, "_siltstone_path", None):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return made


#: Edges of a task.
TASK_EDGES = 250_000


def page_rank(edges: DataFrame, iterations: int = 10, supers: tuple[str, ...] = ()) -> DataFrame:
    """edges (source, source_root, target) -> (node, rank) after fixed iterations.

    Contributions are averaged within a source's host, then summed (super roots)
    or averaged over the hosts of a root, then summed over roots:
    0.15 + 0.85 * sum. A node without inlinks has 0.15.
    """
    # parts by the number of edges, so that a task's share stays the same; rows are dealt out before they are made distinct or summed up
    n = max(edges.sparkSession.sparkContext.defaultParallelism, 1 + edges.count() // TASK_EDGES)
    edges = cut(edges.repartition(n, "source").distinct())
    nodes = cut(edges.select(F.col("source").alias("node")).union(edges.select("target")).repartition(n, "node").distinct())
    by_source = edges.repartition(n, "source")
    weighted = cut(by_source.join(by_source.groupBy("source").agg(F.count("*").alias("out")).hint("merge"), "source"))
    rank = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(iterations):
        sent = weighted.repartition(n, "source").join(rank.repartition(n, "node").hint("merge"), F.col("source") == F.col("node"))
        # edges are distinct, so a host sends a target one contribution
        sent = sent.select("target", "source_root", (F.col("rank") / F.col("out")).alias("c")).repartition(n, "target")
        root = sent.groupBy("target", "source_root").agg(F.when(F.col("source_root").isin(*supers) if supers else F.lit(False), F.sum("c")).otherwise(F.avg("c")).alias("c"))
        total = root.groupBy("target").agg(F.sum("c").alias("c"))
        rank = cut(nodes.repartition(n, "node").join(total.hint("merge"), F.col("node") == F.col("target"), "left").select("node", (0.15 + 0.85 * F.coalesce("c", F.lit(0.0))).alias("rank")), rank)
    return rank


_STEP = """r{n} AS (SELECT node, 0.15 + 0.85 * coalesce(c, 0) AS rank FROM nodes LEFT JOIN (SELECT target, sum(c) AS c FROM (SELECT target, source_root, avg(rank / o) AS c FROM e JOIN outs USING (source) JOIN r{p} ON node = source GROUP BY 1, 2) GROUP BY 1) ON target = node)"""


@query(f"""WITH e AS (SELECT DISTINCT source, source_root, target FROM links UNION SELECT DISTINCT target, target_root, source FROM links WHERE target LIKE 'p1%'), outs AS (SELECT source, count(*) AS o FROM e GROUP BY 1),
nodes AS (SELECT source AS node FROM e UNION SELECT target FROM e), r0 AS (SELECT node, 1.0 AS rank FROM nodes), {_STEP.format(n=1, p=0)}, {_STEP.format(n=2, p=1)} SELECT node, round(rank, 6) AS rank FROM r2""")
def page_rank_2(spark, d):
    links = view(spark, d, "links")
    back = links.where("target like 'p1%'").select(F.col("target").alias("source"), F.col("target_root").alias("source_root"), F.col("source").alias("target"))
    return page_rank(links.select("source", "source_root", "target").union(back), 2).select("node", F.round("rank", 6).alias("rank"))


@query("""WITH p AS (SELECT source, count(*)::DOUBLE AS pr FROM links GROUP BY 1), u AS (SELECT DISTINCT target_root, source FROM links WHERE source_root <> target_root)
SELECT target_root, source, pr, row_number() OVER (PARTITION BY target_root ORDER BY pr DESC, source) AS place FROM u JOIN p USING (source) WHERE pr > 0.15""")
def inverse_links_by_domain(spark, d):
    """Distinct foreign sources of each root, best first."""
    links = view(spark, d, "links")
    p = links.groupBy("source").agg(F.count("*").cast("double").alias("pr")).where("pr > 0.15")
    u = links.where("source_root <> target_root").select("target_root", "source").distinct().join(p, "source")
    return u.select("target_root", "source", "pr", F.row_number().over(Window.partitionBy("target_root").orderBy(F.desc("pr"), "source")).alias("place"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): smallest labels spread and jump until they stay.

    Joins are by shuffle: the tables' files tell little of their rows, and a
    broadcast goes through the driver.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label.hint("merge"), both.b == label.node).groupBy("a").agg(F.min("component").alias("least"))
        step = cut(label.join(near.hint("merge"), label.node == near.a).select("node", F.least("component", "least").alias("component")))
        jump = step.alias("s").join(step.select(F.col("node").alias("n"), F.col("component").alias("c")).hint("merge"), F.expr("s.component = n")).select("s.node", F.col("c").alias("component"))
        jump = cut(jump)
        moved = jump.join(label.withColumnRenamed("component", "was").hint("merge"), "node").where("component <> was").limit(1).count()
        label = jump
        if not moved:
            return label


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, -1 - c_nationkey AS b FROM customer UNION SELECT s_suppkey + 1000000000, -1 - s_nationkey FROM supplier), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM both_ UNION SELECT r.node, both_.b FROM r JOIN both_ ON r.seen = both_.a) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def connected_components(spark, d):
    """Customers and suppliers, linked by their nation."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("a"), (-1 - F.col("c_nationkey")).cast("long").alias("b"))
    s = read(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("a"), (-1 - F.col("s_nationkey")).cast("long").alias("b"))
    return components(c.union(s))


@query("""WITH p AS (SELECT DISTINCT root, regexp_replace(url, '[0-9]+', '#', 'g') AS pattern, url FROM fetches) SELECT root, pattern, count(*) AS n, min(url) AS sample FROM p GROUP BY 1, 2 HAVING count(*) >= 3""")
def url_pattern_induction(spark, d):
    """URLs of a root that differ in numbers only, as patterns with their size."""
    p = view(spark, d, "fetches").select("root", "url").distinct().withColumn("pattern", F.regexp_replace("url", "[0-9]+", "#"))
    return p.groupBy("root", "pattern").agg(F.count("*").alias("n"), F.min("url").alias("sample")).where("n >= 3")


def pattern_regex(pattern: str) -> str:
    """A pattern with # for numbers as a regular expression."""
    return "[0-9]+".join(map(re.escape, pattern.split("#")))
