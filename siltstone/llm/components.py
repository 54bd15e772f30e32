"""Connected components by alternating large-star and small-star steps.

Each step keeps the edge set no larger than the node set plus what it had, so a
hub with a third of all edges costs a sum per task and one split join. Every
table that a step makes is written to the shared folder, so lineage stays short
and lost executors cost little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges`` (a, b) of any orderable type -> (node, component), component the smallest node.

    Nulls link nothing; loops and repeated edges are ignored. Nodes without an
    edge to another node are not returned.
    """
    now = work.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = work.keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = work.keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = work.keep(large.groupBy("u").agg(F.min("v").alias("m")), "low2")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        then = work.keep(small.distinct(), "edges")
        for t in (now, low, large, low2):
            work.forget(t)
        now, last = then, mark
        mark = _mark(now)
        if mark == last:
            break
    tops = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return work.keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops), "components")
