"""Near duplicates by simhash: permuted keys, candidates, sets, cross-domain scores."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.hashing import hamming, simhash_udf
from siltstone.operators.graph import components, cut
from siltstone.plans.adapters import read, view
from siltstone.plans.registry import query

#: Widths of the six chunks of a 64-bit hash; all but as many as bits may differ make a key.
CHUNKS = (11, 11, 11, 11, 10, 10)


#: Parts in a block of their group, or so, and pairs of a task.
BLOCK, TASK_PAIRS = 256, 4_000_000
#: Fills up short texts; no text holds it, as it is a half of a pair.
_NO_CHARACTER = "\udfff"
#: Neighbouring ids that stay together, and bytes of text of a task.
RUN, TASK_BYTES = 64, 16 << 20


def _masks(most: int) -> list[int]:
    at, masks = 64, []
    for w in CHUNKS:
        at -= w
        masks.append(((1 << w) - 1) << at)
    keys = (sum(masks[i] for i in c) for c in combinations(range(6), 6 - most))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in keys]  # as signed numbers


def lsh_keys(h, most: int = 3):
    """Structs (pattern, bits), 20 for three bits, 15 for two: hashes that differ in at most ``most`` bits share one."""
    return F.array(*(F.struct(F.lit(i).alias("pattern"), h.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_masks(most))))


def near_pairs(docs, most: int = 2):
    """docs (id, h) -> pairs of hashes (a, b, distance), each hash once however many documents share it.

    Keys are joined by a shuffle, as there are many times more of them than the
    table's size tells. A pair counts under the first key that it shares.
    """
    hashes = cut(docs.select("h").distinct()).where("h is not null")  # a filter before would work out hashes twice
    keyed = hashes.select("h", F.explode(lsh_keys(F.col("h"), most)).alias("k")).select("h", "k.pattern", "k.bits")
    a, b = keyed.alias("a"), keyed.hint("merge").alias("b")
    near = hamming(F.col("a.h"), F.col("b.h")) <= most
    pairs = a.join(b, F.expr("a.pattern = b.pattern and a.bits = b.bits and a.h < b.h") & near).select("a.pattern", F.col("a.h").alias("a"), F.col("b.h").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(_masks(most))))
    return pairs.where(F.col("pattern") == first).select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


@query()
def hamming_pairs(spark, d):
    """Pairs of 64-bit hashes at most two bits apart, over all orders: those of a customer differ in one bit from its hash."""
    h = F.expr("xxhash64(o_custkey) ^ shiftleft(1L, cast(o_orderkey % 64 as int))")
    return near_pairs(read(spark, d, "orders").select(h.alias("h")))


@query()
def lsh_candidate_pairs(spark, d):
    """Simhashes of documents that are near each other."""
    docs = read(spark, d, "documents").select("doc_id", simhash_udf("text").alias("h"))
    return near_pairs(docs)


@query()
def simhash_sets(spark, d):
    """Documents with the component of their simhash."""
    docs = cut(read(spark, d, "documents").select("doc_id", "source", simhash_udf("text").alias("h")))
    comp = components(near_pairs(docs).select("a", "b"))
    return docs.join(comp.hint("merge"), docs.h == comp.node, "left").select("doc_id", "source", "h", F.coalesce("component", "h").alias("component"))


def _grams(text: str | None) -> np.ndarray:
    """The sorted distinct 3-grams of code points, each exactly one number; a shorter text is its only gram, null has none."""
    if text is None:
        return np.zeros(0, np.uint64)
    if len(text) < 3:
        text = text + _NO_CHARACTER * (3 - len(text))
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique(u[:-2] << np.uint64(42) | u[1:-1] << np.uint64(21) | u[2:])


def _neighbours(batches):
    """Rows (run, doc_id, text) sorted by both: (a, b, jaccard) of all rows of an id and the next one in a run."""
    at, last, now = None, [], []
    for batch in batches:
        out = [], [], []
        for run, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (run, i):
                last = now if at == (run, i - 1) else []
                at, now = (run, i), []
            s = _grams(text)
            now.append(s)
            for x in last:
                both = len(x) + len(s) and len(np.intersect1d(x, s, assume_unique=True))
                of = len(x) + len(s) - both
                for column, v in zip(out, (i - 1, i, both / of if of else float("nan")), strict=True):
                    column.append(v)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "jaccard"])


@query("""WITH g AS (SELECT doc_id, list_distinct([substr(text, i, 3) FOR i IN range(1, greatest(length(text) - 1, 2))]) AS s FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM g a JOIN g b ON a.doc_id + 1 = b.doc_id """)
def jaccard_shingles(spark, d):
    """Jaccard similarity of the 3-gram sets of documents with neighbouring ids.

    Ids lie in runs; a run's first rows go to the run before as well. So each text moves
    once, or twice for one id in ``RUN``, and a task holds the sets of two ids.
    """
    docs = read(spark, d, "documents").where("doc_id is not null").select("doc_id", "text")
    run = F.floor(F.col("doc_id") / RUN)
    runs = F.when(F.pmod("doc_id", F.lit(RUN)) == 0, F.array(run, run - 1)).otherwise(F.array(run))
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, 1 + bytes_ // TASK_BYTES)
    rows = docs.select(F.explode(runs).alias("run"), "doc_id", "text").repartition(n, "run").sortWithinPartitions("run", "doc_id")
    return rows.mapInArrow(_neighbours, "a long, b long, jaccard double").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def levenshtein_samples(spark, d):
    """Pairs of parts of one brand, type and size, in blocks; there are as many tasks as the pairs need."""
    group = ["p_brand", "p_type", "p_size"]
    p = read(spark, d, "part").select("p_partkey", "p_name", *group).dropna(subset=["p_partkey", *group])
    sizes = cut(p.groupBy(*group).agg(F.count("*").alias("c")).where("c > 1"))
    pairs = sizes.agg(F.sum(F.expr("cast(c as double) * c / 2"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, 1 + int(pairs) // TASK_PAIRS)
    block = F.expr(f"cast(pmod(xxhash64(p_partkey), ceil(c / {BLOCK})) as int)").alias("block")
    item = F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("t"))
    blocks = cut(p.join(sizes.hint("merge"), group).groupBy(*group, block).agg(F.collect_list(item).alias("items")))
    a, b = blocks.alias("a"), blocks.hint("merge").alias("b")
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in group] + [F.col("a.block") <= F.col("b.block")])
    # rows of blocks are dealt out one by one, so that large groups lie in many tasks
    met = met.select((F.col("a.block") == F.col("b.block")).alias("own"), F.col("a.items").alias("x"), F.col("b.items").alias("y")).repartition(n)
    both = met.select("own", F.explode("x").alias("x"), "y").select("own", "x", F.explode("y").alias("y")).where("not own or x.k < y.k")
    least, most = F.expr("if(x.k < y.k, x, y)"), F.expr("if(x.k < y.k, y, x)")
    return both.select(least["k"].alias("a"), most["k"].alias("b"), F.levenshtein("x.t", "y.t").alias("distance"))


@query("""WITH t AS (SELECT md5(text) AS m, source, doc_id % 97 AS ip, n_chars FROM documents), g AS (SELECT m, count(DISTINCT source) AS roots FROM t GROUP BY m HAVING count(*) > 1),
s AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE roots > 1) AS crossed, count(DISTINCT ip) AS ips, round(avg(n_chars), 4) AS mean, round(exp(avg(ln(greatest(n_chars, 1)))), 4) AS geo FROM t JOIN g USING (m) GROUP BY source)
SELECT source, total, crossed, ips, mean, geo, round(ln(greatest(crossed, 2)) / ln(greatest(total, 2)), 6) AS ratio, round(ln(greatest(crossed, 2)) / ln(greatest(total, 2)) * (1 - ln(ips) / ln(greatest(total, 2))), 6) AS spam FROM s WHERE crossed >= 2""")
def cross_domain_dupes(spark, d):
    """Exact duplicates that a source shares with others, with its spam score."""
    t = read(spark, d, "documents").select(F.md5("text").alias("m"), "source", (F.col("doc_id") % 97).alias("ip"), "n_chars")
    g = t.groupBy("m").agg(F.countDistinct("source").alias("roots"), F.count("*").alias("n")).where("n > 1").drop("n")
    s = t.join(g, "m").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.expr("roots > 1")).alias("crossed"), F.countDistinct("ip").alias("ips"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.exp(F.avg(F.log(F.greatest("n_chars", F.lit(1))))), 4).alias("geo")).where("crossed >= 2")
    ratio = F.expr("ln(greatest(crossed, 2)) / ln(greatest(total, 2))")
    return s.select("source", "total", "crossed", "ips", "mean", "geo", F.round(ratio, 6).alias("ratio"), F.round(ratio * (1 - F.log("ips") / F.log(F.greatest("total", F.lit(2)))), 6).alias("spam"))


def cross_domain_scores(docs):
    """docs (component, root, ip, length, path, id) -> per root: the scores of its near duplicates, with the gates of the surveyed system.

    A root's hits are all documents of the components that hold one of its own
    and another document. Sums over other roots are those of a component less the
    root's own, so no pair of documents is made; distinct addresses and sample
    paths are joined as distinct values. Lengths are at least 1.
    """
    docs = docs.where("component is not null").withColumn("length", F.greatest("length", F.lit(1)).cast("double"))
    sums = [F.count("*").alias("n"), F.sum("length").alias("sum"), F.sum(F.log("length")).alias("logs")]
    own = cut(docs.groupBy("component", "root").agg(*sums, F.min(F.struct("id", "path")).alias("sample")))
    whole = own.groupBy("component").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "sum", "logs"))).where("all_n > 1")
    sets = cut(own.join(whole, "component"))
    total = sets.groupBy("root").agg(F.sum("all_n").alias("total"), *(F.sum(F.col(f"all_{c}") - F.col(c)).alias(f"other_{c}") for c in ("n", "sum", "logs")))
    gated = cut(total.where("total > 15 and other_n >= 2"))
    mine = cut(sets.join(gated.select("root"), "root", "left_semi").select("component", "root"))
    ips = mine.join(docs.select("component", "ip").distinct(), "component").groupBy("root").agg(F.count_distinct("ip").alias("ips"))
    others = mine.join(sets.select("component", F.col("root").alias("other"), "sample"), "component").where("root <> other")
    samples = cut(others.groupBy("root", "other").agg(F.min("sample").alias("sample")))
    roots = samples.groupBy("root").agg(F.count("*").alias("roots"))
    five = samples.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("sample.id", "other"))).where("place <= 5")
    five = cut(five.select("root", "place", F.col("sample.path").alias("path")).where("length(path) < 100"))
    a, b = five.alias("a"), five.alias("b")
    lev = a.join(b, F.expr("a.root = b.root and a.place <> b.place")).select("a.root", F.levenshtein("a.path", "b.path").alias("l"))
    # one distance of 0 makes the geometric mean 0
    geo = F.when(F.min("l") == 0, 0.0).otherwise(F.exp(F.avg(F.log(F.col("l").cast("double")))))
    lev = lev.groupBy("root").agg(F.avg("l").alias("lev_mean"), geo.alias("lev_geo")).where("lev_mean <> 0")
    ratio = F.log("other_n") / F.log("total")
    spam = ratio * (1 - F.log("ips") / F.log("total"))
    out = gated.join(ips, "root").join(roots, "root").join(lev, "root", "left").withColumn("ratio", ratio).withColumn("spam", spam).where("ratio >= 0.5 or spam > 0.5")
    return out.select("root", "total", F.col("other_n").alias("crossed"), "roots", "ips", F.round(F.col("other_sum") / F.col("other_n"), 4).alias("mean"), F.round(F.exp(F.col("other_logs") / F.col("other_n")), 4).alias("geo"), F.round("ratio", 6).alias("ratio"), F.round("spam", 6).alias("spam"), F.round("lev_mean", 4).alias("lev_mean"), F.round("lev_geo", 4).alias("lev_geo"))


@query()
def cross_domain_near_dupes(spark, d):
    """Near duplicates that a source shares with others, with its spam score."""
    sets = simhash_sets(spark, d).select("doc_id", "component")
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(sets, "doc_id")
    path = F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return cross_domain_scores(docs.select("component", F.col("source").alias("root"), (F.col("doc_id") % 97).alias("ip"), F.col("n_chars").alias("length"), path.alias("path"), F.col("doc_id").alias("id"))).withColumnRenamed("root", "source")


@query("""WITH b AS (SELECT server_ip, host, bool_or(http_result = 404) AS bad FROM fetches GROUP BY 1, 2)
SELECT server_ip, count(*) AS hosts, count(*) FILTER (WHERE bad) AS bad_hosts, CASE WHEN count(*) FILTER (WHERE bad) * 4 >= count(*) * 3 THEN 'ip' ELSE 'host' END AS level FROM b GROUP BY 1 HAVING count(*) FILTER (WHERE bad) > 0""")
def ip_blacklist_level(spark, d):
    """The address where three quarters of its hosts are bad, else the hosts."""
    b = view(spark, d, "fetches").groupBy("server_ip", "host").agg(F.bool_or(F.expr("http_result = 404")).alias("bad"))
    g = b.groupBy("server_ip").agg(F.count("*").alias("hosts"), F.count_if("bad").alias("bad_hosts")).where("bad_hosts > 0")
    return g.withColumn("level", F.when(F.col("bad_hosts") * 4 >= F.col("hosts") * 3, "ip").otherwise("host"))
