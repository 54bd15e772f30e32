"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines.

Equal vectors of a label become one class first. Normalised class vectors are
projected on random directions, shifted and cut into cells of a fixed width;
``k`` cells make a table's bucket, and ``tables`` buckets find a pair at the
threshold with probability ``recall`` at least (both follow from the corpus
size). Members of a bucket meet in blocks, every block with every other, so a
hot bucket is spread over tasks. A pair counts in the first table in which it
shares a bucket; its cosine is computed in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace, mix64, signed
from siltstone.llm.components import connected_components

#: Cell width for unit vectors, and most members of a block.
WIDTH, BLOCK = 1.0, 2048


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at ``distance`` share a cell of a random projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(rows: int, cosine: float, recall: float = 0.998) -> tuple[int, int]:
    """Projections for a bucket, so that unrelated rows seldom meet, and tables for ``recall``."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * cosine))
    k = max(4, round(math.log(max(rows, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _unit(rows: list, dim: int) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _buckets(k: int, tables: int, seed: int):
    kind = pa.schema([("h", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        planes: dict[int, tuple] = {}
        for batch in batches:
            h, label, vectors = (c.to_pylist() for c in batch.columns)
            dims = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(dims):
                if dim not in planes:
                    rng = np.random.default_rng([seed, int(dim)])
                    planes[dim] = (rng.normal(size=(dim, k * tables)), rng.uniform(0, WIDTH, k * tables))
                a, b = planes[dim]
                mine = np.flatnonzero(dims == dim)
                for at in range(0, len(mine), 1024):
                    part = mine[at : at + 1024]
                    cell = np.floor((_unit([vectors[i] for i in part], dim) @ a + b) / WIDTH).astype(np.int64)
                    with np.errstate(over="ignore"):
                        key = np.arange(tables, dtype=np.uint64) + np.uint64(dim << 20)
                        key = mix64(key[None, :] + mix64(np.array([label[i] for i in part], np.int64).view(np.uint64))[:, None])
                        cell = cell.view(np.uint64).reshape(len(part), tables, k)
                        for i in range(k):
                            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, i])
                    keys = signed(key)
                    yield pa.record_batch([pa.array([h[i] for i in part], pa.int64()), pa.array(list(keys), pa.list_(pa.int64()))], schema=kind)

    return run


def _meet(cosine: float):
    """Rows sorted by (key, lo, hi): members of one or two blocks of a bucket -> (h, links, top)."""
    kind = pa.schema([("h", pa.int64()), ("links", pa.int64()), ("top", pa.int64())])

    def settle(rows):
        t, lo, hi = rows[0][1:4]
        own = np.array([r[4] for r in rows])
        h, times = (np.array([r[i] for r in rows], np.int64) for i in (5, 6))
        x, keys = _unit([r[7] for r in rows], len(rows[0][7])), np.array([r[8][:t] for r in rows], np.int64).reshape(len(rows), t)
        left = np.flatnonzero(own == lo)
        right = left if lo == hi else np.flatnonzero(own == hi)
        links, top = np.zeros(len(rows), np.int64), np.arange(len(rows))
        pairs = []
        for at in range(0, len(left), 256):
            i, j = np.nonzero(x[left[at : at + 256]] @ x[right].T >= cosine)
            i, j = left[at + i], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            pairs.append((i, j))
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                first = ~(keys[a] == keys[b]).any(axis=1) if t else np.ones(len(a), bool)
                np.add.at(links, a[first], times[b[first]])
                np.add.at(links, b[first], times[a[first]])
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (top[:0], top[:0])
        while len(i):
            least = np.minimum(top[i], top[j])
            was = top.copy()
            np.minimum.at(top, i, least)
            np.minimum.at(top, j, least)
            top = top[top]
            if (was == top).all():
                break
        met = np.flatnonzero((links > 0) | (top != np.arange(len(rows))))
        return pa.record_batch([pa.array(v, pa.int64()) for v in (h[met], links[met], h[top[met]])], schema=kind)

    def run(batches):
        rows, at = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (row[0], row[2], row[3]) != at:
                    yield settle(rows)
                    rows = []
                at = (row[0], row[2], row[3])
                rows.append(row)
        if rows:
            yield settle(rows)

    return run


def near_duplicates(vectors: DataFrame, work: Workspace, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 11) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared if their labels, of any type, are equal (by a 64-bit
    digest) and not null and they have as many components. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing and is its own component. Repeated
    ids keep a row each; a null id never names a component unless it is alone.
    Other columns aren't read. An empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col))).alias("label"), v.alias("v"))
    fine = F.expr("label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("h", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "v")))
    classes = work.keep(rows.where("h is not null").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")
    k, tables = parameters(classes.count(), cosine)
    keyed = work.keep(classes.select("h", "label", "v").mapInArrow(_buckets(k, tables, seed), "h long, keys array<long>"), "keys")
    spread = keyed.select("h", F.posexplode("keys").alias("t", "key"))
    sizes = work.keep(spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    met = spread.join(sizes, "key")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    placed = met.select("key", "t", "h", F.pmod(F.xxhash64("h", "t"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = work.keep(placed.select("key", "t", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "h"), "placed")
    full = placed.join(classes.select("h", "times", "v"), "h").join(keyed, "h").select("key", "t", "lo", "hi", "own", "h", "times", "v", "keys")
    # keys hold the table's number, so (key, lo, hi) names a pair of blocks
    full = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = work.keep(full.mapInArrow(_meet(cosine), "h long, links long, top long"), "found")
    comp = connected_components(found.select(F.col("h").alias("a"), F.col("top").alias("b")), work)
    links = work.keep(found.groupBy("h").agg(F.sum("links").alias("links")), "links")
    named = classes.select("h", "id", "times").join(comp, F.col("h") == F.col("node"), "left").join(links, "h", "left")
    named = work.keep(named.select("h", "id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "h").alias("component")), "named")
    least = work.keep(named.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    of_class = work.keep(named.join(least, "component").select("h", "n_links", "component_id"), "of_class")
    out = rows.select("id", "h").join(of_class, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
