"""Shards by a Feistel permutation of global row numbers, with cycle walking.

Rows get gapless numbers in an order that depends on the data alone: by the hash
bucket of (id, digest), then by id within the bucket. A keyed Feistel network on
``a * b >= rows`` values permutes the numbers; a value beyond the last row walks
on until it falls inside. The permuted number p gives shard ``p % shards`` and
slot ``p div shards``, so counts differ by one at most, slots have no gap, and
both can be computed for any number without the table. Expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace

BUCKETS, ROUNDS, WALKS = 4096, 6, 16


def domain(rows: int) -> tuple[int, int]:
    """The sides of the Feistel domain: fewer than one side's length of values lie beyond the rows."""
    a = max(1, math.isqrt(rows))
    a += a * a < rows
    return a, max(1, -(-rows // a))


def feistel(x: str, a: int, b: int, key: int) -> str:
    """SQL of one pass: x = l * b + r with l below a and r below b; rounds change l and r in turn."""
    left, right = f"({x} div {b})", f"({x} % {b})"
    out = f"named_struct('l', {left}, 'r', {right})"
    for i in range(ROUNDS):
        side = "named_struct('l', pmod(s.l + pmod(xxhash64(s.r, {k}L), {a}L), {a}L), 'r', s.r)" if i % 2 == 0 else "named_struct('l', s.l, 'r', pmod(s.r + pmod(xxhash64(s.l, {k}L), {b}L), {b}L))"
        side = side.format(k=key * 1_000_003 + i, a=a, b=b)
        out = f"transform(array({out}), s -> {side})[0]"
    return f"transform(array({out}), s -> s.l * {b}L + s.r)[0]"


def permuted(x: str, rows: int, key: int):
    """A column: the place of row number ``x`` (an expression) in the permutation of ``rows`` rows."""
    a, b = domain(rows)
    once = feistel("v", a, b, key)
    walk = f"aggregate(sequence(1, {WALKS}), {feistel(f'cast({x} as bigint)', a, b, key)}, (v, i) -> if(v < {rows}L, v, {once}))"
    return F.expr(f"transform(array({walk}), v -> if(v < {rows}L, v, cast(raise_error('walk too long') as bigint)))[0]")


def shard(docs: DataFrame, work: Workspace, shards: int = 16, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, row_number, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has size 1 and the
    digest of an empty one. Null and repeated ids keep a row each (equal rows are
    interchangeable), an empty table gives an empty result, and other columns
    aren't read. Copies of a text don't share a shard: counts are what is equal.
    """
    data = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = work.keep(rows.withColumn("bucket", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int")), "rows")
    counts = work.keep(rows.groupBy("bucket").agg(F.count("*").alias("n")), "counts")  # BUCKETS rows at most
    total = rows.count()
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("id", "size", "text_crc32")) - 1
    numbered = rows.withColumn("within", within).join(F.broadcast(starts), "bucket").withColumn("row_number", F.col("before") + F.col("within"))
    place = permuted("row_number", max(total, 1), key)
    out = numbered.withColumn("place", place)
    return out.select("id", "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))
