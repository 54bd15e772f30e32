"""N-gram Jaccard join: universe partition and pigeonhole, verified exactly.

A document's set holds its distinct n-word shingles as 64-bit digests. Equal
sets become one class first, so copies cost one row each. Classes fall into
size bands; in a band two sets that reach the threshold differ in at most H
shingles. Hashing splits the universe of shingles into segments, each worth one
unit (indexed by its whole subset: it survives no difference) or two units
(indexed by its subset and all subsets with one shingle deleted: it survives one
difference). With ``H + 1 + 2 * A`` units, a pair keeps more than ``2 * A`` of
them whatever the differences, so each of the two sets may leave ``A`` units out
of the index and still meet the other, or ``2 * A`` where all segments are of the
first kind and both sets leave out the first keys of one order of all keys. It
leaves out empty segments and then those with the longest posting lists, as
counted over the whole corpus. How many segments of each kind a band gets is
decided by cost.

Sets that meet under a key are a group. A group of at most ``LOCAL`` members is
closed to components by one task; groups of the same members count once. A larger
group gets a hub, its members are verified against it, and the links are closed.
Two members that are still apart can link only if they share differences from the
hub, more than half of those of one of them; such members meet again under their
rarest differences, in groups that are closed by a task or get hubs of their own.
Each round tests a row per member and group, never a large group's pairs. No link
between different sets is lost: every pair that meets is verified, or already
connected, or proven to be below the threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace, WordHasher, mix64, shingle_set, signed
from siltstone.llm.components import connected_components

#: Members that are verified against one hub in one group of rows.
CHUNK = 200
#: Tables of at most so many rows (40 bytes each) are broadcast, by their count; longer ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Assumed chance that an unrelated document holds a given shingle.
COINCIDENCE = 1 / 1024
#: Units that a set may leave out, as a share of those that differences can spoil.
ALLOWANCE = 0.1
#: Sets whose postings a task remembers to have written, and members whose differences tell a hub's common ones.
SEEN, GUIDES = 200_000, 32
#: Shingles in a part of a sketch, on average.
PART = 4
#: Most members of a group that one task compares by sketches.
WIDE = 4096
#: Most members of a group that one task closes, and shingles that it counts at a time.
LOCAL, COLUMNS = 512, 1 << 12
_SLOT = 1 << 20
#: Postings that a task deals out at a time, postings in a bucket or so, and bytes of a posting.
DEALT, BUCKET, _POSTING = 1 << 18, 250_000, 20


@dataclass(frozen=True)
class Allocation:
    """Segments of a band: the first ``deletion`` ones carry one-deletion neighbourhoods."""

    deletion: int
    exact: int
    allowance: int

    @property
    def segments(self) -> int:
        return self.deletion + self.exact


class Bands:
    """Size bands for a threshold in percent; ``docs`` (a count of the corpus) weighs the costs."""

    def __init__(self, percent: int, docs: int):
        self.percent, self.docs, self.ratio = percent, max(docs, 1), max(1.6, 100 / percent)

    @lru_cache(maxsize=None)  # noqa: B019  one object per task
    def low(self, k: int) -> int:
        return 1 if k == 0 else max(self.low(k - 1) + 1, math.ceil(self.low(k - 1) * self.ratio))

    def band(self, n: int) -> int:
        k = max(0, int(math.log(n, self.ratio)) - 12) if n > 64 else 0
        while self.low(k + 1) <= n:
            k += 1
        return k

    def of(self, n: int) -> list[int]:
        """The band of a set of ``n`` shingles, and the next one if a partner can be there."""
        k = self.band(n)
        return [k, k + 1] if 100 * n >= self.percent * self.low(k + 1) else [k]

    @lru_cache(maxsize=None)  # noqa: B019
    def differences(self, k: int) -> int:
        return 2 * (self.low(k + 1) - 1) * (100 - self.percent) // (100 + self.percent)

    @lru_cache(maxsize=None)  # noqa: B019
    def allocation(self, k: int) -> Allocation | None:
        """The cheapest mix for band ``k``; None where only equal sets can link."""
        h = self.differences(k)
        if h == 0:
            return None
        allowance = math.ceil(ALLOWANCE * (h + 1))
        units, size, best = h + 1 + 2 * allowance, self.low(k), None
        for step in range(9):
            d = units // 2 * step // 8
            x = units - 2 * d
            z = size / (d + x)
            rows = x + d * (z + 1)
            # a posting that meets another set's costs as much again
            met = x * min(1, self.docs * COINCIDENCE**z) + d * (z + 1) * min(1, self.docs * COINCIDENCE ** max(z - 1, 0))
            cost = rows + met
            if best is None or cost < best[0]:
                best = (cost, Allocation(d, x, allowance if d else 2 * allowance))
        return best[1]


def index_keys(s: np.ndarray, k: int, a: Allocation) -> tuple[np.ndarray, int]:
    """Keys of the sorted set ``s`` in band ``k``, and the units it may still leave out.

    Bit 0 of a key tells a segment with one-deletion neighbourhoods.
    """
    m = a.segments
    with np.errstate(over="ignore"):
        inner = mix64(s)
        place = (s >> np.uint64(32)).astype(np.int64) * m >> 32  # monotone in s
        count = np.bincount(place, minlength=m)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(inner, dtype=np.uint64)])
        end = np.cumsum(count)
        subset = total[end] - total[end - count]
        salt = mix64(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32))
        left, skip = a.allowance, np.zeros(m, bool)
        empty = np.flatnonzero(count[a.deletion :] == 0)[:left] + a.deletion
        skip[empty] = True
        left -= len(empty)
        keys = mix64(subset + salt) & ~np.uint64(1)
        keys[: a.deletion] |= np.uint64(1)
        out = [keys[~skip]]
        if a.deletion:
            near = place < a.deletion
            p = place[near]
            out.append(mix64(subset[p] - inner[near] + salt[p]) | np.uint64(1))
        return np.unique(np.concatenate(out)), left


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's shingles lie in each of equal parts of the universe; a power of two of parts, ``PART`` shingles a part or so."""
    bits = max(0, (max(len(s), 1) // PART - 1).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one length, the shortest one's: neighbouring parts are added up."""
    parts = min(map(len, sketches))
    return np.stack([np.frombuffer(x, np.uint8).reshape(parts, -1).sum(axis=1, dtype=np.int32) for x in sketches])


def may_link(a: np.ndarray, b: np.ndarray, na, nb, percent: int) -> np.ndarray:
    """Whether sets of ``na`` and ``nb`` shingles with these folded sketches can link: two sets differ by as much as their sketches at least."""
    return (100 + percent) * np.abs(a - b).sum(axis=-1) <= (100 - percent) * (na + nb)


def _digests(n: int):
    """Rows (id, n, h, sketch) of texts (id, text); h and n identify the set."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(hasher, t, n) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], names=["id", "n", "h", "sketch"])

    return run


def _postings(n: int, percent: int, docs: int, buckets: int):
    """Rows (bucket, rows) of texts: the postings (key, h, tag) of their sets in all bands, dealt out by key, the three columns of a bucket as bytes one after the other.

    A set is posted once per task, however often it occurs there.
    """
    kind = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])

    def dealt(h, tag, keys):
        size = list(map(len, keys))
        key = np.concatenate(keys)
        bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        columns = [x[order] for x in (signed(key), np.repeat(np.array(h, np.int64), size), np.repeat(np.array(tag, np.int32), size))]
        count = np.bincount(bucket.astype(np.int64), minlength=buckets)
        end, own = np.cumsum(count), np.flatnonzero(count)
        rows = [b"".join(c[end[i] - count[i] : end[i]].tobytes() for c in columns) for i in own]
        return pa.record_batch([pa.array(own, pa.int32()), pa.array(rows, pa.binary())], schema=kind)

    def run(batches):
        hasher, bands, seen = WordHasher(), Bands(percent, docs), set()
        h, tag, keys, held = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(at, 64).to_pylist():
                    s = shingle_set(hasher, text, n)
                    own = set_digest(s)
                    if not len(s) or own in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    for slot, k in enumerate(bands.of(len(s))):
                        if a := bands.allocation(k):
                            found, left = index_keys(s, k, a)
                            h.append(own)
                            tag.append(left + slot * _SLOT)
                            keys.append(found)
                            held += len(found)
                if held >= DEALT:
                    yield dealt(h, tag, keys)
                    h, tag, keys, held = [], [], [], 0
        if held:
            yield dealt(h, tag, keys)

    return run


def _met():
    """Rows (bucket, rows) sorted by bucket, as ``_postings`` gives them: (key, h, tag, c), each once, of the keys of c sets, two or more; other keys lead nowhere."""
    kind = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("tag", pa.int32()), ("c", pa.int64())])

    def shared(parts):
        size = [len(p) // _POSTING for p in parts]
        key, h, tag = (np.concatenate([np.frombuffer(p, t, k, k * at) for p, k in zip(parts, size, strict=True)]) for t, at in ((np.int64, 0), (np.int64, 8), (np.int32, 16)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(False, same) | np.append(same, False)]
        key, h, tag = key[order], h[order], tag[order]
        order = np.lexsort((h, key))
        key, h, tag = key[order], h[order], tag[order]
        once = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))[: len(key)]
        key, h, tag = key[once], h[once], tag[once]
        of, c = np.unique(key, return_inverse=True, return_counts=True)[1:]
        c = c[of]
        return pa.record_batch([pa.array(x[c > 1]) for x in (key, h, tag, c)], schema=kind)

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and parts:
                    yield shared(parts)
                    parts = []
                now = bucket
                parts.append(rows.as_buffer().to_pybytes())
        if parts:
            yield shared(parts)

    return run


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def set_digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        sums = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix64(np.array([sums + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sets(n: int):
    """Rows (h, once, items) of wanted texts (h, once, text), items the set's digests as bytes."""
    kind = pa.schema([("h", pa.int64()), ("once", pa.bool_()), ("items", pa.binary())])

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(w, once, s.tobytes()) for w, once, t in zip(*(c.to_pylist() for c in part.columns), strict=True) if set_digest(s := shingle_set(hasher, t, n)) == w]
                yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    return run


def prefixes(apart: int, common: int, own: int, hub: int, percent: int) -> tuple[bool, int, int]:
    """Whether a set of ``own`` shingles links with its hub, and how many of its ``apart`` differences from it are keys.

    With k = (1 - t) / (1 + t), two sets x and y link if they differ in at most
    k * (|x| + |y|) shingles. If x doesn't link with the hub p, then a link of x
    and y needs more than half of |y - p| - k * (|y| - |p|) of y's differences
    (as counts) to be x's too, so the first count leaves out the others; it holds
    for x as well if y doesn't link with the hub either. Against a y that links
    with the hub, x needs the second, longer count.
    """
    k, of = 100 - percent, 100 + percent
    linked = 100 * common >= percent * (own + hub - common)
    half = apart - max((apart * of - (own - hub) * k) // (2 * of), 0)
    most = k * (own + 100 * own // percent) // of
    return linked, half, half if linked else max(half, apart - max(1, apart - most) + 1)


def _compare(percent: int, differ: bool):
    """Sorted rows (hub, chunk, role, member, w, first, items): the hub's own row (0), guides (1), members (2).

    Gives the links (hub, member), or with ``differ`` each member's differences
    from the hub that are keys: (hub, h, w, first, side, x). Guides are the same members
    in every chunk of a hub; their common differences come last everywhere.
    """
    kind = pa.schema([("hub", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("first", pa.int32()), ("side", pa.int32()), ("x", pa.int64())] if differ else [("hub", pa.int64()), ("member", pa.int64())])

    def apart(own, s):
        both = np.intersect1d(own, s, assume_unique=True)
        return both, *(np.setdiff1d(x, both, assume_unique=True) for x in (s, own))

    def run(batches):
        group = own = usual = None
        guides: list[np.ndarray] = []
        for batch in batches:
            rows = [[np.zeros(0, np.int64)] for _ in kind]
            for hub, chunk, role, member, w, first, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(items, np.uint64)
                if role == 0:
                    group, own, usual, guides = (hub, chunk), s, None, []
                    continue
                if group != (hub, chunk):
                    continue
                if role == 1:
                    guides += apart(own, s)[1:]
                    continue
                if not differ:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(s) - common):
                        rows[0].append([hub])
                        rows[1].append([member])
                    continue
                if usual is None:
                    x, n = np.unique(np.concatenate(guides), return_counts=True) if guides else (s[:0], s[:0])
                    x, n = x[n > 1], n[n > 1]
                    usual = x[np.argsort(n, kind="stable")]
                both, new, gone = apart(own, s)
                d = np.concatenate([new, gone])
                d = np.concatenate([d[~np.isin(d, usual)], usual[np.isin(usual, d)]])
                linked, half, full = prefixes(len(d), len(both), len(s), len(own), percent)
                side = np.full(full, 0 if linked else 1, np.int32)
                side[half:] = 2
                for column, v in zip(rows, (np.full(full, hub), np.full(full, member), np.full(full, w), np.full(full, first, np.int32) if first >= 0 else side, side, signed(d[:full])), strict=True):
                    column.append(v)
            yield pa.record_batch([pa.array(np.concatenate(c), f.type) for c, f in zip(rows, kind, strict=True)], schema=kind)

    return run


def _link_groups(percent: int):
    """Rows (hub, h, items) sorted by hub: the links (a, b) that join each group's members, none twice."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(members, sets):
        size = np.array([len(s) for s in sets])
        x, of = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(of, kind="stable")
        of, row = of[order], row[order]
        for at in range(0, len(x), COLUMNS):
            lo, hi = np.searchsorted(of, (at, at + COLUMNS))
            m = np.zeros((len(sets), min(COLUMNS, len(x) - at)), np.float32)
            m[row[lo:hi], of[lo:hi] - at] = 1
            common += m @ m.T
        common = np.rint(common).astype(np.int64)
        i, j = np.nonzero(np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1))
        top = np.arange(len(sets))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if top[a] != top[b]:
                yield members[a], members[b]
                top[top == top[b]] = top[a]

    def run(batches):
        key, members, sets = None, [], []

        def links():
            found = list(close(members, sets)) if len(sets) > 1 else []
            return pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=kind)

        for batch in batches:
            for k, h, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    yield links()
                    key, members, sets = k, [], []
                members.append(h)
                sets.append(np.frombuffer(items, np.uint64))
        yield links()

    return run


def _near(percent: int):
    """Sorted rows (hub, chunk, role, h, n, sketch), the hub's own row (role 0) first: pairs (hub, h) that can link by their sketches."""
    kind = pa.schema([("hub", pa.int64()), ("h", pa.int64())])

    def run(batches):
        group = own = None
        for batch in batches:
            found = []
            for hub, chunk, role, h, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0:
                    group, own, size = (hub, chunk), x, n
                elif group == (hub, chunk) and may_link(*_folded([own, x]), size, n, percent):
                    found.append((hub, h))
            yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=kind)

    return run


def _kin(percent: int):
    """Rows (hub, h, n, sketch) sorted by hub: those members (hub, h) of each group that can link with another one by their sketches."""
    kind = pa.schema([("hub", pa.int64()), ("h", pa.int64())])

    def able(rows):
        if len(rows) < 2:
            return []
        x, n = _folded([r[2] for r in rows]), np.array([r[1] for r in rows])
        links = np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            fit = may_link(x[i], x[i + 1 :], n[i], n[i + 1 :], percent)
            links[i] |= fit.any()
            links[i + 1 :] |= fit
        return [r[0] for r, ok in zip(rows, links, strict=True) if ok]

    def run(batches):
        key, rows = None, []

        def done():
            found = able(rows)
            return pa.record_batch([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=kind)

        for batch in batches:
            for hub, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hub != key:
                    yield done()
                    key, rows = hub, []
                rows.append(row)
        yield done()

    return run


class JaccardJoin:
    """Documents whose n-word shingle sets have a Jaccard similarity of ``percent`` or more.

    Takes any table with an id and a text column; other columns are not read, so
    they may have any name. A null or blank text has no shingle and links with
    nothing; a null id stays a row of its own, and a component's id is its
    smallest id that is not null. Repeated rows and ids each keep their row.
    An empty table gives an empty result.
    """

    def __init__(self, docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80):
        self.n, self.percent, self.work = n, percent, work
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def _sets_of(self, wanted: DataFrame, classes: DataFrame) -> DataFrame:
        """(h, items) for every class in ``wanted``, read again from one of its texts."""
        wanted = self.work.keep(wanted.join(classes, "h").select("h", "id", "once"), "wanted")
        texts = self.docs.alias("d").join(_sized(wanted).alias("w"), F.expr("d.id <=> w.id")).select("w.h", "w.once", "d.text")
        found = self.work.keep(texts.mapInArrow(_sets(self.n), "h long, once boolean, items binary"), "sets")
        if not wanted.where("not once").limit(1).count():
            return found
        return self.work.keep(found.where("once").union(found.where("not once").dropDuplicates(["h"])), "sets")

    def _compared(self, pairs: DataFrame, sets: DataFrame, differ: bool) -> DataFrame:
        """Distinct pairs (hub, h, w, first) -> what ``_compare`` gives, a hub's members in chunks."""
        sizes = self.work.keep(pairs.groupBy("hub").agg(F.count("*").alias("c")), "hubs")
        size = F.ceil(F.col("c") / CHUNK).cast("int")
        chunks = F.explode(F.sequence(F.lit(0), size - 1))
        rows = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("h"), size).cast("int").alias("chunk"), F.lit(2).alias("role"), "h", "w", "first")
        rows = rows.union(sizes.select("hub", chunks, F.lit(0), F.col("hub"), F.lit(0), F.lit(0)))
        if differ:
            guide = F.pmod(F.xxhash64("h", F.lit(1)), F.ceil(F.col("c") / GUIDES)) == 0
            rows = rows.union(pairs.join(sizes, "hub").where(guide).select("hub", chunks, F.lit(1), "h", "w", "first"))
        full = _sized(self.work.keep(rows, "compared")).join(sets, "h").select("hub", "chunk", "role", F.col("h").alias("member"), "w", "first", "items")
        full = full.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role")
        return full.mapInArrow(_compare(self.percent, differ), "hub long, h long, w long, first int, side int, x long" if differ else "hub long, member long")

    def _able(self, pairs: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """By sketches: which of the ``pairs`` (hub, h, c) can link, and which members of a hub with at most ``WIDE`` of them with another one."""
        work, size = self.work, F.ceil(F.col("c") / CHUNK).cast("int")
        rows = pairs.select("hub", F.pmod(F.xxhash64("h"), size).cast("int").alias("chunk"), F.lit(1).alias("role"), "h")
        rows = rows.union(pairs.select("hub", "c").distinct().select("hub", F.explode(F.sequence(F.lit(0), size - 1)), F.lit(0), F.col("hub")))
        full = _sized(work.keep(rows, "sketched")).join(sketches, "h").select("hub", "chunk", "role", "h", "n", "sketch")
        full = full.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role")
        near = work.keep(full.mapInArrow(_near(self.percent), "hub long, h long"), "near")
        full = _sized(work.keep(pairs.where(F.col("c") <= WIDE).select("hub", "h"), "grouped")).join(sketches, "h").select("hub", "h", "n", "sketch")
        full = full.repartition("hub").sortWithinPartitions("hub")
        return near, work.keep(full.mapInArrow(_kin(self.percent), "hub long, h long"), "kin")

    def _joined(self, comp: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components (node, component) after more links: the links join components, not sets, so that only those move."""
        work = self.work
        if comp is None:
            return connected_components(links, work)
        a, b = (comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        edges = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        moved = connected_components(edges, work)
        now = comp.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return work.keep(now.union(moved.join(comp, "node", "left_anti")), "components")

    def _within(self, small: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) that close groups (hub, h) of at most ``LOCAL`` members, a group in a task."""
        full = _sized(self.work.keep(small.select("hub", "h"), "small")).join(sets, "h").select("hub", "h", "items").repartition("hub").sortWithinPartitions("hub")
        return full.mapInArrow(_link_groups(self.percent), "a long, b long")

    def _distinct(self, groups: DataFrame) -> DataFrame:
        """Groups (key, h, ...) of two members or more, each set of members once."""
        of = groups.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("h")).alias("members")).where("c > 1")
        of = self.work.keep(of.groupBy("c", "members").agg(F.min("key").alias("key")).select("key"), "distinct")
        return self.work.keep(groups.join(of, "key"), "of_distinct")

    def _pivoted(self, groups: DataFrame) -> DataFrame:
        """Rows (key, hub, h, w, first) of the first groups: each gets the hub that its own member with most company meets most often.

        Such a hub, in the group or not, is near the middle of a family of sets:
        the family is compared with one set, however many keys it meets under.
        """
        work = self.work
        weight = work.keep(groups.groupBy("key").agg(F.count("*").alias("c")).join(groups, "key").groupBy("h").agg(F.sum("c").alias("w")), "weight")
        groups = work.keep(groups.join(weight, "h").select("key", "h", "w"), "weighed")
        top = F.max(F.struct("w", "h"))
        of = work.keep(groups.groupBy("key").agg(top.getField("h").alias("top"), top.getField("w").alias("top_w")), "top")
        met = groups.join(of, "key").groupBy("h", "top").agg(F.count("*").alias("m"), F.max("top_w").alias("top_w"))
        best = met.groupBy("h").agg(F.max(F.struct("m", "top_w", "top")).getField("top").alias("hub"))
        chosen = work.keep(of.join(best, of.top == best.h).select("key", "hub"), "chosen")
        return work.keep(groups.join(chosen, "key").where("h <> hub").select("key", "hub", "h", "w", F.lit(-1).alias("first")), "open")

    def _mixed(self, groups: DataFrame, comp: DataFrame) -> DataFrame:
        """Rows (key, hub, h, w, first) of the groups (key, h, w, first, side) in which two sets of different components may link.

        ``side`` is what ``prefixes`` tells of a set and its last hub, ``first`` of
        its first one: 0 linked, 1 not, 2 not and only to be tested against linked ones.
        """
        work = self.work
        groups = groups.join(comp, F.col("h") == F.col("node"), "left").select("key", "h", "w", "first", "side", F.coalesce("component", "h").alias("component"))
        lo, hi = F.min("component").alias("lo"), F.max("component").alias("hi")
        sides = groups.groupBy("key").agg(F.min("side").alias("s"), F.min("first").alias("f"), lo, hi).where("lo <> hi").select("key", "s", "f")
        kept = groups.join(work.keep(sides, "sides"), "key").where("(side < 2 or s = 0) and (first < 2 or f = 0)").drop("s", "f")
        kept = self._distinct(work.keep(kept, "kept"))
        top, linked = F.struct("w", "h"), F.col("first") == 0
        of = kept.groupBy("key").agg(
            lo, hi, F.count_if(linked).alias("a"), F.count_if(~linked).alias("b"),
            F.max(F.when(linked, top)).getField("h").alias("ha"), F.max(F.when(~linked, top)).getField("h").alias("hb"),
        )
        # the smaller side of a group gives its hub
        few = (F.col("a") > 0) & ((F.col("a") <= F.col("b")) | (F.col("b") == 0))
        of = work.keep(of.where("lo <> hi").select("key", F.when(few, F.col("ha")).otherwise(F.col("hb")).alias("hub")), "mixed")
        return work.keep(kept.join(of, "key").where("h <> hub").select("key", "hub", "h", "w", "first"), "open")

    def _close(self, held: DataFrame, classes: DataFrame, sketches: DataFrame) -> DataFrame:
        """Groups ``held`` (key, h) whose members may link -> (node, component).

        Sketches first tell most pairs that can't link, at a small part of the sets'
        size. A round tests each group's hub against its members and closes the links;
        where the members are then in one component nothing is left to test. Of
        the other groups those with one hub are taken together: a task closes them
        if they have at most ``LOCAL`` members. Else two members can link only if
        they differ from the hub in common shingles (see ``prefixes``); these make
        the groups of the next round. From the second round on the hub is a member
        and leaves its group, so rounds end.
        """
        work, comp, sets = self.work, None, None
        open_rows = self._pivoted(self._distinct(held))
        while comp is None or open_rows.limit(1).count():
            pairs = open_rows.groupBy("hub", "h").agg(F.max("w").alias("w"), F.min("first").alias("first"))
            pairs = work.keep(pairs, "paired")
            pairs = work.keep(pairs.join(pairs.groupBy("hub").agg(F.count("*").alias("c")), "hub"), "pairs")
            work.relieve()  # a round is many short queries; heaps grow from one to the next
            near, kin = self._able(pairs, sketches)
            wide = pairs.where(F.col("c") > WIDE).select("hub", "h")
            able = kin.union(wide)
            able = work.keep(able.join(able.groupBy("hub").agg(F.count("*").alias("c")), "hub"), "able")
            if sets is None:  # later rounds' sets are all members of large groups now
                some = [near.select("h"), near.select("hub"), able.select("h"), able.where(F.col("c") > LOCAL).select("hub")]
                sets = self._sets_of(reduce(DataFrame.union, some).distinct(), classes)
            work.relieve()
            links = self._compared(near.join(pairs, ["hub", "h"]).drop("c"), sets, False).select(F.col("hub").alias("a"), F.col("member").alias("b"))
            comp = self._joined(comp, work.keep(links, "links"))
            work.relieve()
            named = open_rows.join(comp, F.col("h") == F.col("node"), "left").select("key", "hub", F.coalesce("component", "h").alias("component"))
            still = named.groupBy("key", "hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            left = open_rows.join(still.select("key"), "key").select("hub", "h").distinct().join(able, ["hub", "h"])
            left = work.keep(left.join(pairs.drop("c"), ["hub", "h"]), "left")
            comp = self._joined(comp, work.keep(self._within(left.where(F.col("c") <= LOCAL), sets), "inner"))
            large = work.keep(left.where(F.col("c") > LOCAL).drop("c"), "large")
            groups = self._compared(large, sets, True).select(F.xxhash64("hub", "x").alias("key"), "h", "w", "first", "side")
            groups = work.keep(groups, "groups")
            work.keep_only(classes, sketches, sets, comp, groups, *self.result)
            work.relieve()
            open_rows = self._mixed(groups, comp)
        return comp

    def run(self) -> DataFrame:
        """One row per document: id, n_shingles, component_id, n_copies (rows with an equal set, itself included)."""
        work, count = self.work, self.docs.count()
        id_name = self.docs.schema["id"].dataType.simpleString()
        rows = work.keep(self.docs.mapInArrow(_digests(self.n), f"id {id_name}, n long, h long, sketch binary"), "sketched_rows")
        sketches = work.keep(rows.where("n > 0").groupBy("h").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
        whole, rows = rows, work.keep(rows.drop("sketch"), "rows")
        work.forget(whole)
        # a class is read again from the row of its smallest id, or rows if the id isn't unique
        ids = rows.where("n > 0").groupBy("id").agg(F.count("*").alias("c"))
        classes = rows.where("n > 0").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies")).alias("k")
        classes = classes.join(ids.alias("i"), F.expr("k.id <=> i.id")).select("k.*", (F.col("c") == 1).alias("once"))
        classes = work.keep(classes, "classes")
        # postings move once, as bytes, and are never written as a table; a set has no more of them than about its shingles
        buckets = 1 + (rows.agg(F.sum("n")).first()[0] or 0) // (2 * BUCKET)
        postings = self.docs.select("text").mapInArrow(_postings(self.n, self.percent, count, buckets), "bucket int, rows binary")
        postings = postings.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")  # a bucket a task; by hash some tasks would get five
        met = work.keep(postings.mapInArrow(_met(), "key long, h long, tag int, c long"), "met")
        work.relieve()
        # Each class leaves out its longest lists as far as its allowance reaches.
        spent = F.sum(1 + (F.col("key") % 2 != 0).cast("int")).over(Window.partitionBy("h", "tag").orderBy(F.desc("c"), "key").rowsBetween(Window.unboundedPreceding, 0))
        held = work.keep(met.withColumn("spent", spent).where(F.col("spent") > F.col("tag") % _SLOT).select("key", "h"), "held")
        work.forget(met)
        work.relieve()
        self.result = (rows,)
        comp = self._close(held, classes, sketches)
        work.relieve()
        named = classes.join(comp, classes.h == comp.node, "left").select("h", "id", "copies", F.coalesce("component", "h").alias("component"))
        named = work.keep(named, "named")
        least = work.keep(named.groupBy("component").agg(F.min("id").alias("component_id")), "least")
        of_class = work.keep(named.join(least, "component").select("h", "component_id", "copies"), "of_class")
        work.keep_only(rows, of_class)
        out = rows.select("id", "n", "h").join(of_class, "h", "left")
        own = F.col("n") == 0
        return out.select("id", F.col("n").alias("n_shingles"), F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"))



def jaccard_components(docs: DataFrame, work: Workspace, **options) -> DataFrame:
    return JaccardJoin(docs, work, **options).run()
