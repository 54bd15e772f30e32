"""Near-duplicate operators without SQL against brute force."""

import itertools
import math
import random

import duckdb

from siltstone.operators import dedupe, graph
from siltstone.operators.dedupe import cross_domain_near_dupes, cross_domain_scores
from siltstone.plans import catalog

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def scores(docs):
    """The surveyed system's reducer, set by set."""
    groups, out = {}, {}
    for r in docs:
        if r[0] is not None:
            groups.setdefault(r[0], []).append(r)
    for root in sorted({r[1] for r in docs}):
        hits = [r for g in groups.values() if len(g) > 1 and any(x[1] == root for x in g) for r in g]
        cross = [r for r in hits if r[1] != root]
        if len(hits) <= 15 or len(cross) < 2:
            continue
        ips = {r[2] for r in hits}
        ratio = math.log(len(cross)) / math.log(len(hits))
        spam = ratio * (1 - math.log(len(ips)) / math.log(len(hits)))
        if ratio < 0.5 and spam <= 0.5:
            continue
        first = {}
        for r in sorted(cross, key=lambda r: r[5]):
            first.setdefault(r[1], r)
        paths = [r[4] for r in list(first.values())[:5] if len(r[4]) < 100]
        lev = [distance(a, b) for a, b in itertools.permutations(paths, 2)]
        n = [max(r[3], 1) for r in cross]
        geo = lambda x: 0.0 if 0 in x else math.exp(sum(map(math.log, x)) / len(x))
        out[root] = (len(hits), len(cross), len(first), len(ips), sum(n) / len(n), geo(n), ratio, spam, *((sum(lev) / len(lev), geo(lev)) if any(lev) else (None, None)))
    return out


def same(got, want):
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
    for k, v in want.items():
        assert all(a is b is None or abs(a - b) <= 1e-4 * max(1, abs(b)) for a, b in zip(got[k][4:], v[4:], strict=True)), (k, got[k], v)


def test_cross_domain_scores(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), f"r{rng.randrange(9)}", rng.randrange(12), rng.randrange(500), "/" + "ab" * rng.randrange(60), i) for i in range(160)]
    rows += [(100 + i // 8, "lone" if i % 8 else f"r{i % 5}", i, 9, "/same", 200 + i) for i in range(40)]  # below the gate of the scores
    rows += [(300, "x", 1, 0, "/same", 300 + i) for i in range(9)] + [(300, "y", 1, 0, "/same", 310 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "component long, root string, ip long, length long, path string, id long")
    got = {r.root: tuple(r)[1:] for r in cross_domain_scores(df).collect()}
    want = scores(rows)
    assert "lone" in {r[1] for r in rows} and 2 < len(want) < 12
    same(got, want)


def test_near_copies_count(spark):
    sets = {r.doc_id: r.component for r in catalog.queries()["simhash_sets"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars").collect()
    want = scores([(sets[r.doc_id], r.source, r.doc_id % 97, r.n_chars, f"/{r.lang}/{r.doc_id}", r.doc_id) for r in docs])
    same({r.source: tuple(r)[1:] for r in cross_domain_near_dupes(spark, SF).collect()}, want)


def test_hamming_pairs_of_all_orders(spark):
    found = [tuple(r) for r in catalog.queries()["hamming_pairs"](spark, SF).collect()]
    h = "xxhash64(o_custkey) ^ shiftleft(1L, cast(o_orderkey % 64 as int))"
    hashes = sorted(r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").selectExpr(h).distinct().collect())
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = sorted((a, b, bits(a, b)) for a, b in itertools.combinations(hashes, 2) if bits(a, b) <= 2)
    assert len(hashes) > 512 and want and sorted(found) == want


def test_feeds_of_all_hosts(spark):
    found = sorted(tuple(r) for r in catalog.queries()["feed_discovery"](spark, SF).collect())
    hosts = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'purchase'").select("event_id", "user_id").collect():
        host = f"{'www.' if r.user_id % 3 == 0 else ''}h{r.user_id}.site{r.user_id % 12}.com"
        hosts.setdefault(host, set()).add(f"http://{host}/p{r.event_id % 60}{'/feed' if r.event_id % 2 == 0 else '/a/feed'}")
    want = []
    for host, feeds in hosts.items():
        level = [f for f in feeds if f.count("/") == min(x.count("/") for x in feeds)]
        want += [(host, f) for f in level] if len(level) <= 5 else []
    assert found == sorted(want) and any(h.startswith("www.") for h, _ in found)


def planned(monkeypatch, module):
    """Plans of the tables that ``module`` writes from now on."""
    plans, cut = [], module.cut

    def told(df, *last):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *last)

    monkeypatch.setattr(module, "cut", told)
    return plans


def test_hashes_and_labels_are_not_broadcast(spark, monkeypatch):
    plans = planned(monkeypatch, graph)
    rng = random.Random(5)
    some = [rng.getrandbits(63) for _ in range(60)]
    hashes = sorted({h ^ (1 << rng.randrange(63)) for h in some for _ in range(3)} | set(some))
    pairs = dedupe.near_pairs(spark.createDataFrame([(h,) for h in [*hashes, *hashes, None]], "h long"))
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    want = sorted((a, b, (a ^ b).bit_count()) for a, b in itertools.combinations(hashes, 2) if (a ^ b).bit_count() <= 2)
    assert want and sorted(map(tuple, pairs.collect())) == want
    comp = {r.node: r.component for r in graph.components(pairs.select("a", "b")).collect()}
    assert all(comp[a] == comp[b] for a, b, _ in want) and len(plans) > 4
    assert not [p for p in plans if "Broadcast" in p]


def test_shingles_of_odd_texts_as_sql_has_them(spark, tmp_path):
    texts = [None, None, "abcd", None, "", "", "a", "ab", "a😀bc", "a😀bd", "abc", "ab", "ab", "\u0301e\u0301e"]
    rows = [(i + 60, t) for i, t in enumerate(texts)] + [(61, "abc"), (64, "abcab"), (None, "abc"), (-64, "abc"), (-65, "abcd"), (-63, "cba"), (200, "abc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(map(str, c.execute(catalog.oracle_sql()["jaccard_shingles"]).fetchall()))
    assert len(want) > 15 and sorted(str(tuple(r)) for r in dedupe.jaccard_shingles(spark, str(tmp_path)).collect()) == want


def test_large_groups_of_parts_lie_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedupe, "BLOCK", 8)
    monkeypatch.setattr(dedupe, "TASK_PAIRS", 100)
    rng = random.Random(6)
    rows = [(i // 2 if i < 6 else i, None if i == 9 else "".join(rng.choices("ab é", k=rng.randrange(6))), None if i == 50 else "x", "t" if i < 60 else f"t{i // 3}", 1) for i in range(80)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = dedupe.levenshtein_samples(spark, str(tmp_path))
    want = sorted(str((a[0], b[0], None if None in (a[1], b[1]) else distance(a[1], b[1]))) for a in rows for b in rows if a[0] < b[0] and a[2:] == b[2:] and a[2])
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    assert len([p for p in found.rdd.glom().map(len).collect() if p]) > 8
