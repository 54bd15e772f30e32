"""Odd inputs to every operator and stage, and packing and whole runs against plain Python."""

import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import embedding_dedup, packing, queries
from siltstone.llm.common import Workspace
from siltstone.llm.decontaminate import decontaminate
from siltstone.llm.html_extract import extract_pages
from siltstone.llm.jaccard_join import jaccard_components
from siltstone.llm.license_scan import known_licenses, scan
from siltstone.llm.pii import replace_entities
from siltstone.llm.sharding import shard
from siltstone.llm.token_counts import token_counts
from siltstone.llm.toxicity import ToxicityClassifier

LONG = "long text " * 30_000 + "a@b.com"
TEXTS = [None, "", " \n", "one", "one", "the same text of six words", "the same text of six words", LONG, "毒" * 5000, "Mr Smith"]
#: Columns whose names the operators use themselves.
EXTRA = "id long, h long, row long, score double, n long, key string, entities string, slot int, host string"


@pytest.fixture
def work(spark):
    return Workspace(spark, "edges")


@pytest.fixture
def docs(spark):
    rows = [(None if i == 2 else i // 2 * 2, t, 1, 2, 3, 0.5, 4, "k", "e", 5, "h") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


def operators(spark, work):
    public = pytest.importorskip("public_tokenizers")
    items = spark.createDataFrame([("x", "one"), (None, "same text"), ("y", None)], "item_id string, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    return {
        "toxicity": lambda d: ToxicityClassifier().fit(d, labels).score(d, ["doc_id"]),
        "jaccard": lambda d: jaccard_components(d, work),
        "decontaminate": lambda d: decontaminate(d, items, work),
        "packing": lambda d: packing.pack(d, work, public.path("word_bpe_49k.json")),
        "sharding": lambda d: shard(d, work),
        "tokens": lambda d: token_counts(d, public.path("piece_bpe_32k.model")),
        "licenses": lambda d: scan(d, known_licenses(spark)),
        "pii": lambda d: replace_entities(d, work, ["doc_id"], secret="s"),
        "html": lambda d: extract_pages(d.withColumn("url", F.lit("http://h/")), work, id_col="doc_id", html_col="text"),
    }


@pytest.mark.parametrize("name", ["toxicity", "jaccard", "decontaminate", "packing", "sharding", "tokens", "licenses", "pii", "html"])
def test_odd_rows(spark, work, docs, name):
    run = operators(spark, work)[name]
    got = run(docs).collect()
    pieces = sum(r["piece"] > 0 for r in got) if name == "packing" else 0
    assert len(got) - pieces == len(TEXTS)
    assert run(docs.where("false")).count() == 0
    if name == "toxicity":
        assert all(0 <= r.score <= 1 for r in got)
    if name == "decontaminate":
        by = sorted((r.n_words, r.n_hit, r.n_items) for r in got)
        assert by[:3] == [(0, 0, 0)] * 3 and (1, 1, 1) in by and (6, 2, 0) in by
    if name == "pii":
        texts = {r.text for r in got}
        assert LONG not in texts and "Mr Smith" not in texts and None in texts and "one" in texts


def test_odd_vectors(spark, work):
    schema = "vec_id long, embedding array<float>, label string, h long, keys string"
    rows = [(1, [1.0, 0.0], "a", 1, ""), (2, [1.0, 0.001], "a", 1, ""), (2, [1.0, 0.001], "a", 1, ""), (3, [1.0, 0.0], "b", 1, ""), (None, [1.0, 0.0], "a", 1, ""), (5, [], "a", 1, ""), (6, [float("nan"), 1.0], "a", 1, ""), (7, [1.0, 0.0, 0.0], "a", 1, "")]
    rows += [(10 + i, [math.cos(i / 7), math.sin(i / 7)] * 400, "long", 1, "") for i in range(5)]
    df = spark.createDataFrame(rows, schema)
    got = embedding_dedup.near_duplicates(df, work)
    by = defaultdict(list)
    for r in got.collect():
        by[r.id].append((r.n_links, r.component_id))
    assert by[1] == [(3, 1)] and by[2] == [(3, 1)] * 2 and by[None] == [(3, 1)]
    assert all(by[i] == [(0, i)] for i in (3, 5, 6, 7))
    assert [by[10 + i] for i in range(5)] == [[(1, 10)], [(2, 10)], [(2, 10)], [(2, 10)], [(1, 10)]]
    assert embedding_dedup.near_duplicates(df.where("false"), work).count() == 0


def test_recall_of_near_duplicates(spark, work):
    """5,000 vectors, some in a large family, against all pairs."""
    rng = embedding_dedup.np.random.default_rng(4)
    x = rng.normal(size=(5000, 32))
    x[:1500] = x[0] + rng.normal(size=(1500, 32)) * 0.1
    x[1500:3000] = x[rng.integers(3000, 5000, 1500)] + rng.normal(size=(1500, 32)) * 0.13
    x = x.astype("float32")
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df, work).collect()}
    u = x.astype(float)
    u /= embedding_dedup.np.sqrt((u * u).sum(axis=1, keepdims=True))
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(5000)) and sum(got.values()) >= 0.99 * want.sum()


def test_packing_against_plain_python(spark, work):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = [*TEXTS[:7], "Ünïcode, words. And more! " * 3, "x " * 9000] + [" ".join(rng.choice(["the", "cat's", "Sat.", "12", "ø"]) for _ in range(rng.randrange(900))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = packing.pack(df, work, public.path("word_bpe_49k.json"), most=512).collect()
    found = {(r.doc_id, r.piece): r for r in got}
    n = 0
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 512)):
            r, own = found[i, p], ids[s : s + 512]
            n += 1
            assert (r.start, r.length, r.ids_crc32) == (s, len(own), zlib.crc32(packing.np.array(own, "<u4").tobytes()))
    assert n == len(got)
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(rows) <= sum(r.length for r in got) / 512 * 1.05 + 2


def test_pipeline_stages(spark, tmp_path, docs):
    spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of it"), (None, "same text of six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (docs, docs.where("false")):
        now = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        texts = [r.text for r in now.collect()]
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert sum(r.piece == 0 for r in out) == len(texts)
        if df is docs:
            assert texts.count("one") == 1 and "the same text of six words" not in texts and "Mr Smith" not in texts and len(texts) == 7


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    expected = sorted(str([r[i] for i in order]) for r in want.fetchall())
    assert sorted(str(list(r)) for r in queries.queries()[name](spark, sf).select(*names).collect()) == expected
