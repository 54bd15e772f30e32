"""Queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace, table

SQL: dict[str, str] = {}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.toxicity import ToxicityClassifier, training_rows

    docs = table(spark, sf_dir, "documents")
    found = ToxicityClassifier().fit(docs, training_rows(table(spark, sf_dir, "labels"))).score(docs, ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), Workspace(spark, "embeddings")).withColumnRenamed("id", "vec_id")


SQL["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT *, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.node = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"), Workspace(spark, "pages")).withColumnRenamed("id", "page_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "decontaminate"))
    return found.drop("row")


SQL["op4_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(q, ' ') AS q, len(q) AS n FROM (
  SELECT item_id, unnest(CASE WHEN len(w) < 13 THEN [w] ELSE [w[i:i + 12] FOR i IN range(1, len(w) - 11)] END) AS q FROM b WHERE len(w) > 0)),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
hits AS (SELECT doc_id, s, p.n, item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS q FROM starts) x JOIN p ON p.q = x.q AND p.n = x.n),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), Workspace(spark, "packing"), tokenizer_path())


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.sharding import shard

    found = shard(table(spark, sf_dir, "documents"), Workspace(spark, "shards"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.license_scan import known_licenses, scan

    return scan(table(spark, sf_dir, "documents"), known_licenses(spark)).withColumnRenamed("id", "doc_id")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.jaccard_join import jaccard_components

    found = jaccard_components(table(spark, sf_dir, "documents"), Workspace(spark, "jaccard"), n=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
copies AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM copies),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, seen) AS (SELECT rep, rep FROM copies UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN copies c ON list_sort(s.s) = c.s AND len(s.s) > 0 LEFT JOIN comp k ON k.node = c.rep
"""


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.pii import key_of, replace_entities

    found = replace_entities(table(spark, sf_dir, "documents"), Workspace(spark, "pii"), ["doc_id"], secret=key_of(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("entities.kind"))), ",")
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from siltstone.llm.license_scan import scan_sql

    return SQL | {"op8_license_scan": scan_sql()}
