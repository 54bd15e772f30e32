"""Benchmark decontamination with a distributed positional inverted index.

Test terms are counted over the whole training corpus, and every test phrase is
entered under its rarest terms. Postings of those terms are stored with their
neighbourhood, document by document, so offset-adjusted lists intersect without
moving any posting: a posting of the rarest term fixes where the phrase would
start, the next rarest terms must stand at their offsets from there, and what is
left is compared word by word. DataFrame and SQL expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace, ascii_lower

#: Word characters are all but these.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of test terms or phrases is broadcast up to so many rows, else joined by a shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def phrases(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, phrase), item_id as text or null: every n consecutive words, or all words of a shorter item."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    return w.withColumn("s", start).select("item_id", F.expr(f"slice(w, s, {n})").alias("phrase")).distinct()


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class PositionalIndex:
    """Postings of a training corpus (doc_id, text) for the terms of given phrases.

    A null text has no words; a null doc_id is kept. Each row is a document of its
    own, told by the hash of its id and words, so repeated rows count alike.
    """

    def __init__(self, docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text"):
        self.work = work
        self.tokens = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))

    def counts(self, terms: DataFrame) -> DataFrame:
        """(term, n): how often each of ``terms`` stands in the corpus."""
        found = self.tokens.select(F.explode("w").alias("term")).join(_sized(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
        return self.work.keep(terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "counts")

    def plan(self, wanted: DataFrame, probes: int = 3) -> DataFrame:
        """(phrase, term, at, more): the rarest term and where it stands, and the next rarest ones."""
        terms = wanted.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("at", "term"))
        counted = terms.join(self.counts(self.work.keep(terms.select("term").distinct(), "terms")), "term")
        rank = F.row_number().over(Window.partitionBy("phrase").orderBy("n", "at"))
        rarest = counted.withColumn("r", rank).where(F.col("r") <= probes).groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("r", "at", "term", "n"))).alias("p"))
        # a term that stands nowhere rules its phrase out
        return self.work.keep(rarest.where("p[0].n > 0").select("phrase", F.col("p")[0]["term"].alias("term"), F.col("p")[0]["at"].alias("at"), F.expr("slice(p, 2, size(p))").alias("more")), "plan")

    def postings(self, plan: DataFrame, reach: int) -> DataFrame:
        """Stored postings (doc_id, term, pos, around, from) of the plan's terms.

        ``around`` holds the words up to ``reach`` before and after, ``from`` the
        position of its first one. Positions count from 0.
        """
        own = self.work.keep(plan.select("term").distinct(), "indexed")
        texts = self.tokens.select("doc_id", F.xxhash64("doc_id", "w").alias("row"), F.size("w").alias("n_words"), "w")
        first = F.greatest(F.col("pos") - reach, F.lit(0))
        around = F.expr(f"slice(w, greatest(pos - {reach}, 0) + 1, {2 * reach + 1})")
        listed = texts.select("*", F.posexplode("w").alias("pos", "term"))
        if own.count() <= BROADCAST_ROWS:
            listed = listed.join(F.broadcast(own), "term")
        else:  # words are cut out before the shuffle, so that no text travels with each of its words
            listed = listed.select("doc_id", "row", "n_words", "term", "pos", around.alias("around")).join(own, "term")
            return self.work.keep(listed.select("*", first.alias("from")), "postings")
        return self.work.keep(listed.select("doc_id", "row", "n_words", "term", "pos", around.alias("around"), first.alias("from")), "postings")

    def exact(self, wanted: DataFrame, reach: int) -> DataFrame:
        """(doc_id, row, n_words, start, phrase): every occurrence of every phrase of at most ``reach`` + 1 words."""
        plan = self.plan(wanted)
        met = self.postings(plan, reach).join(_sized(plan), "term").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0")
        # offset-adjusted intersection with the next rarest terms, then all words
        met = met.where(F.expr("forall(more, m -> get(around, cast(start - from + m.at as int)) <=> m.term)"))
        return met.where(F.expr("slice(around, start - from + 1, size(phrase)) = phrase")).select("doc_id", "row", "n_words", "start", "phrase")

    def near(self, wanted: DataFrame, span: int) -> DataFrame:
        """(doc_id, row, pos, phrase): where all words of a phrase stand, in any order, within ``span`` words of its rarest one."""
        plan = self.plan(wanted)
        met = self.postings(plan, span).join(_sized(plan), "term")
        return met.where(F.expr("size(array_except(phrase, around)) = 0")).select("doc_id", "row", "pos", "phrase")


def decontaminate(docs: DataFrame, items: DataFrame, work: Workspace, n: int = 13, percent: int = 5) -> DataFrame:
    """One row per document: doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if ``percent`` of its words or more lie in a phrase
    of an item. Documents and items may be null, empty, repeated or absent; copies
    of a row have equal results. An item without an id is searched for, but has no
    name to count or list. Other columns aren't read.
    """
    wanted = work.keep(phrases(items, n), "phrases")
    index = PositionalIndex(docs, work)
    hits = index.exact(wanted.select("phrase").distinct(), n - 1)
    hits = work.keep(hits.distinct(), "hits")
    covered = hits.select("row", F.explode(F.expr("sequence(start, start + size(phrase) - 1)")).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    found = hits.select("row", "phrase").distinct().join(_sized(wanted), "phrase").select("row", "item_id").distinct()
    # a document's list is bounded by the number of items
    named = found.groupBy("row").agg(F.count("item_id").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item_id"))).alias("items"))
    stats = work.keep(covered.join(named, "row"), "stats")
    every = index.tokens.select("doc_id", F.size("w").cast("long").alias("n_words"), F.xxhash64("doc_id", "w").alias("row"))
    out = every.join(stats, "row", "left").withColumn("hit", F.coalesce("n_hit", F.lit(0)))
    return out.select("doc_id", "row", "n_words", F.col("hit").alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((F.col("hit") > 0) & (F.col("hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"))
