"""Text sources and sinks: rank lists, DNS logs, N-Triples, XML records, TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rank_list(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path)
    return t.select(F.regexp_extract("value", r"^([0-9]*)\s*(.*)$", 1).cast("long").alias("rank"), F.regexp_extract("value", r"^([0-9]*)\s*(.*)$", 2).alias("name"))


def read_dns_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_extract("value", "^([^,]*),(.*)$", 1).alias("host"), F.regexp_extract("value", "^([^,]*),(.*)$", 2).alias("result"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The last <...> of each line is the URL; lines without one are dropped."""
    url = F.regexp_extract("value", r"<([^<>]*)>[^>]*$", 1)
    return spark.read.text(path).select(url.alias("url")).where("url <> ''")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def wiki_flags(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds is_redirect, is_disambiguation, is_stub, is_article and link targets."""
    t = F.col(text)
    redirect, several, stub = t.rlike(r"(?i)^\s*#redirect"), t.rlike(r"(?i)\{\{\s*disambig"), t.rlike(r"(?i)\{\{[^}]*stub\s*\}\}")
    links = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x)))
    return pages.withColumns({"is_redirect": redirect, "is_disambiguation": several, "is_stub": stub, "is_article": ~redirect & ~several, "link_targets": links})


def write_tsv(df: DataFrame, path: str, order: list[str]) -> None:
    """One sorted TSV; only for results that are meant to be read by people."""
    df.orderBy(*order).coalesce(1).write.option("sep", "\t").csv(path)
