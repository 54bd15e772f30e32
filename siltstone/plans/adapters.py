"""Crawl-shaped inputs derived from the driver's tables.

Each adapter is a list of SQL expressions that Spark and DuckDB read alike, so
queries and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROOT = r"regexp_extract({}, '([^.]+\.[^.]+)$', 1)"

#: name -> (table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "fetches": ("events", {
        "fetch_id": "event_id",
        "host": "concat(case when user_id % 3 = 0 then 'www.' else '' end, 'h', cast(user_id as string), '.site', cast(user_id % 12 as string), '.com')",
        "root": "concat('site', cast(user_id % 12 as string), '.com')",
        "url": "concat('http://', case when user_id % 3 = 0 then 'www.' else '' end, 'h', cast(user_id as string), '.site', cast(user_id % 12 as string), '.com/p', cast(event_id % 60 as string))",
        "attempt_time": "ts",
        "http_result": "case event_type when 'error' then 404 when 'signup' then 301 else 200 end",
        "server_ip": "concat('10.0.', cast(user_id % 7 as string), '.', cast(event_id % 11 as string))",
        "content_len": "cast(floor(value * 10) as bigint)",
        "kind": "event_type",
    }),
    "links": ("lineitem", {
        "source": "concat('s', cast(l_suppkey as string), '.dom', cast(l_suppkey % 7 as string), '.com')",
        "source_root": "concat('dom', cast(l_suppkey % 7 as string), '.com')",
        "target": "concat('p', cast(l_partkey as string), '.dom', cast(l_partkey % 40 as string), '.com')",
        "target_root": "concat('dom', cast(l_partkey % 40 as string), '.com')",
        "linked_at": "l_shipdate",
        "rel": "concat('html:a', case when l_linenumber % 3 = 0 then ':nofollow' else '' end)",
    }),
    "hosts": ("pages", {
        "page_id": "page_id",
        "url": "url",
        "html": "html",
        "host": "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)",
        "domain": "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www[.]', '')",
        "root": r"regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '([^.]+[.][^.]+)$', 1)",
    }),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(name: str) -> str:
    """The adapter as a common table expression of DuckDB."""
    table, columns = VIEWS[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table})"
