"""All registered queries of the reference's operators."""

from __future__ import annotations

import importlib

from siltstone.plans.registry import ORACLE, QUERIES

MODULES = [f"operators.{m}" for m in ("stats", "joins", "filters", "windows", "crawldb", "lists", "graph", "dedupe", "lookups", "content", "store")] + ["streaming.stats"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"siltstone.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
