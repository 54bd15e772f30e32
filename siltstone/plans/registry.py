"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from siltstone.plans.adapters import VIEWS, cte

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; ``sql`` may name adapters like tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            used = [cte(v) for v in VIEWS if re.search(rf"\b{v}\b", sql)]
            body = sql.strip()
            recursive = body.upper().startswith("WITH RECURSIVE")
            if body.upper().startswith("WITH"):
                body = re.sub(r"(?i)^with(\s+recursive)?\s+", "", body)
                own = ", ".join(used) + (", " if used else "") + body
                ORACLE[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{own}"
            else:
                ORACLE[f.__name__] = f"WITH {', '.join(used)} {body}" if used else body
        return f

    return add
