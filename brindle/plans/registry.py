"""All registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from brindle.plans import model_queries, problems, rater_queries, reception_queries

FLAGSHIP = "p1_found"
_MODULES = (problems, reception_queries, rater_queries, model_queries)


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
