"""The registered queries of the core, with their SQL twins."""

from __future__ import annotations

from lectern.plans import index_queries, library_queries, record_queries, search_queries, text_queries  # noqa: F401  (they register)
from lectern.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
