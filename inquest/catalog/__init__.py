"""Registered queries over the shared tables, with the SQL that must give the same rows."""

from __future__ import annotations

from inquest.catalog import cases, contract, extraction, graph, records, store, temporal  # noqa: F401  they register their queries
from inquest.catalog.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
