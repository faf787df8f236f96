"""All queries outside the training-data subpackage."""

from __future__ import annotations

from . import audit_queries, lookup_queries, metric_queries, screen_queries, value_queries
from .metric_queries import entry  # noqa: F401

_PARTS = (metric_queries.query, audit_queries.query, screen_queries.query, lookup_queries.query, value_queries.query)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
