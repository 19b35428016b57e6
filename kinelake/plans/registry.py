"""All queries of the library but those of the training-data subpackage."""

from __future__ import annotations

from . import evaluation_queries, event_queries, export_queries, log_queries, table_queries

_MODULES = (event_queries, table_queries, evaluation_queries, log_queries, export_queries)


def queries() -> dict:
    return {name: f for module in _MODULES for name, (f, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
