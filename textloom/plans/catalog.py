"""Every registered query, with the SQL that must give the same rows."""

from __future__ import annotations

from textloom.plans import adapter_queries, corpus_queries, metric_queries, vector_queries, vocab_queries  # noqa: F401
from textloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
