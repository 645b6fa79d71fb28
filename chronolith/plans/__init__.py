"""Queries over the test tables, one or more for each group of operators, with their SQL."""

from __future__ import annotations


def _loaded():
    from . import interval_queries, record_queries, registry, set_queries, signal_queries, state_queries  # noqa: F401

    return registry


def queries() -> dict:
    return dict(_loaded().QUERIES)


def oracle_sql() -> dict:
    return dict(_loaded().ORACLES)
