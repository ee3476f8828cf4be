"""Collects the queries of the core and, where it is installed, of the llm subpackage."""

from __future__ import annotations

import importlib

CORE = ("ledgerloom.plans.delivery", "ledgerloom.plans.reference")


def collect() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    queries: dict = {}
    sql: dict = {}
    for name in CORE:
        module = importlib.import_module(name)
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
