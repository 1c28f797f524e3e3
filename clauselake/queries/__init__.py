"""Registered queries: every operator over the given tables, with the same result as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PARTS = ("corpus", "detection", "urls", "links", "features", "versions", "risk", "operations",
         "files")

Query = Callable[[SparkSession, str], DataFrame]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries by name, and the SQL of those that have one."""
    import importlib

    for part in PARTS:
        importlib.import_module(f"clauselake.queries.{part}")
    from clauselake.queries.base import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
