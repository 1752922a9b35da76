"""Registered queries with the SQL that must return the same rows; SQL None: rows only."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["raster_queries", "lookup_queries", "report_queries", "tiff_queries", "stream_queries", "markup_queries", "pipeline_queries", "record_queries", "file_queries", "inventory_queries", "cog_queries"]


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"tessera.plans.{name}").QUERIES
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
