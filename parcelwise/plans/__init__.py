"""The registered queries: each name has its Spark job and, where possible, the same result in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("survey", "ingest", "dedupe", "compare", "areas", "series", "snapshot", "text", "spatial", "sources")

Query = Callable[[SparkSession, str], DataFrame]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"parcelwise.plans.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
