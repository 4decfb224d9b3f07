"""Every query of the analytics library, by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnfield.plans import catalogue_queries, file_queries, geometry_queries, metric_queries, priority_queries, report_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (catalogue_queries, metric_queries, priority_queries, report_queries, file_queries, geometry_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLES.items()}
