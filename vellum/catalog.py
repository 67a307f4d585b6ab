"""Queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import exchange, records
from vellum.plans import queries as plans

QueryFn = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The page inventory: addresses, first fetches, hosts and languages."""
    return plans.q_page_inventory(spark, folder)


def queries() -> dict[str, QueryFn]:
    return plans.all_queries() | records.all_queries() | exchange.all_queries()


def oracle_sql() -> dict[str, str]:
    return plans.SQL | records.SQL | exchange.SQL
