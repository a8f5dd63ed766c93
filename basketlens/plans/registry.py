"""Named queries: a Spark plan over the retail tables, and SQL to compare it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import RetailTables
from .oracle import with_tables

Plan = Callable[[RetailTables], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def _runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(RetailTables(spark, sf_dir))


def load() -> None:
    """Import the modules that register queries."""
    from . import (  # noqa: F401
        brand_queries,
        catalog_queries,
        ingest_queries,
        matching_queries,
        streaming_queries,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: _runner(plan) for name, plan in PLANS.items()}


def all_sql() -> dict[str, str]:
    load()
    return {name: with_tables(sql) for name, sql in SQL.items()}
