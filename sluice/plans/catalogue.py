"""All queries by name, with the equal SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.plans import generated, latency, relational, scalar, tools

Query = Callable[[SparkSession, str], DataFrame]
ALL = latency.QUERIES | relational.QUERIES | scalar.QUERIES | generated.QUERIES | tools.QUERIES


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
