"""All queries outside the subpackage llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriloom.plans import claims, general, more  # noqa: F401


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query."""
    return claims.flagship(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return general.QUERIES | claims.QUERIES


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return general.SQL | claims.SQL
