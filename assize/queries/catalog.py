"""Queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assize.queries import decisions, general


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return decisions.QUERIES | {f.__name__: f for f in general.QUERIES}


def oracle_sql() -> dict[str, str]:
    return decisions.SQL | general.SQL
