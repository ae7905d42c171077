"""Queries over the tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import retrieval, structure

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return retrieval.QUERIES | structure.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | structure.SQL
