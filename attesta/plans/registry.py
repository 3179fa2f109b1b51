"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that DuckDB holds it against."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """SQL over one table, which it names as such; the session's own views stay as they are."""
    return spark.sql(sql.replace("{s}", "STRING").replace(f"FROM {name}", "FROM {given}"), given=table(spark, sf_dir, name))


def pick(values: list[str], by: str) -> Column:
    """One of the values, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(by) % len(values) + 1).cast("int"))
