"""Registry of named queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.session import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under `name`, with the SQL it must agree with."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rnd(column: Column | str, digits: int = 4) -> Column:
    """Rounded double without negative zero, so that both engines print the same value."""
    column = F.col(column) if isinstance(column, str) else column
    return rounded(column, digits) + F.lit(0.0)


def sql_rnd(expression: str, digits: int = 4) -> str:
    return f"(round_even(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def day(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def sql_day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def moment(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_moment(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"
