"""How queries read tables, and the registry that holds each query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DAY0 = "1992-01-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that checks it where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> F.Column:
    """Days since DAY0."""
    return F.datediff(F.to_date(column), F.lit(DAY0).cast("date"))


def sql_day(column: str) -> str:
    return f"date_diff('day', DATE '{DAY0}', CAST({column} AS DATE))"
