"""The catalogue: queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one scale as attributes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, root: f(Tables(spark, root))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the modules that fill the catalogue."""
    from . import graphs, models, relations, scans, spaces, workflows  # noqa: F401
