"""Registration of queries: a function of (spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL twin if it has one."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A statement over some of the parquet tables."""
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in tables})
