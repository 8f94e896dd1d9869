"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; ``sql`` gives the same rows in DuckDB."""
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(value: str, digits: int = 2) -> str:
    """SQL for rounding half away from zero on 15 significant digits."""
    step = f"{10 ** digits}.0"
    size = f"abs(({value}) * {step})"
    return f"(floor({size} + least({size} * 1e-15, 1e-3) + 0.5) * sign({value}) / {step})"


def money(value: str) -> str:
    """SQL for an order-independent sum of amounts."""
    return f"cast(sum(cast({value} as decimal(18,4))) as double)"
