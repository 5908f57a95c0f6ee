"""Registry of queries: a Spark callable and, where SQL can say the same, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def stamp(time: Column | str) -> Column:
    """Time as text with microseconds, the same on both sides whatever the driver's time types."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(time: str) -> str:
    return f"strftime({time}, '%Y-%m-%d %H:%M:%S.%f')"


def bars(array: Column | str) -> Column:
    return F.array_join(array, "|")


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")
