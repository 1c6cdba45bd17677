"""Registration of queries and readers for the test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder); ``sql`` gives the same rows in DuckDB."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def per_column(columns: Sequence[str], template: str) -> str:
    """One SELECT per column, stacked; ``{c}`` stands for the column."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)


LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax",
]
