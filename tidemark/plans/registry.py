"""Named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison; + 0.0 turns a negative zero into zero.

    ``exact`` columns come from single IEEE operations that every engine computes alike.
    """
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType == T.DoubleType() and f.name not in exact else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"
