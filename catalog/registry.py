"""Where each registered query sits beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its own name; ``sql`` is its DuckDB counterpart."""

    def keep(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits, so that summation order cannot show; no minus zero."""
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles})
