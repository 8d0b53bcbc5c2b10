"""Registry of named queries (Spark callables) and their oracle SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Results are compared across engines after rounding both sides to this many decimals.
DECIMALS = 6


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` is its DuckDB-runnable twin
    whose final SELECT rounds DOUBLE columns with ``rd``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        QUERIES[name] = wrapped
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def present(df: DataFrame) -> DataFrame:
    """Presentation layer: doubles rounded to ``DECIMALS`` (operators return raw doubles)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), DECIMALS).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rd(expr: str, alias: str | None = None) -> str:
    """SQL side of ``present``: ``round(CAST(expr AS DOUBLE), DECIMALS) AS alias``."""
    out = f"round(CAST({expr} AS DOUBLE), {DECIMALS})"
    return f"{out} AS {alias or expr}"
