"""Registered queries: a Spark plan and, where SQL can say the same, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, oracle: str | None = None, digits: int = 6):
    """Register a query under ``name``; ``ids`` are the operators it shows."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(tune(spark), sf_dir), digits)

        QUERIES[name] = run
        IDS[name] = ids
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output form shared with the SQL side: rounded doubles, zone-free times, dates as text."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)
