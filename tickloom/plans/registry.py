"""Collects the queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


# Moves halves at the last digit off the tie, where the two engines round differently.
OFF_TIE = 3e-8


def steady(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that both engines agree on the last bits; dates as text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name) + F.lit(OFF_TIE), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, digits: int = 6, r: str = "", day: str = ""):
    """Register a query. ``r`` and ``day`` name the SQL columns to round or show as text."""

    def register(fn):
        def run(spark, sf_dir):
            return steady(fn(spark, sf_dir), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            fixes = [f"round({c} + 3e-8::DOUBLE, {digits}) + 0.0 AS {c}" for c in r.split()]
            fixes += [f"CAST({c} AS VARCHAR) AS {c}" for c in day.split()]
            SQL[name] = f"SELECT * REPLACE ({', '.join(fixes)}) FROM ({sql})" if fixes else sql
        return run

    return register
