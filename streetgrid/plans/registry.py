"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def settled(df: DataFrame) -> DataFrame:
    """Whole numbers as long, others rounded to 6 digits, so that engines that sum in another order agree."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, columns: str = "", sql: str = "") -> Callable:
    """Register a query. ``columns``: names of the SQL's columns, ``:i`` whole numbers, ``:f`` others, else as they are."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: settled(f(spark, sf_dir))
        if sql:
            parts = []
            for c in columns.split():
                c, _, kind = c.partition(":")
                parts.append({"i": f"CAST({c} AS BIGINT) AS {c}", "f": f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}", "": c}[kind])
            ORACLE_SQL[name] = f"SELECT {', '.join(parts)} FROM ({with_views(sql)})"
        return f

    return register


def hav(a: str, b: str, lat: str = "lat", lon: str = "lon") -> str:
    """SQL of the great-circle distance of two aliases."""
    p = lambda x: f"radians({x})"
    h = f"(power(sin(({p(f'{b}.{lat}')} - {p(f'{a}.lat')}) / 2), 2) + cos({p(f'{a}.lat')}) * cos({p(f'{b}.{lat}')}) * power(sin(({p(f'{b}.{lon}')} - {p(f'{a}.lon')}) / 2), 2))"
    return f"(2 * 6371008.8e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def xy(a: str, b: str, lat: str = "lat", lon: str = "lon") -> tuple[str, str]:
    """SQL of the flat metres of b around a."""
    return f"(({b}.{lon} - {a}.lon) * 111320e0 * cos(radians({a}.lat)))", f"(({b}.{lat} - {a}.lat) * 110540e0)"
