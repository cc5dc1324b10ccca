"""Registration helpers.

A query states its output once as ``{column: kind}``. Both the Spark result and the SQL are projected to it, so names, types
and rounding agree. Kinds: i whole number, n whole number that may be missing (as double), f double (4 digits), f2/f6 other
digits, s text, d date, t timestamp to the second, b yes/no as 0/1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}
# Rounds half up; the surplus keeps exact ties off the boundary, where the order of a sum could decide.
_HALF = 0.50001


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        return c.cast("long").alias(name)
    if kind == "n":
        return c.cast("double").alias(name)
    if kind[0] == "f":
        scale = 10.0 ** int(kind[1:] or 4)
        return (F.floor(c.cast("double") * scale + _HALF) / scale + F.lit(0.0)).alias(name)
    if kind == "b":
        return c.cast("int").cast("long").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    return c.cast("string").alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "n":
        return f"CAST({name} AS DOUBLE) AS {name}"
    if kind[0] == "f":
        scale = f"{10 ** int(kind[1:] or 4)}::DOUBLE"
        return f"FLOOR(CAST({name} AS DOUBLE) * {scale} + {_HALF}) / {scale} + 0.0 AS {name}"
    if kind == "b":
        return f"CAST(CAST({name} AS INTEGER) AS BIGINT) AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    return f"CAST({name} AS VARCHAR) AS {name}"


def with_ctes(body: str) -> str:
    """Prefix the body with the shared tables it mentions, and those they mention."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in wanted:
                    wanted.append(name)

    visit(body)
    if not wanted:
        return body
    prefix = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in wanted)
    return f"WITH {prefix}\n{body}"


def query(name: str, columns: dict[str, str], sql: str | None = None):
    """Register ``f(spark, sf)``; without SQL the driver checks rows only."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(spark, sf).select(*[_spark_column(c, k) for c, k in columns.items()])

        run.__name__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            outer = ", ".join(_sql_column(c, k) for c, k in columns.items())
            ORACLE[name] = with_ctes(f"SELECT {outer}\nFROM (\n{sql.strip()}\n) AS q")
        return f

    return register
