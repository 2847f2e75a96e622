"""Registry and output helpers."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # stored instants are UTC
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rnd(c, digits: int):
    """Half-up rounding by the formula the oracle uses too."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def tidy(df: DataFrame, digits: int = 4, minutes: bool = False) -> DataFrame:
    """Plain output: rounded doubles, text times, text lists, wide integers."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = rnd(c.cast("double"), digits)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm" if minutes else "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)
