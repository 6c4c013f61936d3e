"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order."""
    return df.select(*[(fixed(F.col(c), places).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


def r4(c: Column | str) -> Column:
    return fixed(c, 4)


for _name in ("series", "profile", "clean", "segments", "plans", "correlate", "registry", "kernels", "extract", "inspect", "io", "graph"):
    import_module(f"{__name__}.{_name}")
