"""Registration of queries: a name, the operators it covers, the factory and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(ids: str, sql: str | None = None):
    """Register a factory under its own name. ``ids``: the operators of the inventory it applies."""

    def add(f):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = ids.split()
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
