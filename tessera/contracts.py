"""Contracts: each returns a lazy DataFrame of violations, empty when the contract holds.

``enforce`` turns violations into an error at execution time without an extra job: the checked data is
joined to a one-row count that raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """Null, or blank after trimming."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_missing(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which a column is null or blank."""
    return df.where(reduce(Column.__or__, [missing(F.col(c)) for c in cols]))


def in_range(df: DataFrame, col: str, low=None, high=None, open_ends: bool = False) -> DataFrame:
    """Rows out of the range, null and NaN included."""
    c = F.col(col)
    bad = c.isNull() | F.isnan(c.cast("double"))
    if low is not None:
        bad = bad | (c <= low if open_ends else c < low)
    if high is not None:
        bad = bad | (c >= high if open_ends else c > high)
    return df.where(bad)


def allowed(df: DataFrame, col: str, values) -> DataFrame:
    return df.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def equal_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).union(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def covered(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys of the left side that the right side lacks; extras on the right are fine."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def disjoint(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that lie in more than one group."""
    return df.select(key, group).distinct().groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("groups")).where(F.size("groups") > 1)


def agree(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys on both sides whose columns differ (null equals null)."""
    r = right.select(*keys, *(F.col(c).alias(f"_{c}") for c in cols))
    differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
    return left.select(*keys, *cols).join(r, keys).where(differs)


def enforce(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df``, failing when executed if there are violations."""
    n = violations.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > 0, F.raise_error(F.concat(F.lit(f"{message}: "), F.col("_n")))).otherwise(F.lit(True)).alias("_ok"))
    return df.join(F.broadcast(n), F.col("_ok"), "left_semi")
