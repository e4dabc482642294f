"""Session factory."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC, adaptive execution, and shuffle partitions by the cores at hand when local."""
    builder = SparkSession.builder.appName(app)
    cores = os.cpu_count() or 8
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
