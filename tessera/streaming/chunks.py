"""Resumable work as bounded streams: files that arrived are processed once, in checkpointed batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resume(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 8, fmt: str = "json") -> None:
    """SNK7, D12, D16: ``work`` over all new files of a folder, then stop. A batch writes to its own folder, so
    one that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def epoch_states(spark: SparkSession, source: str, checkpoint: str, out: str) -> None:
    """CUR7 as a stream: loss records (epoch, id, nll, duration) become one table of orders an epoch.

    The records of an epoch come in one file; its order depends on that epoch only.
    """
    from tessera.operators.ranking import loss_order

    def order(batch: DataFrame) -> DataFrame:
        return loss_order(batch.withColumn("dataset_index", F.col("dataset_index")))

    resume(spark, source, "epoch int, id string, nll double, duration double, dataset_index int", order, out, checkpoint, files_per_batch=1)
