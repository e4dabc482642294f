"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words as every contract here counts them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows handed to Python at a time; texts may be long, and two workers share an executor's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is made only where the session names none and runs in one process
    (tests). On a cluster the setting is required: other machines do not see a folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs a reread."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more: what was made from them is materialized itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_key(docs: DataFrame) -> Column:
    """128 bits of a row's whole content, in hexadecimal; rows equal in all columns share them."""
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    return F.md5(F.concat(F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")), rest).cast("binary"))


def in_order(docs: DataFrame, *columns: str) -> DataFrame:
    """These columns of ``docs`` and position: from 0, by file and row in it, or by partition if it is no table of Parquet
    files. Files are counted, so no row is sorted."""
    try:
        d = docs.select(*columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        d = docs.select(*columns, F.monotonically_increasing_id().alias("__row"))
        d = d.withColumn("__file", F.lpad(F.shiftright("__row", 33).cast("string"), 10, "0")).withColumn("__row", F.col("__row").bitwiseAND((1 << 33) - 1))
        d = materialize(d, "in-order")
    counts = d.groupBy("__file").agg(F.count("*").alias("__n"))
    before = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return d.join(counts, "__file").select(*columns, (F.col("__before") + F.col("__row")).alias("position"))


def least_hashed(df: DataFrame, h: Column, rows: int) -> DataFrame:
    """The ``rows`` rows of least hash, ties whole. Only hashes under a rising threshold are ever sorted, so what each task
    offers does not grow with the number of tasks; the threshold does not change the result."""
    top = 1 << 62
    at = F.pmod(h, F.lit(top)).alias("_at")
    total, part = df.count(), 1.0
    if total > 8 * rows:
        part = 4 * rows / total
    while True:
        edge = int(top * min(part, 1.0))
        found = df.select(at).where(F.col("_at") < edge).groupBy("_at").count().orderBy("_at").limit(rows).collect()
        if part >= 1 or sum(r["count"] for r in found) >= rows:
            break
        part *= 8
    left, last = rows, -1
    for r in found:
        if left > 0:
            left, last = left - r["count"], r["_at"]
    return df.where(F.pmod(h, F.lit(top)) <= last)


def trim() -> None:
    """Give memory that a Python worker has freed back to the system; idle workers share an executor's memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plus(schema: StructType, name: str, kind: str) -> StructType:
    """A copy of a schema with one more column."""
    return StructType(list(schema.fields)).add(name, kind)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
