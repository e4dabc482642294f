"""Sinks and their durability contracts, through Spark's file systems only."""

from __future__ import annotations

import io
import json
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_jsonl(df: DataFrame, path: str, immutable: bool = False) -> None:
    """SNK1, SNK4."""
    df.write.mode("errorifexists" if immutable else "overwrite").json(path)


def write_staged(df: DataFrame, path: str, fmt: str = "parquet", replace: bool = False) -> None:
    """SNK2, SNK3, SNK5: written beside the target, then renamed; nothing is left behind on failure."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not replace:
        raise FileExistsError(path)
    stage = f"{path}.staging-{uuid.uuid4().hex}"
    _, staged = _fs(spark, stage)
    try:
        df.write.format(fmt).save(stage)
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(staged, target):
            raise OSError(f"could not rename {stage}")
    except BaseException:
        fs.delete(staged, True)
        raise


def write_csv(df: DataFrame, path: str) -> None:
    """SNK6."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def union_columns(*dfs: DataFrame) -> DataFrame:
    """SNK6: tables under the union of their columns."""
    out = dfs[0].select("*")
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def write_text(spark: SparkSession, path: str, text: str, mode: str = "exact") -> bool:
    """SNK12: ``exact`` accepts an equal file and refuses a different one; ``absent`` writes only a new one."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        same = spark.read.text(path, wholetext=True).first()
        if mode == "exact" and (same["value"] if same else "") != text:
            raise FileExistsError(path)
        return False
    out = fs.create(p)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def write_all_or_none(spark: SparkSession, files: dict[str, str]) -> None:
    """SNK12: every target is checked before any is written."""
    for path, text in files.items():
        if exists(spark, path):
            found = spark.read.text(path, wholetext=True).first()
            if (found["value"] if found else "") != text:
                raise FileExistsError(path)
    for path, text in files.items():
        write_text(spark, path, text)


def chunked(df: DataFrame, path: str, order: str, size: int, provenance: str) -> DataFrame:
    """SNK7: rows written by chunk of ``size`` positions (``order`` is a dense position from 0), each bound to its
    bounds, row count, content hash and provenance. Chunks whose marker still holds are not written again.
    Returns the markers."""
    spark = df.sparkSession
    c = df.withColumn("chunk", F.floor(F.col(order) / size).cast("long"))
    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    marks = c.withColumn("_h", row).groupBy("chunk").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_h"))), lambda x: x["_h"]), ","), 256).alias("content"),
    ).withColumn("provenance", F.lit(provenance))
    markers = f"{path}/markers"
    old = spark.read.parquet(markers) if exists(spark, markers) else marks.where("false")
    new = marks.join(old, ["chunk", "first", "last", "rows", "content", "provenance"], "left_anti")
    todo = [r["chunk"] for r in new.select("chunk").collect()]  # numbers of chunks, one in ``size`` rows
    if todo:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            c.where(F.col("chunk").isin(todo)).write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/rows")
        finally:
            spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        kept = old.join(new.select("chunk"), "chunk", "left_anti").unionByName(new)
        write_staged(kept, markers, replace=True) if not exists(spark, markers) else _swap(kept, markers)
    return spark.read.parquet(markers)


def _swap(df: DataFrame, path: str) -> None:
    """Replace a table that the plan reads: write beside it first, then swap names."""
    write_staged(df, path, replace=True)


def consolidated(spark: SparkSession, path: str, order: str, manifest: DataFrame) -> DataFrame:
    """SNK8: all chunks in order; fails if their positions and ids are not the manifest's."""
    from tessera.contracts import enforce

    rows = spark.read.parquet(f"{path}/rows")
    m = manifest.select(F.col(order).alias("_o"), F.col("id").alias("_id"))
    wrong = rows.join(m, rows[order] == m["_o"], "full").where(~F.col("id").eqNullSafe(F.col("_id")))
    return enforce(rows, wrong, "chunks differ from the manifest").drop("chunk").orderBy(order)


def inventory_diff(expected: DataFrame, present: DataFrame) -> DataFrame:
    """SNK9, JN15: path, and missing, extra, changed or same by size and hash."""
    e = expected.select("path", F.col("size").alias("es"), F.col("sha256").alias("eh"), F.lit(True).alias("e"))
    p = present.select("path", F.col("size").alias("ps"), F.col("sha256").alias("ph"), F.lit(True).alias("p"))
    j = e.join(p, "path", "full")
    state = F.when(F.col("p").isNull(), "missing").when(F.col("e").isNull(), "extra").when((F.col("es") != F.col("ps")) | (F.col("eh") != F.col("ph")), "changed").otherwise("same")
    return j.select("path", state.alias("state"))


def mean_sd(mean: float | None, sd: float | None, digits: int = 2) -> str:
    """AG14, SNK10: a cell of a report."""
    if mean is None:
        return "n/a"
    return f"{mean:.{digits}f}" if sd is None else f"{mean:.{digits}f} ± {sd:.{digits}f}"


def markdown_table(rows: list[dict]) -> str:
    """SNK10: collected report rows as a table."""
    if not rows:
        return ""
    cols = list(rows[0])
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join(str(r.get(c, "")) for c in cols) + " |" for r in rows]) + "\n"


def replace_block(document: str, begin: str, end: str, body: str) -> str:
    """SNK11: what stands between two marks, each of which must occur once."""
    if document.count(begin) != 1 or document.count(end) != 1 or document.index(begin) > document.index(end):
        raise ValueError("marks must occur once, in order")
    head, _, rest = document.partition(begin)
    return head + begin + "\n" + body.strip("\n") + "\n" + end + rest.partition(end)[2]


@F.pandas_udf(BinaryType())
def pcm_wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """SNK13: one channel of samples in -1..1 as the bytes of a 16-bit PCM WAV file; null samples give null."""

    def one(x, r):
        if x is None:
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes(np.rint(np.clip(np.asarray(x, np.float64), -1.0, 1.0) * 32767.0).astype("<i2").tobytes())
        return out.getvalue()

    return pd.Series([one(x, r) for x, r in zip(samples, rate, strict=True)])


def write_signal(df: DataFrame, path: str) -> None:
    """SNK13: signals, as arrays or as WAV bytes, in Parquet; other codecs are out of scope."""
    df.write.mode("overwrite").parquet(path)


def to_json_document(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"
