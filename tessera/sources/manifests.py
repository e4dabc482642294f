"""Scans of manifests, side tables and shards. All are lazy and project what they need."""

from __future__ import annotations

import io
import os
import re
import wave

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tessera.contracts import enforce, missing, not_missing, unique

#: FIXTURES F1, the columns every utterance manifest has.
UTTERANCE = "audio_filepath string, duration double, text string, id string, speaker_id string, language string, gender string"


def jsonl(spark: SparkSession, path, schema: str, strict: bool = True) -> DataFrame:
    """SRC1, SRC2: one JSON object a line, blank lines skipped; strict scans fail on a bad line."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def numbered_jsonl(spark: SparkSession, path, schema: str, split: str) -> DataFrame:
    """SRC1 with split and manifest_line (from 1, blank lines not counted) of one file."""
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()).where("trim(value) <> ''")
    w = Window.orderBy("_id")  # a manifest is read whole and in order by one task: file order is its only order
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.row_number().over(w).alias("manifest_line"))
    return rows.select("r.*", F.lit(split).alias("split"), "manifest_line")


def bad_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    """SRC2: file and text of lines that do not parse."""
    full = StructType([*StructType.fromDDL(schema).fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("file", F.input_file_name())
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.where("r._corrupt is not null").select("file", F.col("value").alias("line"))


def missing_files(manifest: DataFrame, column: str, files: DataFrame) -> DataFrame:
    """SRC3: rows whose file is not in a listing (path)."""
    return manifest.join(files.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SRC16: the files below a root by name pattern, sorted."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime").orderBy("path")


def pooled(splits: dict[str, DataFrame], required=("speaker_id", "text", "audio_filepath")) -> DataFrame:
    """SRC4, SET1: splits in one table with original_split; ids unique over all, required columns filled."""
    out = None
    for name, df in splits.items():
        part = df.withColumn("original_split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return enforce(enforce(out, not_missing(out, *required), "rows lack required columns"), unique(out, "id"), "ids repeat")


def keyed_predictions(df: DataFrame, require_speaker: bool = True) -> DataFrame:
    """SRC5."""
    out = enforce(df, unique(df, "id"), "ids repeat")
    return enforce(out, not_missing(df, "speaker_id"), "rows lack a speaker") if require_speaker else out


def cluster_map(df: DataFrame, field: str = "source_id") -> DataFrame:
    """SRC6: id to cluster, the cluster filled."""
    m = df.select("id", F.col(field).cast("string").alias("cluster"))
    return enforce(m, m.where(missing(F.col("cluster"))), "rows lack a cluster")


def csv(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def hash_set(df: DataFrame, column: str = "pcm_sha256") -> DataFrame:
    """SRC7."""
    return df.select(column).distinct()


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """SRC8: one row a key, the last in order. An aggregate, so a key with very many rows is combined early."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def train_field(metadata: DataFrame, ids: DataFrame, field: str, split: str = "train") -> DataFrame:
    """SRC9, JN6: one field of a split for exactly the given ids (id, position)."""
    m = metadata.where(F.col("split") == split).select("id", field)
    j = ids.join(m.withColumn("_m", F.lit(True)), "id", "full")
    wrong = j.where(F.col("_m").isNull() | F.col("position").isNull())
    return enforce(enforce(j.drop("_m"), unique(m, "id"), "metadata ids repeat"), wrong, "metadata and ids differ").orderBy("position")


def shards(spark: SparkSession, paths, columns: list[str], max_rows: int | None = None) -> DataFrame:
    """SRC10, SRC11: shards with only the needed columns; a bound takes the first rows by shard and row."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select(*columns)
    return df if max_rows is None else df.limit(max_rows)


def point_lookup(wanted: DataFrame, source: DataFrame, identity: list[str]) -> DataFrame:
    """SRC12, JN10: rows by (shard, row_index), failing where what is found differs in identity."""
    found = source.select("shard", "row_index", *(F.col(c).alias(f"_{c}") for c in identity), *(c for c in source.columns if c not in ("shard", "row_index", *identity)))
    j = wanted.join(found, ["shard", "row_index"], "left")
    differs = F.lit(False)
    for c in identity:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return enforce(j.drop(*(f"_{c}" for c in identity)), j.where(differs), "looked-up rows differ from the request")


def dropped_rows(df: DataFrame, audio: str = "audio_filepath", text: str = "text") -> DataFrame:
    """SRC13: how many rows lack audio or text."""
    return df.agg(F.count_if(missing(F.col(audio))).alias("missing_audio"), F.count_if(~missing(F.col(audio)) & missing(F.col(text))).alias("empty_text"))


def named(specs: list[str]) -> dict[str, str]:
    """SRC14, SRC15: NAME=PATH pairs, names checked and unique."""
    out: dict[str, str] = {}
    for s in specs:
        name, eq, path = s.partition("=")
        if not eq or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name) or not path or name in out:
            raise ValueError(f"not a unique NAME=PATH: {s}")
        out[name] = path
    return out


def assets(df: DataFrame, partition: str, kinds=("noise", "rir"), partitions=("train", "validation", "test")) -> dict[str, DataFrame]:
    """SRC19: an inventory's rows of one partition, by kind."""
    bad = df.where(~F.col("kind").isin(list(kinds)) | ~F.col("partition").isin(list(partitions)))
    own = enforce(df, bad, "unknown kind or partition").where(F.col("partition") == partition)
    return {k: own.where(F.col("kind") == k) for k in kinds}


def config_path(value: str, root: str) -> str:
    """SRC20: environment and user expanded, relative to a root."""
    p = os.path.expanduser(os.path.expandvars(value))
    return p if os.path.isabs(p) else os.path.normpath(os.path.join(root, p))


def run_grid(spark: SparkSession, paths, pattern: str, names: list[str], schema: str) -> DataFrame:
    """SRC24: JSON results of run directories with the parts of their path as columns."""
    df = spark.read.schema(schema).option("multiLine", "true").json(paths).withColumn("_f", F.input_file_name())
    return df.select(*(F.regexp_extract("_f", pattern, i + 1).alias(n) for i, n in enumerate(names)), *[c for c in df.columns if c != "_f"])


def telemetry(events: DataFrame, device: str, key: str) -> DataFrame:
    """SRC25: one key of one device from a long event table."""
    return events.where((F.col("device") == device) & (F.col("key") == key)).select("ts", "value")


def downmix(channels):
    """SRC17 after decoding: the mean of channels, sample by sample (an array of arrays)."""
    n = F.size(channels)
    first = F.get(channels, F.lit(0))
    return F.transform(first, lambda _, i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.get(c, i).cast("double")) / n)


def text_directory(text: DataFrame, files: DataFrame) -> DataFrame:
    """SRC23, JN14: paths with their text by base name, '' where there is none."""
    base = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.withColumn("name", base).join(text, "name", "left").withColumn("text", F.coalesce("text", F.lit("")))


_HEADER = StructType([StructField("sample_rate", IntegerType()), StructField("channels", IntegerType()), StructField("bits", IntegerType()), StructField("duration", DoubleType())])


@F.pandas_udf(_HEADER)
def wav_header(content: pd.Series) -> pd.DataFrame:
    """SRC18: rate, channels, bits and duration of PCM WAV bytes; nulls for anything else. Other codecs need a
    library that Spark does not bring."""

    def one(raw):
        try:
            with wave.open(io.BytesIO(raw)) as w:
                return w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), w.getnframes() / w.getframerate()
        except (wave.Error, EOFError, TypeError, ZeroDivisionError):
            return None, None, None, None

    return pd.DataFrame([one(x) for x in content], columns=[f.name for f in _HEADER.fields])


def pinned(df: DataFrame, revision: str, column: str = "revision") -> DataFrame:
    """SRC22: rows, failing if any carries another revision than the pinned one."""
    return enforce(df, df.where(~F.col(column).eqNullSafe(F.lit(revision))), "rows of another revision")
