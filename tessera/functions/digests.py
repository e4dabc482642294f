"""Content hashes and seeds."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unsigned64(hex_digest: Column) -> Column:
    """The first eight bytes of a digest as a whole number, exact."""
    return F.conv(F.substr(hex_digest, F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")


def draw(*parts: Column | str) -> Column:
    """SEL10: a stable unsigned number from joined parts; the same for every partitioning."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return unsigned64(F.sha2(F.concat_ws(":", *cols), 256))


def canonical_json(value) -> str:
    """FN23: sorted keys, no white space, other scripts kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json_sha256(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_row_sha256(*names: str) -> Column:
    """FN23 on columns of text and whole numbers: the hash of a row's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def ordered_digest(position: Column, index: Column) -> Column:
    """FN24, an aggregate: the hash of indices joined by commas, in order of position."""
    rows = F.array_sort(F.collect_list(F.struct(position.alias("p"), index.alias("i"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["i"].cast("string")), ","), 256)


def ordered_digests(d: DataFrame, group: str, position: list[str], index: str) -> DataFrame:
    """FN24 for groups of any size: group, digest. A hash takes its bytes in order, so a group is one task, which
    reads its sorted rows as a stream and holds a batch of them."""
    kind = dict(d.dtypes)[group]
    keyed = d.withColumn("_g", F.col(group).cast("string")).withColumn("_i", F.col(index).cast("string"))
    rows = keyed.repartition("_g").sortWithinPartitions(F.asc_nulls_first("_g"), *position).select(F.col("_g").alias("g"), F.col("_i").alias("i"))

    def run(batches):
        h = key = None
        some = False
        for b in batches:
            for g, part in b["i"].groupby(b["g"], sort=False, dropna=False):
                g = None if pd.isna(g) else g
                if h is None or g != key:
                    if h is not None:
                        yield pd.DataFrame({"g": [key], "digest": [h.hexdigest()]})
                    h, key, some = hashlib.sha256(), g, False
                part = part.dropna()
                if len(part):
                    h.update((("," if some else "") + ",".join(part)).encode())
                    some = True
        if h is not None:
            yield pd.DataFrame({"g": [key], "digest": [h.hexdigest()]})

    return rows.mapInPandas(run, "g string, digest string").select(F.col("g").cast(kind).alias(group), "digest")


def file_sha256(content: Column) -> Column:
    """FN22 on the content column of a binaryFile scan."""
    return F.sha2(content, 256)


@F.pandas_udf(T.StringType())
def pcm_sha256(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
    """FN25: the hash of 16-bit samples behind ``rate:channels:``."""

    def one(x, r, c):
        if x is None:
            return None
        pcm = np.rint(np.clip(np.asarray(x, np.float64), -1.0, 1.0) * 32767.0).astype("<i2")
        return hashlib.sha256(f"{int(r)}:{int(c)}:".encode() + pcm.tobytes()).hexdigest()

    return pd.Series([one(*z) for z in zip(samples, rate, channels, strict=True)])


@F.pandas_udf(T.StringType())
def content_sha256(samples: pd.Series, rate: pd.Series, frames: pd.Series, channels: pd.Series) -> pd.Series:
    """FN26: the hash of 32-bit samples behind a packed header of rate, frames and channels."""

    def one(x, r, n, c):
        if x is None:
            return None
        return hashlib.sha256(struct.pack("<IQQ", int(r), int(n), int(c)) + np.asarray(x, "<f4").tobytes()).hexdigest()

    return pd.Series([one(*z) for z in zip(samples, rate, frames, channels, strict=True)])
