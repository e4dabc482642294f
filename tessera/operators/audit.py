"""Admission, audits and joins that check what they join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.contracts import agree, covered, enforce, equal_keys

#: Bounds of an admitted duration, both included.
SHORTEST, LONGEST = 1.0, 30.0


def paired(base: DataFrame, candidate: DataFrame, key: str, same: list[str], values: list[str]) -> DataFrame:
    """JN1: one-to-one join of runs with equal key sets and equal shared columns; values get _base and _candidate."""
    b = enforce(base, equal_keys(base, candidate, key), "runs hold different keys")
    b = enforce(b, agree(base, candidate, [key], same), "runs differ in shared columns")
    b = b.select(key, *same, *(F.col(v).alias(f"{v}_base") for v in values))
    return b.join(candidate.select(key, *(F.col(v).alias(f"{v}_candidate") for v in values)), key)


def four_way(cells: DataFrame, key: str, cell: str, names: list[str], same: list[str], value: str) -> DataFrame:
    """JN2: a factorial's cells side by side, as one aggregation; rows must hold every cell once and agree."""
    picks = [F.max(F.when(F.col(cell) == n, F.col(value))).alias(n) for n in names]
    shared = [F.max(c).alias(c) for c in same]
    differ = [(F.min(c) != F.max(c)) for c in same]
    bad = F.count("*") != len(names)
    for d in differ:
        bad = bad | d
    out = cells.groupBy(key).agg(*picks, *shared, bad.alias("_bad"), F.count_distinct(cell).alias("_cells"))
    return enforce(out, out.where(F.col("_bad") | (F.col("_cells") != len(names))), "cells do not match").drop("_bad", "_cells")


def with_cluster(rows: DataFrame, clusters: DataFrame, key: str = "id") -> DataFrame:
    """JN3: many-to-one, none missing, extras fine."""
    return enforce(rows, covered(rows, clusters, key), "rows lack a cluster").join(clusters, key)


def overlapping_splits(rows: DataFrame, gold: DataFrame, speaker: str, split_order: list[str]) -> DataFrame:
    """JN5: the gold splits a speaker is in, in the order of splits."""
    rank = F.array_position(F.array(*map(F.lit, split_order)), F.col("split"))
    g = gold.select(speaker, "split").distinct().groupBy(speaker).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("split").alias("s")))), lambda x: x["s"]).alias("gold_speaker_splits"))
    return rows.join(g, speaker, "left").withColumn("gold_speaker_splits", F.coalesce("gold_speaker_splits", F.array().cast("array<string>")))


def admission(rows: DataFrame, gold_ids: DataFrame, eval_speakers: DataFrame, gold_hashes: DataFrame, external_hashes: DataFrame, order: list[str]) -> DataFrame:
    """DQ1, FLT2, FLT3, JN4, WN7: each row with all reasons against it, in a fixed order.

    A row counts as seen for later ones even when it is rejected itself.
    """
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    d = rows.join(flag(gold_ids, "id", "_gold"), "id", "left").join(flag(eval_speakers, "speaker_id", "_eval"), "speaker_id", "left")
    d = d.join(flag(gold_hashes, "pcm_sha256", "_gh"), "pcm_sha256", "left").join(flag(external_hashes, "pcm_sha256", "_eh"), "pcm_sha256", "left")
    # first seen by aggregation: a hash carried by very many rows is combined before it is shuffled
    first = rows.groupBy("pcm_sha256").agg(F.min(F.struct(*order)).alias("_first"))
    d = d.join(first, "pcm_sha256", "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = [
        ("gold_id", on("_gold")),
        ("evaluation_speaker", on("_eval")),
        ("too_short", F.col("duration") < SHORTEST),
        ("too_long", F.col("duration") > LONGEST),
        ("not_mono", F.col("channels") != 1),
        ("gold_audio", on("_gh")),
        ("external_audio", on("_eh")),
        ("duplicate_audio", F.struct(*order) != F.col("_first")),
    ]
    why = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in reasons)))
    return d.withColumn("rejection_reasons", why).withColumn("eligible", F.size("rejection_reasons") == 0).select(*rows.columns, "rejection_reasons", "eligible")


def reason_counts(rows: DataFrame) -> DataFrame:
    """AG16: each reason once a row."""
    return rows.select(F.explode(F.array_distinct("rejection_reasons")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, *fields: str) -> DataFrame:
    """AG6: counts of the values of several fields, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def upper_median(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """AG11: element n div 2 of the sorted values, from counts by value."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    c = c.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_at", F.floor(F.sum("_n").over(w) / 2))
    return c.where(F.col("_upto") > F.col("_at")).groupBy(*by).agg(F.min(value).alias("upper_median"))


def seven_points(value: str) -> list[Column]:
    """AG12: least, 5, 25, 50, 75, 95 per cent and most, interpolated."""
    p = F.percentile(value, F.array(*map(F.lit, (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0))))
    return [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("low", "p05", "p25", "p50", "p75", "p95", "high"))]


def group_profile(df: DataFrame, group: str, hours: str) -> DataFrame:
    """AG4, AG5: rows, hours and groups, and the largest group's rows, hours and shares; nulls when empty."""
    g = df.groupBy(group).agg(F.count("*").alias("r"), F.sum(hours).alias("h"))
    return g.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.round(F.coalesce(F.sum("h"), F.lit(0.0)), 6).alias("hours"), F.count("*").alias("groups"), F.max("r").alias("max_rows"),
        F.round(F.max("h"), 6).alias("max_hours"), F.round(F.max("r") / F.sum("r"), 9).alias("max_row_share"), F.round(F.max("h") / F.sum("h"), 9).alias("max_hour_share"),
    )


def leakage(df: DataFrame, content: str, partition: str) -> DataFrame:
    """AG25, SET6: content in more than one part."""
    return df.groupBy(content).agg(F.count_distinct(partition).alias("parts")).where("parts > 1")


def metadata_changes(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """JN7, DQ5: of rows with a reference hash, how many are equal, differ at the same path, or moved."""
    j = rows.join(reference.select("id", F.col("path").alias("_p"), F.col("sha256").alias("_h")), "id", "left")
    known, same_path = F.col("_h").isNotNull(), F.col("path").eqNullSafe(F.col("_p"))
    return j.agg(F.count_if(~known).alias("without_reference"), F.count_if(known & ~same_path).alias("moved"), F.count_if(known & same_path & (F.col("sha256") != F.col("_h"))).alias("mismatched"), F.count_if(known & same_path & (F.col("sha256") == F.col("_h"))).alias("equal"))
