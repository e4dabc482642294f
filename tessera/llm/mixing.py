"""Mixing sources to target weights as a time-varying curriculum (native: DataFrame functions only).

Each source gets a share of all words by weight, limited to ``cap`` times its own size; the excess is
shared again by weight until no source is above its limit. Over the training time t in [0, 1] a source is
demanded at the rate ``1 + tilt * (2 t - 1)`` times its target, so the demand up to t integrates to
``target * (t + tilt * (t^2 - t))``. A document lies at its place in the running sum of its source's
words; inverting the integral there gives its training position, and documents are range-sorted by it.

A source may hold most rows, so the running sum is made in two levels: hash buckets within a source are
summed first (with map-side combine), and only rows of one bucket are ever sorted together.

Defined results: a null text has size 0, null sources form one source that comes last, repeated rows are
documents of their own, an empty table gives an empty mix. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialize, read, row_key

WEIGHTS = (1, 2, 3)
TILTS = (-0.5, 0.0, 0.5)
CAP = 3
#: Hash buckets within a source, a power of 16.
BUCKET_HEX = 3


def targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, cap=CAP) -> DataFrame:
    """Water-filling. ``sizes``: skey, source, source_size, one row a source. Adds target and tilt.

    With sources by ascending limit/weight, the level at which the k-th would be the first one below its
    limit is (all - limits before k) / (weights from k); the true level is the largest of these.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    i = (F.row_number().over(by_name) - 1) % n
    s = sizes.withColumn("i", i)
    s = s.withColumn("w", F.get(F.array(*map(F.lit, weights)), "i").cast("double"))
    s = s.withColumn("tilt", F.get(F.array(*(F.lit(float(x)) for x in tilts)), "i"))
    s = s.withColumn("limit", (F.col("source_size") * cap).cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole).cast("double") - before) / rest)
    s = s.withColumn("target", F.least("limit", F.max("level").over(whole) * F.col("w")))
    return s.select("skey", "source_size", "target", "tilt")


def position(q, tilt):
    """The t at which the integrated demand reaches the share q of the target."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * q)
    return F.when(tilt == 0, q).otherwise((root - (1 - tilt)) / (2 * tilt))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, tilts=TILTS, cap=CAP) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, copies, positions (one a copy)."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        # any number of documents may share an id or have none, so content takes part in the order
        F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text_col, F.lit("")))), 256).alias("h"),
    )
    base = materialize(base, "mix")
    keyed = base.select("*", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("skey"))
    keyed = keyed.withColumn("b", F.substr("h", F.lit(1), F.lit(BUCKET_HEX)))
    sums = materialize(keyed.groupBy("skey", "source", "b").agg(F.sum("size").alias("in_bucket")), "mix-sums")
    level = targets(sums.groupBy("skey", "source").agg(F.sum("in_bucket").alias("source_size")), weights, tilts, cap)
    before = F.sum("in_bucket").over(Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    buckets = sums.select("skey", "b", F.coalesce(before, F.lit(0)).alias("offset")).join(level, "skey")
    within = Window.partitionBy("skey", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = keyed.withColumn("upto", F.sum("size").over(within)).join(buckets, ["skey", "b"])
    d = d.withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
    # a pass over the source takes the document if its middle lies before the target
    last = F.rint("target").cast("bigint")
    passes = F.filter(
        F.sequence(F.lit(0), F.lit(cap - 1)),
        lambda p: (F.col("size") > 0) & (2 * (p * F.col("source_size") + F.col("start")) + F.col("size") <= 2 * last),
    )
    d = d.withColumn("passes", passes)
    middle = lambda p: (2 * (p * F.col("source_size") + F.col("start")) + F.col("size")).cast("double") / (2 * F.col("target"))
    d = d.withColumn("positions", F.transform("passes", lambda p: position(F.least(middle(p), F.lit(1.0)), F.col("tilt"))))
    return d.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.size("passes")).cast("bigint").alias("taken"),
        F.size("passes").alias("copies"), "positions",
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    out = out.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
    return out.orderBy("position", "doc_id")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, in the order of training positions: rows are
    range-sorted, and written files keep that order."""
    keyed = docs.withColumn("__key", row_key(docs))
    taken = mix(keyed, id_col="__key").select(F.col("doc_id").alias("__key"), F.explode("positions").alias("__position"))
    # rows repeated whole share a key, and all their copies
    out = keyed.dropDuplicates(["__key"]).join(taken, "__key").orderBy("__position", "__key")
    return out.select(*(f"`{c}`" for c in docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS i
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST(i + 1 AS DOUBLE) AS w, CASE i WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tilt,
         CAST(3 * source_size AS DOUBLE) AS lim FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
     - coalesce(sum(lim) OVER (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
     / sum(w) OVER (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(lim, (max(level) OVER ()) * w) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS start,
         CAST(round_even(t.target, 0) AS BIGINT) AS last
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, (2 * start + size)::DOUBLE / (2 * target) AS q,
    CASE WHEN size = 0 THEN 0 ELSE
      (2 * start + size <= 2 * last)::INT + (2 * (source_size + start) + size <= 2 * last)::INT
      + (2 * (2 * source_size + start) + size <= 2 * last)::INT END AS n FROM r)
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken,
  CASE WHEN n = 0 THEN NULL
       WHEN tilt = 0 THEN least(q, 1.0::DOUBLE)
       ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * least(q, 1.0::DOUBLE)) - (1 - tilt)) / (2 * tilt) END AS position
FROM c
"""
