"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers; component d of a vector is its weight for term d, zeros are not posted.
Queries and candidates are dealt into blocks of bounded size; each pair of a query block and a candidate
block meets in one task, which walks the terms, scatters ``weight * posting`` into a dense score array of
queries by candidates, and keeps the k best of each query by partition selection. The partial lists are
then merged by query. Every query meets every candidate; nothing is pruned.

Defined results: a vector that is null, or holds null or non-finite components, takes no part; vectors of
different lengths are compared over the terms both have, so an empty vector scores 0; rows repeated whole
are one vector; ties go to the smaller id; rows with a null id take no part. Scores are exact as long as
they fit 63 bits; quantised components beyond that saturate. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read

QUERY_BLOCK, CANDIDATE_BLOCK, SMALLEST_BLOCK = 4096, 8192, 256
#: Scores held at once in a task.
CELLS = 1 << 19


def _rows(t: pa.Table, width: int) -> np.ndarray:
    """The vectors of a block as rows, padded with zeros."""
    a = t.column("v").combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.list_(pa.int64()))
    n = np.diff(a.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = a.flatten().to_numpy()
    return out


def _width(t: pa.Table) -> int:
    import pyarrow.compute as pc

    return pc.max(pc.list_value_length(t.column("v"))).as_py() or 0


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of queries by candidates, term at a time."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(queries.shape[1]):
        who = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(candidates[:, term])
        if not len(who) or not len(posting):
            continue
        add = np.multiply.outer(queries[who, term], candidates[posting, term])
        if len(posting) == len(candidates):
            scores[who] += add
        else:
            scores[np.ix_(who, posting)] += add
    return scores


def best(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int):
    """The k best candidates of each query: (query id, id, score)."""
    out = []
    for q, row in zip(query_ids, scores, strict=True):
        other = ids != q
        s, i = row[other], ids[other]
        if len(s) > k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            s, i = s[keep], i[keep]
        order = np.lexsort((i, -s))[:k]
        out.append((np.full(len(order), q), i[order], s[order]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, id_col="vec_id", vector_col="embedding", every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query (the rows whose id is divisible by ``every``)."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & whole)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()
    n, nq = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    if n > 20 * SMALLEST_BLOCK:
        size = min(CANDIDATE_BLOCK, max(SMALLEST_BLOCK, n // 64))
    else:
        size = SMALLEST_BLOCK
    nc, nb = max(1, math.ceil(n / size)), max(1, math.ceil(nq / QUERY_BLOCK))
    dealt = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    candidates = rows.select("id", "v", dealt(1, nc).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("qb"))
    queries = rows.where(F.col("id") % every == 0).select("id", "v", dealt(2, nb).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max(_width(left), _width(right))
        ids, qids = (t.column("id").to_numpy() for t in (left, right))
        found = [[np.zeros(0, np.int64)] * 3]
        if len(ids) and len(qids):
            c, q = _rows(left, width), _rows(right, width)
            step = max(1, CELLS // len(ids))
            for i in range(0, len(qids), step):
                found.append(best(accumulate(q[i : i + step], c), qids[i : i + step], ids, k))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    keys = ["cb", "qb"]
    partial = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(block, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH r AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, coalesce(score, 0) AS score FROM t WHERE rank <= 10
"""
