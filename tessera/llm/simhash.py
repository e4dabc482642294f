"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits over word shingles; two are linked if they differ in at most ``distance`` bits.
Equal fingerprints are one node from the start. The bits are split into m parts, bits that vary together
going into one part, and part i gets a threshold t_i >= -1 with sum(t_i + 1) = distance + 1: any linked pair
differs in at most t_i bits in some part. The parts and thresholds are chosen by dynamic programming on the
number of rows and candidate pairs they cost, estimated on a bounded sample of fingerprints; the choice
changes the cost, never the result. Each fingerprint is filed under its own value of a part, and probes the
values within t_i bits; whoever meets is verified on all 64 bits.

Within a bucket only links that connect are kept, found by searching outward from members already
connected, so a dense bucket costs far less than its pairs. A bucket over ``SPLIT`` members is cut: its
members are linked to one pivot where they can be, and the rest meet everyone else in blocks of bounded
size. Components are then joined up over the links.

Defined results: no words give fingerprint zero, linked like any other; a text of fewer words than a shingle
is one shingle; null texts are empty; repeated rows are documents of their own; the component of documents
that only have null ids is null. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import least_hashed, materialize, partitions, read, row_key, trim
from tessera.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints looked at to choose the parts.
SAMPLE = 4000
#: Members of a bucket that are compared in one task.
SPLIT = 4096


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts, ends, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs``: doc_id, text. doc_id and fp, a signed long of the same bits."""

    def batch(parts):
        for d in parts:
            yield pd.DataFrame({"doc_id": d["doc_id"], "fp": np.array([fingerprint(t, width, seed) for t in d["text"]], np.uint64).view(np.int64)})
        trim()

    kind = dict(docs.dtypes)["doc_id"]
    # ids travel as text: pandas would turn numbers beside nulls into doubles
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(batch, "doc_id string, fp long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "fp")


def _variants(bits: list[int], radius: int) -> list[int]:
    """Masks over 64 bits that flip up to ``radius`` of ``bits``."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]


def allocate(sample: np.ndarray, total: int, distance: int = DISTANCE, row_cost: float = 2e-6, pair_cost: float = 2e-9):
    """Parts (lists of bits) and their thresholds of least estimated cost for ``total`` fingerprints."""
    total = max(1, total)
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    z = bits - bits.mean(axis=0)
    scale = np.sqrt((z * z).sum(axis=0))
    link = np.abs(z.T @ z) / np.maximum(np.outer(scale, scale), 1e-9)
    # a walk from each bit to the free bit most alike, so that neighbours vary together
    left = set(range(1, 64))
    walk = [0]
    while left:
        walk.append(max(sorted(left), key=lambda b: link[walk[-1], b]))
        left.remove(walk[-1])
    best = None
    for m in range(1, distance + 2):
        parts = [sorted(int(b) for b in p) for p in np.array_split(np.array(walk), m)]
        cost = []
        for p in parts:
            mask = np.uint64(sum(1 << b for b in p))
            d = np.concatenate([np.bitwise_count((sample[i + 1 :] ^ sample[i]) & mask) for i in range(0, len(sample), 4)]) if len(sample) > 1 else np.zeros(0, np.uint8)
            rows = []
            for t in range(distance + 1):
                near = (np.count_nonzero(d <= t) + 1) / (len(d) + 2)
                probes = sum(1 for r in range(t + 1) for _ in combinations(range(len(p)), r)) if t <= 2 else float("inf")
                rows.append(total * probes * row_cost + total * total / 2 * near * pair_cost)
            cost.append(rows)
        # table[b]: least cost of the parts so far with b of the budget sum(t + 1) spent
        table = {0: (0.0, ())}
        for rows in cost:
            after: dict = {}
            for spent, (c, ts) in table.items():
                for t in range(-1, distance + 1 - spent):
                    now = (c + (rows[t] if t >= 0 else 0.0), (*ts, t))
                    if spent + t + 1 not in after or now < after[spent + t + 1]:
                        after[spent + t + 1] = now
            table = after
        c, ts = table[distance + 1]
        if best is None or c < best[0]:
            best = (c, parts, ts)
    return best[1], best[2]


def connect(home: np.ndarray, guests: np.ndarray, distance: int):
    """Links that connect all of home + guests that are linked through pairs with a member of ``home``."""
    fps = np.concatenate((home, guests))
    own = len(home)
    if len(fps) <= 16:
        i, j = np.triu_indices(len(fps), 1)
        keep = (i < own) & (np.bitwise_count(fps[i] ^ fps[j]) <= distance)
        return fps[i[keep]], fps[j[keep]]
    free = np.ones(len(fps), bool)
    a, b = [], []
    for first in range(own):
        if not free[first]:
            continue
        free[first] = False
        wave = np.array([first])
        while len(wave):
            found = []
            for k in range(0, len(wave), 128):
                rest = np.flatnonzero(free)
                if not len(rest):
                    break
                some = wave[k : k + 128]
                near = np.bitwise_count(fps[some][:, None] ^ fps[rest][None, :]) <= distance
                near &= (some < own)[:, None] | (rest < own)[None, :]
                hit = near.any(axis=0)
                if hit.any():
                    a.append(fps[some[near[:, hit].argmax(axis=0)]])
                    b.append(fps[rest[hit]])
                    free[rest[hit]] = False
                    found.append(rest[hit])
            wave = np.concatenate(found) if found else np.zeros(0, np.int64)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _meet(rows: DataFrame, distance: int) -> DataFrame:
    """``rows``: key, fp, home. The links found in each key, keys dealt by hash and read in sorted runs."""

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        out: list = []

        def flush(key, fp, home):
            cut = np.flatnonzero(np.diff(key)) + 1
            for k, h in zip(np.split(fp, cut), np.split(home, cut), strict=True):
                if len(k) > 1 and h.any():
                    x, y = connect(np.unique(k[h]), np.unique(k[~h]), distance)
                    if len(x):
                        out.append((x.view(np.int64), y.view(np.int64)))

        for t in batches:
            cols = [t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[0]):
                last = int(np.searchsorted(held[0], held[0][-1]))
                flush(*(x[:last] for x in held))
                held = [x[last:] for x in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        if len(held[0]):
            flush(*held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """``nodes``: fp, n (documents), one row a fingerprint. Links (a, b) that connect whatever is linked."""
    total = nodes.count()
    sample = least_hashed(nodes.select("fp"), F.xxhash64("fp"), SAMPLE).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts, thresholds = allocate(sample, total, distance)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    filed = None
    for i, (bits, t) in enumerate(zip(parts, thresholds, strict=True)):
        if t < 0:
            continue
        mask = F.lit(signed(sum(1 << b for b in bits)))
        flips = F.explode(F.array(*(F.lit(signed(x)) for x in _variants(bits, t))))
        rows = nodes.select("fp", "n", flips.alias("flip"))
        rows = rows.select(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(mask).bitwiseXOR(F.col("flip"))).alias("key"), "fp", "n", (F.col("flip") == 0).alias("home"))
        filed = rows if filed is None else filed.union(rows)
    filed = materialize(filed, "filed")
    size = filed.groupBy("key").agg(F.count("*").alias("members"), F.max(F.when(F.col("home"), F.struct("n", "fp")))["fp"].alias("pivot"))
    large = materialize(size.where((F.col("members") > split) & F.col("pivot").isNotNull()), "large")
    found = _meet(filed.join(large, "key", "left_anti").select("key", "fp", "home"), distance)
    if large.isEmpty():
        return found
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= distance
    members = materialize(filed.join(large.select("key", "pivot"), "key").select("key", "fp", "home", "pivot", near.alias("near")), "members")
    found = found.union(members.where("near and fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    # the rest meets the rest and everyone near the pivot, block by block
    counts = members.groupBy("key").agg(F.count_if("near").alias("nl"), F.count_if(~F.col("near")).alias("nr"))
    block = lambda c: F.ceil(F.col(c) / (split // 2)).cast("int")
    counts = materialize(counts.where("nr > 0").select("key", block("nl").alias("bl"), block("nr").alias("br")), "blocks")
    m = members.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.when(F.col("near"), F.greatest("bl", F.lit(1))).otherwise(F.col("br"))).cast("int"))
    rest = F.sequence(F.lit(0), F.col("br") - 1)
    near_cells = F.transform(rest, lambda r: F.struct(r.alias("r"), (F.col("own") + F.col("br")).alias("c")))
    rest_cells = F.concat(
        F.transform(rest, lambda r: F.struct(F.least(r, F.col("own")).alias("r"), F.greatest(r, F.col("own")).alias("c"))),
        F.filter(F.transform(F.sequence(F.lit(0), F.greatest("bl", F.lit(1)) - 1), lambda c: F.struct(F.col("own").alias("r"), (c + F.col("br")).alias("c"))), lambda x: F.col("bl") > 0),
    )
    cells = m.select("key", "fp", "home", F.explode(F.when(F.col("near"), near_cells).otherwise(rest_cells)).alias("cell"))
    return found.union(_meet(cells.select(F.xxhash64("key", "cell.r", "cell.c").alias("key"), "fp", "home"), distance))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (signed long) and component_id (smallest doc_id reachable over links) of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    fps = materialize(fingerprints(docs, width), "fps")
    nodes = materialize(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes.select("fp", "n"), distance))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = materialize(named, "named")
    names = materialize(named.groupBy("label").agg(F.min("first").alias("component_id")), "names")
    by_fp = materialize(named.join(names, "label").select("fp", "component_id"), "by-fp")
    return fps.join(by_fp, "fp").select("doc_id", "fp", F.col("component_id").cast(kind).alias("component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row of smallest id stays (ids that are null last; of rows with one id the one of
    least content hash). Different texts under one id are documents of their own; rows equal in all columns are one."""
    keyed = docs.withColumn("__key", row_key(docs))
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"))
    found = materialize(found.select(F.col("doc_id").alias("__key"), "component_id").distinct(), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")
    first = keyed.select("doc_id", "__key").join(found, "__key").groupBy("component_id").agg(F.min(place)["__key"].alias("__key"))
    stay = materialize(first.select("__key"), "stay")
    kept = keyed.join(stay, "__key", "left_semi").dropDuplicates(["__key"])
    return kept.select(*(f"`{c}`" for c in docs.columns))
