"""Document fingerprints: digests of improbable features in chained Bloom filters.

Every 32-byte window of a text has a Shannon entropy, kept in fixed point and updated from window to window.
Natural text has a typical entropy; the further a window is from it, the rarer it ranks. Within each run of
32 neighbouring windows the rarest (the first of equals) gets a vote; windows with 8 votes or more are
features. In a text of 32 bytes or more where no window is one, the rarest (the first of equals) is the only
feature. Features go in order into Bloom filters of 2,048 bits, 5 bits each, and a new filter begins after
160 features. Two digests are compared filter by filter: shared bits between what chance gives and what is
possible at most, normalised to 0..1, each filter of the shorter digest against its best partner.

All windows of a batch of texts are handled by a few array operations; 31 comparisons of the batch with a
shifted copy give all window counts. Texts are read whole.

Defined results: a null text is empty; an empty text has an empty digest (likeness 1 to another empty one, 0
to any other); a text under 32 bytes is one feature; equal texts have equal fingerprints. Documents are
ordered by id, then text, nulls first; after the last comes the first. Repeated rows are documents each. A
table with one row compares the document with itself.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, read

WIDTH, RUN, VOTES = 32, 32, 8
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Entropy in bits of a window of natural text, and the least of a window that can be a feature at all.
TYPICAL, LEAST = 3.5, 1.2
#: Share of the possible overlap that chance may give, below which likeness is 0.
FLOOR = 0.2
BATCH_BYTES = 1 << 20

_SCALE = 1 << 12
_F = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WIDTH + 1)], np.int64)
_GAIN = np.diff(_F, prepend=0)  # _GAIN[c]: what the c-th equal byte adds
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def _counts(t: np.ndarray):
    """For each byte: equals among itself and those before it in a window, and itself and those after it."""
    back, ahead = np.ones(len(t), np.uint8), np.ones(len(t), np.uint8)
    step = 1 << 15
    for a in range(0, len(t), step):
        lo, hi = max(0, a - WIDTH + 1), min(len(t), a + step)
        x = t[lo:hi]
        for d in range(1, min(WIDTH, len(x))):
            same = (x[d:] == x[:-d]).view(np.uint8)
            cut = max(0, a - lo - d)  # pairs whose later byte lies before a were counted with the chunk before
            same = same[cut:]
            back[lo + d + cut : hi] += same
            ahead[lo + cut : hi - d] += same
    return back, ahead


def _mix(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 64-bit words."""
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _MIX[k]
        h ^= h >> np.uint64(29)
    h *= _MIX[0]
    return h ^ (h >> np.uint64(32))


def _select(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of the features of each text, in order."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for i, x in enumerate(texts):
        if 0 < len(x) < WIDTH:
            out[i] = _mix(np.frombuffer(x.ljust(WIDTH - 1, b"\0") + bytes([len(x)]), "<u8")[None, :])
    long = np.flatnonzero(sizes >= WIDTH)
    if not len(long):
        return out
    t = np.frombuffer(b"".join(texts), np.uint8)
    back, ahead = _counts(t)
    # sum of c log c over the window that starts at s: from window to window one byte leaves and one comes
    moved = np.zeros(len(t) - WIDTH + 1, np.int64)
    np.cumsum(_GAIN[back[WIDTH:]] - _GAIN[ahead[: len(t) - WIDTH]], out=moved[1:])
    first = t[starts[long][:, None] + np.arange(WIDTH)]
    base = np.zeros(len(long), np.int64)
    for k in range(WIDTH):
        base += _GAIN[(first[:, : k + 1] == first[:, k : k + 1]).sum(axis=1)]
    n_windows = sizes[long] - WIDTH + 1
    shift = np.repeat(base - moved[starts[long]], n_windows)
    at = np.repeat(starts[long] - np.concatenate(([0], np.cumsum(n_windows)))[:-1], n_windows) + np.arange(n_windows.sum())
    entropy = np.log2(WIDTH) - (moved[at] + shift) / (_SCALE * WIDTH)
    rank = np.where(entropy >= LEAST, np.abs(entropy - TYPICAL) * 4096 + 1, 0).astype(np.int64)
    # key: rarest first, then leftmost; positions in the list of windows
    n = len(at)
    key = (rank << 32) | (0xFFFFFFFF - np.arange(n, dtype=np.int64))
    best, width = key, 1
    while width < RUN:
        best = np.maximum(best, np.concatenate((best[width:], best[-1:].repeat(min(width, n)))))[:n] if n > width else best
        width *= 2
    ends = np.cumsum(n_windows)
    begin = ends - n_windows
    runs = np.maximum(n_windows - RUN + 1, 0)
    valid = np.repeat(begin - np.concatenate(([0], np.cumsum(runs)))[:-1], runs) + np.arange(runs.sum())
    votes = np.bincount(0xFFFFFFFF - (best[valid] & 0xFFFFFFFF), minlength=n)
    chosen = (votes >= VOTES) & (rank > 0)
    # texts of few windows, of split votes or of low entropy alone: the rarest window stands for the text
    for i in np.flatnonzero(np.add.reduceat(chosen, begin) == 0):
        chosen[begin[i] + int(key[begin[i] : ends[i]].argmax())] = True
    picks = np.flatnonzero(chosen)
    hashes = np.zeros(len(picks), np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(t, WIDTH)
    for a in range(0, len(picks), 1 << 14):
        hashes[a : a + (1 << 14)] = _mix(np.ascontiguousarray(windows[at[picks[a : a + (1 << 14)]]]).view("<u8"))
    cuts = np.searchsorted(picks, ends)
    for i, h in zip(long, np.split(hashes, cuts[:-1]), strict=True):
        out[i] = h
    return out


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """The Bloom filters of each text, as rows of 32 64-bit words."""
    out = []
    for h in _select(texts):
        n = -(-len(h) // PER_FILTER)
        bits = np.zeros((n, FILTER_BITS), np.uint8)
        row = np.arange(len(h)) // PER_FILTER
        for k in range(HASHES):
            bits[row, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(n, FILTER_BITS // 64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    score = np.zeros(len(a))
    for i in range(len(a)):
        shared = np.bitwise_count(a[i] & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(na[i], nb)
        floor = np.minimum(na[i] * nb / FILTER_BITS, most - 1)
        floor = floor + FLOOR * (most - floor)
        # filters of unequal fill are alike only as far as the fuller one is shared, too
        fill = most / np.maximum(na[i], nb)
        score[i] = (np.clip((shared - floor) / (most - floor), 0, 1) * fill).max()
    return float(np.average(score, weights=na))


def encode(d: np.ndarray) -> str:
    return f"{len(d)}:{base64.b64encode(d.tobytes()).decode()}"


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of what follows."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt into ranges of ids; the first document of each range also goes to the range before
    it, so neighbours meet without a global sort in one task.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    n = max(1, partitions(docs.sparkSession))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    b = F.coalesce(F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: F.col("doc_id") > c)), F.lit(0)) if cuts else F.lit(0)
    ranged = docs.withColumn("b", F.when(F.col("doc_id").isNull(), 0).otherwise(b))
    firsts = ranged.groupBy("b").agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("first")).orderBy("b").collect()
    before = [(r["b"], firsts[i - 1]["b"], r["nulls"] > 0, r["first"]) for i, r in enumerate(firsts)]
    # one row a range: range, the range before it, whether its first id is null, its first id
    table = docs.sparkSession.createDataFrame(before, f"b int, prior int, head_null boolean, head {kind}")
    marked = ranged.join(F.broadcast(table), "b")
    is_head = F.when(F.col("head_null"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("head"))
    homes = F.when(is_head, F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("g")), F.struct(F.col("prior").alias("b"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("g"))))
    rows = marked.select("doc_id", "text", F.explode(homes).alias("h")).select("h.b", "h.g", "doc_id", "text")
    ordered = rows.repartition(n, "b").sortWithinPartitions("b", "g", F.asc_nulls_first("doc_id"), "text")

    # ids travel as text: pandas would turn numbers beside nulls into doubles
    ordered = ordered.withColumn("doc_id", F.col("doc_id").cast("string"))

    def run(batches):
        held: list[tuple] = []  # (id, text) of the range being read, the last one still without its follower
        state = {"b": None, "guest": False}

        def emit(pairs):
            texts = [x.encode() for _, t, f in pairs for x in (t, edit(t, f))] + [pairs[-1][2].encode()]
            found: list = []
            group, size = [], 0
            for x in texts:
                group.append(x)
                size += len(x)
                if size >= BATCH_BYTES:
                    found += digests(group)
                    group, size = [], 0
            found += digests(group)
            out = []
            for i, (key, t, _) in enumerate(pairs):
                own, edited = found[2 * i], found[2 * i + 1]
                nxt = found[2 * i + 2]
                out.append((key, len(t), hashlib.sha256(texts[2 * i + 1]).hexdigest(), encode(own), encode(edited), likeness(own, edited), likeness(own, nxt)))
            return pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for d in batches:
            pairs, size = [], 0
            for b, g, key, text in zip(d["b"], d["g"], d["doc_id"], d["text"], strict=True):
                if b != state["b"]:
                    state["b"], state["guest"] = b, False
                    held.clear()
                if g and state["guest"]:
                    continue  # only the first of several equal ids follows
                if held:
                    pairs.append((*held.pop(), text))
                    size += len(pairs[-1][1]) * 2
                if g:
                    state["guest"] = True
                else:
                    held.append((key, text))
                if size >= BATCH_BYTES:
                    yield emit(pairs)
                    pairs, size = [], 0
            if pairs:
                yield emit(pairs)

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))
