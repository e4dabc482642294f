"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also begins elsewhere.

Sorting every suffix of a corpus is not needed to find long repeats. Each window of LENGTH bytes has an
anchor: its short string of least hash, the first of equals. Equal windows have equal anchors at equal
places, so runs of windows with one anchor (pieces) are compared with pieces of the same anchor only; an anchor that
occurs once has no repeats. Equal pieces are one string with a weight (counted by hash, with map-side combine). The
strings are dealt by anchor into buckets of bounded size; each bucket's shards get Burrows-Wheeler transforms, which
are merged by interleave refinement (bwt.py), and intervals whose common prefix reaches LENGTH and that hold a weight
of two or more give the repeated windows.
An anchor with more than ``CROWD`` different pieces would not fit a bucket. Its windows are counted by 128-bit
hash instead, which is exact as well and falls on no one task: first blocks of ``BLOCK`` neighbouring windows by
the bytes all of them share (found once: none repeats) and by all their bytes (found twice: all repeat), then
single windows of the blocks that are left, which are those at the edge of what is shared.

Defined results: null texts are empty and have nothing to remove; texts under LENGTH bytes stay whole;
repeated rows are documents each, so their windows repeat; matches never cross documents; an empty table
gives no rows. Texts are UTF-8 and read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bwt import repeated, rolling
from tessera.llm.common import discard, materialize, plus, read, trim

LENGTH, ANCHOR = 400, 32
#: Symbols of a string of the length asked for; a shard's suffixes are ordered by as many.
SYMBOLS = 4
#: The pipeline's stage: passages of over 50 words, whose repeats are sought by strings of 200 bytes, four to a word.
STAGE_LENGTH, STAGE_WORDS = 200, 50
#: Different pieces of one anchor that a bucket takes, and bytes of pieces in a bucket.
CROWD, BUCKET_BYTES = 512, 1 << 20
#: Windows counted together first under crowded anchors, and pieces taken apart at a time.
BLOCK, FEW = 16, 100
BATCH_BYTES = 1 << 20
_POSITION = np.uint64((1 << 26) - 1)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    w = 1
    while 2 * w <= width:
        key = np.minimum(key[:-w], key[w:])
        w *= 2
    return np.minimum(key[: len(key) - (width - w)], key[width - w :])


def pieces(texts: list[bytes], length: int = LENGTH):
    """(text, first window, last window, place of the anchor in the piece, anchor hash) of every piece, as arrays."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
    t = np.frombuffer(b"".join(texts), np.uint8)
    if not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = rolling(t, ANCHOR)
    at = _least((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), length - ANCHOR + 1) & _POSITION
    n = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(texts)), n)
    window = np.repeat(starts - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
    anchor = at[window].astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(which, prepend=-1) != 0))
    last = np.append(cut[1:], len(window)) - 1
    return which[cut], window[cut] - starts[which[cut]], window[last] - starts[which[cut]], anchor[cut] - window[cut], h[anchor[cut]]


def _groups(texts, length: int = LENGTH):
    """Batches of about BATCH_BYTES as (first index, texts); a longer text comes in overlapping parts with its offset."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), 1 << 24):
            group.append((i, a, t[a : a + (1 << 24) + length - 1] if len(t) > (1 << 24) else t))
            size += len(group[-1][2])
            if size >= BATCH_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _key(docs: DataFrame):
    """128 bits that tell documents apart; rows repeated whole share them, and all their windows."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")))


def find_pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs``: key, text. key, at (first window), more (windows after it), lead (bytes before the anchor), anchor, e1, e2 (128-bit hash of the piece)."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for d in batches:
            keys = list(d["key"])
            for group in _groups([t.encode() for t in d["text"]], length):
                which, a, b, lead, h = pieces([t for _, _, t in group], length)
                views = [memoryview(t) for _, _, t in group]
                hashes = b"".join([digest(views[w][x : y + length]) for w, x, y in zip(which.tolist(), a.tolist(), b.tolist(), strict=True)])
                e = np.frombuffer(hashes, "<i8").reshape(-1, 2)
                offset = np.array([o for _, o, _ in group], np.int64)[which] if len(which) else a
                index = [group[w][0] for w in which.tolist()]
                yield pd.DataFrame({"key": [keys[i] for i in index], "at": a + offset, "more": (b - a).astype(np.int32), "lead": lead.astype(np.int32), "anchor": h.view(np.int64), "e1": e[:, 0], "e2": e[:, 1]})
        trim()

    return docs.mapInPandas(run, "key binary, at long, more int, lead int, anchor long, e1 long, e2 long")


def _runs(x: np.ndarray) -> list[dict]:
    """Sorted whole numbers as runs."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) != 1)
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(x[np.concatenate(([0], cut + 1))], x[np.append(cut, len(x) - 1)], strict=True)]


_RANGES = "array<struct<lo:int,hi:int>>"


def _slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The texts of pieces: ``wanted`` has key, at, more and others; one row a piece with its bytes."""
    cols = [c for c in wanted.columns if c not in ("key", "at", "more")]
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "more", *cols)).alias("asked"))
    asked = materialize(asked, "asked")
    once = docs.join(asked, "key")
    schema = plus(wanted.select("at", "more", *cols).schema, "piece", "binary")

    names = ["at", "more", *cols]

    def run(batches):
        seen: set = set()
        for d in batches:
            out: list = []
            for key, text, rows in zip(d["key"], d["text"], d["asked"], strict=True):
                if key in seen:  # rows repeated whole; what two tasks see twice is dropped in the bucket
                    continue
                seen.add(key)
                raw = text.encode()
                for x in rows:
                    a = x["at"]
                    out.append((*(x[c] for c in names), raw[a : a + x["more"] + length]))
                if len(out) > 4_000:
                    yield pd.DataFrame(out, columns=[*names, "piece"])
                    out = []
            yield pd.DataFrame(out, columns=[*names, "piece"])
        trim()

    return once.select("key", "text", "asked").mapInPandas(run, schema)


def _crowded(texts: DataFrame, length: int) -> DataFrame:
    """``texts``: anchor, e1, e2, piece, lead. The ranges of repeated windows of pieces of crowded anchors."""
    ident = ["anchor", "e1", "e2"]
    span = length - BLOCK + 1  # bytes that all windows of a block share

    def blocks(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for d in (b.iloc[i : i + FEW] for b in batches for i in range(0, len(b), FEW)):
            rows, cores, unions = [], [], []
            for anchor, e1, e2, piece, lead in zip(d["anchor"], d["e1"], d["e2"], d["piece"], d["lead"], strict=True):
                low = lead - (len(piece) - length)  # windows have low..lead bytes before the anchor
                for r in range(low // BLOCK, lead // BLOCK + 1):
                    a = lead - r * BLOCK
                    full = r * BLOCK >= low and (r + 1) * BLOCK - 1 <= lead
                    rows.append((anchor, e1, e2, r, full))
                    cores.append(digest(piece[a : a + span], r))
                    unions.append(digest(piece[a - BLOCK + 1 : a + length], r) if full else b"\0" * 16)
            out = pd.DataFrame(rows, columns=[*ident, "r", "full"])
            c, u = (np.frombuffer(b"".join(x), "<i8").reshape(-1, 2) for x in (cores, unions))
            yield out.assign(c1=c[:, 0], c2=c[:, 1], u1=u[:, 0], u2=u[:, 1])

    each = texts.mapInPandas(blocks, "anchor long, e1 long, e2 long, r int, full boolean, c1 long, c2 long, u1 long, u2 long")
    each = materialize(each, "blocks")
    shared = materialize(each.groupBy("c1", "c2").count().where("count > 1").select("c1", "c2"), "shared")
    alike = materialize(each.join(shared, ["c1", "c2"]).drop("c1", "c2"), "alike")
    unions = materialize(alike.where("full").groupBy("u1", "u2").agg(F.count("*").alias("n"), F.min(F.struct(*ident, "r")).alias("one")), "unions")
    settled = alike.where("full").join(unions.where("n > 1").select("u1", "u2"), ["u1", "u2"]).select(*ident, "r")
    # a block that is settled still stands for its windows, once
    edge = alike.where("not full").select(*ident, "r").union(unions.select("one.*"))
    asked = edge.groupBy(*ident).agg(F.collect_list("r").alias("rs"))

    def windows(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for d in (b.iloc[i : i + FEW] for b in batches for i in range(0, len(b), FEW)):
            rows, hashes = [], []
            for anchor, e1, e2, piece, lead, rs in zip(d["anchor"], d["e1"], d["e2"], d["piece"], d["lead"], d["rs"], strict=True):
                low = lead - (len(piece) - length)
                for r in rs:
                    for o in range(max(low, r * BLOCK), min(lead, (r + 1) * BLOCK - 1) + 1):
                        rows.append((anchor, e1, e2, lead - o))
                        hashes.append(digest(piece[lead - o : lead - o + length]))
            w = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pd.DataFrame(rows, columns=[*ident, "i"]).assign(w1=w[:, 0], w2=w[:, 1])

    single = texts.join(asked, ident).mapInPandas(windows, "anchor long, e1 long, e2 long, i int, w1 long, w2 long")
    single = materialize(single, "windows")
    twice = materialize(single.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"), "twice")
    lone = single.join(twice, ["w1", "w2"]).select(*ident, F.struct(F.col("i").alias("lo"), F.col("i").alias("hi")).alias("range"))
    place = texts.select(*ident, "lead")
    hi = F.col("lead") - F.col("r") * BLOCK
    blocked = settled.join(place, ident).select(*ident, F.struct((hi - BLOCK + 1).cast("int").alias("lo"), hi.cast("int").alias("hi")).alias("range"))
    return lone.union(blocked).groupBy(*ident).agg(F.collect_list("range").cast(_RANGES).alias("ranges"))


def repeats(docs: DataFrame, crowd: int = CROWD, length: int = LENGTH) -> DataFrame:
    """``docs``: key, text. key and spans (lo, hi: first and last window of ``length`` bytes) that also begin elsewhere."""
    found = materialize(find_pieces(docs, length), "pieces")
    ident = ["anchor", "e1", "e2"]
    kinds = found.groupBy(*ident).agg(F.count("*").alias("n"), F.min(F.struct("key", "at", "more", "lead")).alias("one"))
    kinds = materialize(kinds, "kinds")
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
    anchors = anchors.where(F.col("all") > 1).select("anchor", (F.col("kinds") > crowd).alias("crowded"))
    wanted = materialize(kinds.join(anchors, "anchor").select("one.*", "n", "crowded", *ident), "wanted")
    discard(kinds)
    texts = materialize(_slices(docs, wanted, length), "texts")

    light = texts.where("not crowded")
    total = light.agg(F.sum(F.length("piece"))).first()[0] or 0
    buckets = max(1, int(total // BUCKET_BYTES))

    def settle(d: pd.DataFrame) -> pd.DataFrame:
        # rows repeated whole share a key, and give a piece more than once
        d = d.drop_duplicates(ident).sort_values(ident, kind="stable")  # shards hold the same pieces whatever order they came in
        starts = repeated(list(d["piece"]), length, length // SYMBOLS, weights=d["n"].to_numpy(np.int64))
        out = d[ident].copy()
        out["ranges"] = [_runs(s) for s in starts]
        del starts
        trim()
        return out[(out["ranges"].str.len() > 0).to_numpy()]

    schema = f"anchor long, e1 long, e2 long, ranges {_RANGES}"
    by_bwt = light.withColumn("b", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).select("b", "n", "piece", *ident).groupBy("b").applyInPandas(settle, schema)

    heavy = texts.where("crowded").dropDuplicates(ident)
    by_hash = _crowded(heavy.select("piece", "lead", *ident), length)
    whole = heavy.where("n > 1").select(*ident, F.array(F.struct(F.lit(0).alias("lo"), (F.length("piece") - length).alias("hi"))).cast(_RANGES).alias("ranges"))
    settled = by_bwt.union(whole).union(by_hash.join(heavy.where("n = 1").select(*ident), ident, "left_semi"))
    settled = materialize(settled, "settled")
    discard(texts, wanted)
    spans = found.join(settled, ident).select("key", F.explode(F.transform("ranges", lambda r: F.struct((F.col("at") + r["lo"]).alias("lo"), (F.col("at") + r["hi"]).alias("hi")))).alias("s"))
    spans = materialize(spans.groupBy("key").agg(F.collect_list("s").alias("spans")), "spans")
    discard(found, settled)
    return spans


def _remove(raw: bytes, spans, length: int, words: int = 0) -> tuple[bytes, int]:
    """The bytes outside all windows from lo to hi, and how many runs went. Runs of ``words`` words or fewer stay."""
    if spans is None or not len(spans):
        return raw, 0
    runs: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"] + length) for x in spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    runs = [r for r in runs if not words or len(raw[r[0] : r[1]].split()) > words]
    cuts = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)), len(runs)


def dedup(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) as they are, with __kept (binary) and __runs (removed runs)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("__key", _key(docs))
    found = repeats(keyed.select(F.col("__key").alias("key"), text.alias("text")), length=length)
    joined = keyed.join(found.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left")
    schema = plus(plus(docs.schema, "__kept", "binary"), "__runs", "long")
    names = docs.columns

    def run(batches):
        for b in batches:
            out = [_remove((t or "").encode(), s, length, words) for t, s in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), strict=True)]
            more = [pa.array([k for k, _ in out], pa.binary()), pa.array([n for _, n in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more], [*names, "__kept", "__runs"])
        trim()

    return joined.select(*names, "__spans").mapInArrow(run, schema)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("__kept")).cast("bigint").alias("n_removed"), F.col("__runs").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the passages of over ``STAGE_WORDS`` words that repeat, found as strings of
    ``STAGE_LENGTH`` bytes that begin twice or more; every copy goes, and a character that lost some of its bytes goes
    whole. Null texts stay null; n_chars counts what is left."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            text = b.column("text").to_pylist()
            for i, (k, n) in enumerate(zip(b.column("__kept").to_pylist(), b.column("__runs").to_pylist(), strict=True)):
                if n:
                    text[i] = k.decode("utf-8", "ignore")
            cols = {c: b.column(c) for c in names} | {"text": pa.array(text, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([o if not n else len(t) for o, n, t in zip(b.column("n_chars").to_pylist(), b.column("__runs").to_pylist(), text, strict=True)], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return dedup(docs, STAGE_LENGTH, STAGE_WORDS).mapInArrow(run, schema)
