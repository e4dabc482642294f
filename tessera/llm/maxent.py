"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

A token is a word or the end of a text. The most frequent words are dealt by rank into classes of equal
size; all other words fall into classes by their last two bytes. P(token | context) = P(class | context) *
P(token | class, context). Both factors are softmaxes over sums of weight rows picked by hashed features of
the context: the word before, the two words before, and skips to the second and third word before. Inside a
class of infrequent words, probability goes by smoothed counts, so the whole is a distribution over the
known words and one unknown word a class.

The weight tables have a row for every ``PER_ROW`` distinct contexts of the training texts, ``ROWS`` at least, so
contexts share rows no more in a large corpus than in a small one.

Training starts from the unigram distribution. In each round every partition runs stochastic gradient steps
over its share of the training texts; the changes of the rows it touched are summed over partitions, block by
block in two levels, and averaged by the number of tokens that touched a row. All training texts are read once
over the rounds. The model (as large as its tables) and the ``HOT`` most frequent words (a documented bound) are
broadcast; counts of any other word reach the texts that hold it through a join, so counts and scores are exact
for every word.

Defined results: a null text is empty and has one token, its end; without training texts every base score
is 0; repeated rows are texts each, and count in training each time. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read

FREQUENT, MEMBERS, RARE = 48, 32, 16
CLASSES = FREQUENT + RARE
#: Least rows of a weight table, and the distinct contexts for which there is a row.
ROWS, PER_ROW = 1 << 14, 2048
#: Least hashes kept to estimate how many contexts are distinct.
KEPT = 4096
HOT = 1 << 17
ROUNDS = 2
RATE, BATCH = 0.35, 4096
#: Tokens scored together: their rows stay in a core's cache.
PART = 1024
PAD = 3
END = b"\n"  # no word holds white space
_BLOCK = 256
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_UNSEEN = 1 << 40  # ids of words outside the hot list begin here
#: Bytes of texts laid out together, of words compared as two numbers, and bits of a place in their table.
CHUNK, SHORT, PLACES = 1 << 19, 15, 19
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def rare_class(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-2:]) % RARE


class Table:
    """Places of the words of up to SHORT bytes in a list, by all their bytes and their size as two numbers."""

    def __init__(self, words: list[bytes]):
        which = np.array([i for i, w in enumerate(words) if len(w) <= SHORT], np.int64)
        self.keys = np.zeros((2, len(words) + 1), np.uint64)  # the last is no word's
        if len(which):
            raw = b"".join([words[i].ljust(SHORT, b"\0") + bytes([len(words[i])]) for i in which.tolist()])
            self.keys[:, which] = np.frombuffer(raw, "<u8").reshape(-1, 2).T
        self.slots = np.full(1 << max(PLACES, 2 + len(words).bit_length()), -1, np.int32)
        at = self._slot(*self.keys[:, which])
        while len(which):
            free = self.slots[at] < 0
            self.slots[at[free]] = which[free]
            lost = self.slots[at] != which
            which, at = which[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        return (mixed(k1, k2) >> np.uint64(65 - len(self.slots).bit_length())).view(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Places of words by their two numbers, -1 for those that are not in the list."""
        at = self._slot(k1, k2)
        out = self.slots.take(at)
        left = np.flatnonzero((self.keys[0].take(out) != k1) | (self.keys[1].take(out) != k2))
        while len(left := left[out[left] >= 0]):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            out[left] = got = self.slots[at[left]]
            left = left[(self.keys[0][got] != k1[left]) | (self.keys[1][got] != k2[left])]
        return out.astype(np.int64)


def mixed(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    h = k1 * _K[0] ^ k2 * _K[1]
    h ^= h >> np.uint64(32)
    h *= _K[2]
    return h


def split(texts: list[bytes]):
    """The words of ``texts``: all bytes in lower case, where words begin and end in them, their two numbers (those of longer
    words stand for a part of them), and how many words each text has."""
    raw = b"\n".join(texts).lower() + b" " * 17
    ink = _INK.take(np.frombuffer(raw, np.uint8))
    edges = np.flatnonzero(ink[1:] != ink[:-1]) + 1
    if ink[0]:
        edges = np.concatenate(([0], edges))
    first, last = edges[::2], edges[1::2]
    n = last - first
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # eight bytes from each place on
    k1 = eight[first] & _MASK.take(np.minimum(n, 8))
    k2 = eight[first + 8] & _MASK.take(np.clip(n - 8, 0, 7)) | n.astype(np.uint64) << np.uint64(56)
    words = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    return raw, first, last, k1, k2, np.diff(words, prepend=0)


class Vocabulary:
    """The hot words by falling count; the first FREQUENT * MEMBERS are modelled one by one."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rare_mass: np.ndarray, total: int, distinct: int):
        n = FREQUENT * MEMBERS
        self.ids = {w: i for i, w in enumerate(words)}
        self.counts = counts.astype(np.int64)
        self.total, self.distinct = total, distinct
        self.classes = np.array([i // MEMBERS if i < n else rare_class(w) for i, w in enumerate(words)], np.int64)
        #: sum of count + 0.5 of the words of each infrequent class, and 0.5 for an unknown one
        self.rare_mass = rare_mass + 0.5
        self.base = np.log10((self.counts + 0.5) / (total + 0.5 * (distinct + 1)))
        own = np.zeros(n)
        own[: min(n, len(words))] = self.counts[:n] + 0.5
        own = own.reshape(FREQUENT, MEMBERS)
        mass = np.concatenate((own.sum(axis=1), self.rare_mass))
        self.table = Table(words)
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(mass / mass.sum()), -60).astype(np.float32)
            self.word_bias = np.maximum(np.log(own / np.maximum(own.sum(axis=1, keepdims=True), 1e-9)), -60).astype(np.float32)

    def lay_out(self, texts: list[bytes]):
        """Ids and classes of all tokens of ``texts``, the texts' tokens, and the places and words of those that are not hot,
        whose ids are hashes."""
        raw, first, last, k1, k2, words = split(texts)
        found = self.table.find(k1, k2)
        for i in np.flatnonzero(last - first > SHORT).tolist():
            found[i] = self.ids.get(raw[first[i] : last[i]], -1)
        lengths = words + 1
        ends = np.cumsum(lengths) - 1
        at = np.arange(len(found)) + np.repeat(np.arange(len(texts)), lengths - 1)
        out = np.full(len(found) + len(texts), self.ids.get(END, -1), np.int64)
        out[at] = found
        unseen = np.flatnonzero(found < 0)
        rare, where = [raw[a:b] for a, b in zip(first[unseen].tolist(), last[unseen].tolist(), strict=True)], at[unseen]
        if END not in self.ids:
            where = np.concatenate((where, ends))
            order = np.argsort(where)
            rare, where = [(rare[i] if i < len(rare) else END) for i in order.tolist()], where[order]
        cls = self.classes.take(out, mode="clip") if len(self.classes) else np.zeros(len(out), np.int64)
        out[where] = np.fromiter(map(zlib.crc32, rare), np.int64, len(rare)) + _UNSEEN
        cls[where] = np.fromiter(map(rare_class, rare), np.int64, len(rare))
        return out, cls, lengths, where, rare


def contexts(ids: np.ndarray) -> np.ndarray:
    """Feature hashes by token, for ids that have PAD pads before each text; the first PAD rows are void."""
    u = ids.astype(np.uint64)
    w1, w2, w3 = (np.concatenate((np.zeros(k, np.uint64), u[:-k])) for k in (1, 2, 3))
    f = np.stack([w1 * _K[0] + np.uint64(1), w1 * _K[1] + w2 * _K[2] + np.uint64(2), w2 * _K[0] + np.uint64(3), w3 * _K[0] + np.uint64(4)])
    f ^= f >> np.uint64(31)
    f *= _K[3]
    return f ^ (f >> np.uint64(29))


def segment_sums(rows: np.ndarray, grad: np.ndarray):
    """Distinct rows, their counts and the sums of their gradients. Rows of the least table fit 16 bits, which
    sort fast; short segments are added up side by side, long ones one by one."""
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    n = np.diff(first, append=len(rows))
    out = grad.take(order[first], axis=0, mode="clip")
    for j in np.flatnonzero(n > 8).tolist():
        grad.take(order[first[j] : first[j] + n[j]], axis=0, mode="clip").sum(axis=0, out=out[j])
    few, k = np.flatnonzero((n > 1) & (n <= 8)), 1
    while len(few):
        out[few] += grad.take(order[first[few] + k], axis=0, mode="clip")
        k += 1
        few = few[n[few] > k]
    return ranked[first], n, out


def sum_rows(table: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The sums of the rows picked by each feature. No row is out of range; "clip" only lets ``take`` write in place."""
    out = table.take(picked[0], axis=0, mode="clip")
    part = np.empty_like(out)
    for r in picked[1:]:
        table.take(r, axis=0, out=part, mode="clip")
        out += part
    return out


def softmax(scores: np.ndarray, out: np.ndarray | None = None):
    """Exponentials and their sums by row; scores that would overflow are shifted in place first."""
    e = np.exp(scores, out=out)
    s = np.einsum("ij->i", e)
    if len(s) and not (np.isfinite(s).all() and s.min() > 1e-30):
        scores -= scores.max(axis=1, keepdims=True)
        e = np.exp(scores, out=out)
        s = np.einsum("ij->i", e)
    return e, s


class Model:
    def __init__(self, vocabulary: Vocabulary, rows: int = ROWS):
        self.v = vocabulary
        self.shift = np.uint64(65 - rows.bit_length())  # ``rows`` is a power of two
        self.by_class = np.zeros((rows, CLASSES), np.float32)
        self.by_word = np.zeros((rows, MEMBERS), np.float32)

    def forward(self, f: np.ndarray, cls: np.ndarray):
        """Rows and scores of the class factor, and of the member factor where the class is frequent."""
        rows = (f >> self.shift).view(np.int64)
        z = sum_rows(self.by_class, rows)
        z += self.v.class_bias
        own = np.flatnonzero(cls < FREQUENT)
        c = cls[own]
        g = f.take(own, axis=1)
        g += c.astype(np.uint64) * _K[2]
        g *= _K[1]
        g >>= self.shift
        member_rows = g.view(np.int64)
        y = sum_rows(self.by_word, member_rows)
        y += self.v.word_bias.take(c, axis=0)
        return rows, z, own, member_rows, y

    def log10(self, ids: np.ndarray, f: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural-order log10 probability of each token, but for the count of words outside the hot list."""
        _, z, own, _, y = self.forward(f, cls)
        (_, zs), (_, ys) = softmax(z), softmax(y)
        out = (z[np.arange(len(ids)), cls] - np.log(zs)).astype(np.float64)
        out[own] += y[np.arange(len(own)), ids[own] % MEMBERS] - np.log(ys)
        out /= np.log(10)
        rare = np.flatnonzero(cls >= FREQUENT)
        out[rare] -= np.log10(self.v.rare_mass[cls[rare] - FREQUENT])
        hot = rare[ids[rare] < _UNSEEN]
        out[hot] += np.log10(self.v.counts[ids[hot]] + 0.5)
        return out

    def step(self, ids, f, cls, squares, touched) -> None:
        """One gradient step on a batch, with a rate for each row by the gradients it has seen."""
        g = np.empty((len(ids), CLASSES), np.float32)
        h = np.empty((np.count_nonzero(cls < FREQUENT), MEMBERS), np.float32)
        rows, member_rows, b = [], [], 0
        for a in range(0, len(ids), PART):
            r, z, own, q, y = self.forward(f[:, a : a + PART], cls[a : a + PART])
            u, w = g[a : a + PART], h[b : b + len(own)]
            (_, zs), (_, ys) = softmax(z, u), softmax(y, w)
            u *= (-1 / zs)[:, None]
            u[np.arange(len(u)), cls[a : a + PART]] += 1
            w *= (-1 / ys)[:, None]
            w[np.arange(len(w)), ids[a + own] % MEMBERS] += 1
            rows, member_rows, b = [*rows, r], [*member_rows, q], b + len(own)
        rows, member_rows = np.concatenate(rows, axis=1), np.concatenate(member_rows, axis=1)
        for table, part, grad, seen, hit in ((self.by_class, rows, g, squares[0], touched[0]), (self.by_word, member_rows, h, squares[1], touched[1])):
            for r in part:
                if not len(r):
                    continue
                which, n, total = segment_sums(r, grad)
                hit[which] += n
                sizes = seen[which] + np.einsum("ij,ij->i", total, total) / total.shape[1]
                seen[which] = sizes
                total *= (RATE / np.sqrt(sizes + 1.0))[:, None]
                total += table.take(which, axis=0, mode="clip")
                table[which] = total


def _spread(found: np.ndarray, lengths: np.ndarray):
    """Ids with pads before each text, and where the tokens are."""
    where = np.arange(len(found)) + PAD * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    ids = np.full(len(found) + PAD * len(lengths), _UNSEEN - 1, np.int64)
    ids[where] = found
    return ids, where


def _batches(texts, v: Vocabulary, size: int):
    """Groups of texts of about ``size`` tokens: ids with pads, where the tokens are, their classes, the texts' tokens, and
    the words that are not hot."""
    group, n = [], 0
    for t in texts:
        group.append((t or "").encode())
        n += len(group[-1])
        if n >= CHUNK:
            group, n = (yield from _cut(group, v, size, False)), 0
    if group:
        yield from _cut(group, v, size, True)


def _cut(texts: list[bytes], v: Vocabulary, size: int, whole: bool):
    """The groups of ``texts``; those that do not fill one are returned, to be laid out with the texts that follow."""
    found, cls, lengths, where, rare = v.lay_out(texts)
    ends = np.cumsum(lengths)
    i = a = 0
    while i < len(texts):
        j = int(np.searchsorted(ends, a + size)) + 1
        if j > len(texts) and not whole and sum(map(len, texts[i:])) < CHUNK:
            break
        j = min(j, len(texts))
        b = int(ends[j - 1])
        x, y = np.searchsorted(where, (a, b))
        yield *_spread(found[a:b], lengths[i:j]), cls[a:b], lengths[i:j], rare[x:y]
        i, a = j, b
    return texts[i:]


def _chunks(texts):
    """Lists of texts of about CHUNK bytes."""
    group, n = [], 0
    for t in texts:
        group.append((t or "").encode())
        n += len(group[-1])
        if n >= CHUNK:
            yield group
            group, n = [], 0
    if group:
        yield group


def survey(docs: DataFrame) -> DataFrame:
    """One pass over ``docs``: w, c of every token, counted in the partitions first (h null), and each partition's least
    hashes h of contexts (w null), in which words are known by hashes of their own."""

    def run(parts):
        seen: Counter = Counter()
        least = np.zeros(0, np.int64)
        # words met before are counted in an array, by a table that is made anew after 1, 4, 16, ... chunks
        words: list[bytes] = []
        table, tally, chunks, renew = Table(words), np.zeros(0, np.int64), 0, 1
        for texts in (x for d in parts for x in _chunks(d["text"])):
            raw, first, last, k1, k2, n = split(texts)
            found = table.find(k1, k2)
            long = np.flatnonzero(last - first > SHORT)
            found[long] = -1
            tally += np.bincount(found[found >= 0], minlength=len(words))
            new = np.flatnonzero(found < 0)
            seen.update([raw[a:b] for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)])
            seen[END] += len(texts)
            h = mixed(k1, k2)
            h[long] = [zlib.crc32(raw[first[i] : last[i]]) for i in long.tolist()]
            ends = np.cumsum(n + 1) - 1
            ids = np.full(len(h) + len(texts), zlib.crc32(END), np.int64)
            ids[np.delete(np.arange(len(ids)), ends)] = h.view(np.int64)
            ids, where = _spread(ids, n + 1)
            least = _least(least, contexts(ids)[:, where])
            chunks += 1
            if chunks == renew:
                seen.update(dict(zip(words, tally.tolist(), strict=True)))
                words = [w for w, c in seen.items() if c > 1 and len(w) <= SHORT][:HOT]
                table, tally, renew = Table(words), np.array([seen.pop(w) for w in words], np.int64), 4 * renew
            if len(seen) > 400_000:
                yield pd.DataFrame({"w": list(seen), "h": None, "c": list(seen.values())})
                seen.clear()
        seen.update(dict(zip(words, tally.tolist(), strict=True)))
        yield pd.DataFrame({"w": list(seen), "h": None, "c": list(seen.values())})
        yield pd.DataFrame({"w": None, "h": least, "c": 1})

    return docs.select("text").mapInPandas(run, "w binary, h long, c long").groupBy("w", "h").agg(F.sum("c").alias("c"))


def words_of(found: DataFrame) -> DataFrame:
    return found.where("w is not null").select("w", "c")


def count_tokens(docs: DataFrame) -> DataFrame:
    """w, c of every token of ``docs``."""
    return words_of(survey(docs))


def hot_words(counts: DataFrame, limit: int = HOT) -> Vocabulary:
    classed = counts.withColumn("k", F.floor(16 * F.log2("c")).cast("int"))
    left, cut = limit, 0
    total = distinct = 0
    rows = classed.groupBy("k").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    for r in sorted(rows, key=lambda r: -r["k"]):
        total, distinct = total + r["c"], distinct + r["n"]
        if r["n"] > left:
            cut, left = max(cut, r["k"] + 1), 0
        left -= r["n"]
    found = classed.where(F.col("k") >= cut).select("w", "c").toPandas().sort_values(["c", "w"], ascending=[False, True])
    words, c = [bytes(w) for w in found["w"]], found["c"].to_numpy(np.int64)
    # words that are modelled one by one leave the mass of the infrequent classes
    j = (F.crc32(F.substring("w", -2, 2)) % RARE).cast("int")
    mass = np.zeros(RARE)
    for r in counts.groupBy(j.alias("j")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        mass[r["j"]] = r["m"]
    for w, n in zip(words[: FREQUENT * MEMBERS], c, strict=False):
        mass[rare_class(w) - FREQUENT] -= n + 0.5
    return Vocabulary(words, c, np.maximum(mass, 0), int(total), int(distinct))


def _least(least: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The least hashes among ``least`` and those of contexts ``f``."""
    h = (f.ravel() >> np.uint64(1)).view(np.int64)  # contexts are hashes already
    if len(least) == KEPT:
        h = h[h < least[-1]]
    return np.unique(np.concatenate((least, h)))[:KEPT] if len(h) else least


def contexts_of(found: DataFrame) -> int:
    """About how many contexts are distinct, by all partitions' least hashes h; exact for few."""
    rows = found.where("h is not null").select("h").distinct().orderBy("h").limit(KEPT).collect()
    return len(rows) if len(rows) < KEPT else int((KEPT - 1) / ((rows[-1]["h"] + 1) / 2.0**63))


def count_contexts(docs: DataFrame, v: Vocabulary) -> int:
    """About how many contexts of ``docs`` are distinct, in a pass of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(parts):
        least = np.zeros(0, np.int64)
        for d in parts:
            for ids, where, _, _, _ in _batches(d["text"], shared.value, 4 * BATCH):
                least = _least(least, contexts(ids)[:, where])
        yield pd.DataFrame({"h": least})

    n = contexts_of(docs.select("text").mapInPandas(run, "h long"))
    shared.unpersist()
    return n


def table_rows(n_contexts: int) -> int:
    return max(ROWS, 1 << max(0, -(-n_contexts // PER_ROW) - 1).bit_length())


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS, n_contexts: int | None = None) -> Model:
    """``n_contexts``: how many contexts of ``docs`` are distinct, if a survey has told it."""
    spark = docs.sparkSession
    model = Model(v, table_rows(count_contexts(docs, v) if n_contexts is None else n_contexts))
    rows = len(model.by_class)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        share = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k) if rounds > 1 else docs

        def run(parts, shared=shared):
            m = shared.value
            before = [m.by_class, m.by_word]
            m = Model(m.v, rows)
            m.by_class, m.by_word = (x.copy() for x in before)
            squares = [np.zeros(rows, np.float32) for _ in range(2)]
            touched = [np.zeros(rows, np.float32) for _ in range(2)]
            for d in parts:
                for ids, where, cls, _, _ in _batches(d["text"], m.v, BATCH):
                    m.step(ids[where], contexts(ids)[:, where], cls, squares, touched)
            part = TaskContext.get().partitionId() // 64
            out = []
            for t, (a, b) in enumerate(zip((m.by_class, m.by_word), before, strict=True)):
                hit = np.flatnonzero(touched[t])
                for at in np.split(hit, np.flatnonzero(np.diff(hit // _BLOCK)) + 1) if len(hit) else ():
                    n = touched[t][at]
                    out.append((t, int(at[0]) // _BLOCK * _BLOCK, part, (at % _BLOCK).astype(np.uint8).tobytes(), n.tobytes(), ((a[at] - b[at]) * n[:, None]).tobytes()))
            yield pd.DataFrame(out, columns=["t", "i", "part", "at", "n", "d"])

        def add(d: pd.DataFrame) -> pd.DataFrame:
            n, c = np.zeros(_BLOCK), np.zeros((_BLOCK, (CLASSES, MEMBERS)[d["t"].iloc[0]]))
            for at, own, change in zip(d["at"], d["n"], d["d"], strict=True):
                at = np.frombuffer(at, np.uint8)
                n[at] += np.frombuffer(own, np.float32)
                c[at] += np.frombuffer(change, np.float32).reshape(len(at), -1)
            at = np.flatnonzero(n)
            return pd.DataFrame({"t": d["t"][:1], "i": d["i"][:1], "part": d["part"][:1], "at": [at.astype(np.uint8).tobytes()], "n": [n[at].astype(np.float32).tobytes()], "d": [c[at].astype(np.float32).tobytes()]})

        kind = "t int, i int, part int, at binary, n binary, d binary"
        sums = share.select("text").mapInPandas(run, kind).groupBy("t", "i", "part").applyInPandas(add, kind)
        sums = sums.groupBy("t", "i").applyInPandas(add, kind)
        for r in sums.toLocalIterator():  # blocks of the model
            table = (model.by_class, model.by_word)[r["t"]]
            n = np.frombuffer(r["n"], np.float32)
            d = np.frombuffer(r["d"], np.float32).reshape(len(n), -1)
            table[r["i"] + np.frombuffer(r["at"], np.uint8).astype(np.int64)] += d / np.maximum(n, 1)[:, None]
        shared.unpersist()
    return model


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """All tokens of every text: doc_id, n_tokens, n_known, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts):
        m = shared.value
        v = m.v
        base = (TaskContext.get().partitionId() << 36) - 1
        for d in parts:
            keys = iter(d["doc_id"])
            out = []
            for ids, where, cls, lengths, words in _batches(d["text"], v, 4 * BATCH):
                found = ids[where]
                f = contexts(ids)[:, where]
                p = np.concatenate([m.log10(found[a : a + PART], f[:, a : a + PART], cls[a : a + PART]) for a in range(0, len(found), PART)])
                hot = found < _UNSEEN
                b = np.zeros(len(found))
                b[hot] = v.base[found[hot]]
                a = x = 0
                for n in lengths:
                    base += 1
                    s = slice(a, a + n)
                    known = int(hot[s].sum())
                    rare = Counter(words[x : x + int(n) - known])
                    out.append((next(keys), base, int(n), known, float(b[s].sum()), float(p[s].sum()), list(rare), list(rare.values())))
                    a, x = a + n, x + int(n) - known
            yield pd.DataFrame(out, columns=["doc_id", "key", "n_tokens", "n_hot", "hot_base", "part", "w", "tf"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, key long, n_tokens long, n_hot long, hot_base double, part double, w array<binary>, tf array<long>")
    rows = materialize(rows, "lm-scored")
    pairs = rows.select("key", F.explode(F.arrays_zip("w", "tf")).alias("x")).select("key", "x.w", "x.tf")
    known = pairs.join(counts, "w", "left").groupBy("key").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum("tf").alias("n"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("seen")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    below = float(np.log10(model.v.total + 0.5 * (model.v.distinct + 1)))
    return rows.join(known, "key", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", (F.col("n_hot") + zero("seen")).alias("n_known"),
        (F.col("hot_base") + zero("logs") - zero("n") * below).alias("base_score"), (F.col("part") + zero("logs")).alias("score"),
    )


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    training = docs.where(~held_out())
    found = materialize(survey(training), "lm-counts")
    counts = words_of(found)
    v = hot_words(counts)
    out = score(docs, train(training, v, n_contexts=contexts_of(found)), counts)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("bigint").alias("train_tokens"), "base_score", "score")
