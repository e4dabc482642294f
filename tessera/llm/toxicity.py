"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon (strong and weak entries, found by their log-odds among the
labelled training rows), nearness of second-person words to lexicon hits, rates of capitals, punctuation
and obfuscation (letters mixed with digits or signs, and lexicon hits that show only after undoing them).
Trees are fitted on the driver to a bounded sample of labelled rows (``TRAIN_ROWS``, a documented limit);
equal texts with equal labels are one row, every other labelled text is a row of its own. The calibration is
fitted to margins of trees and lexicons that did not see the row (three folds, near copies mostly in one), so all
rows serve both.
Scoring reads every text whole.

Learning uses only rows whose crc32(doc_id as text) mod 4 is not 2. Labels, language, source and id are
never inputs of a score. Defined results: null and empty texts are scored like any text (all features 0);
a document with several labels counts as toxic if most say so; without both classes in the sample the score
is the share of toxic rows seen (0 if none). Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import least_hashed, materialize, plus, read, small_batches, trim

TRAIN_ROWS = 20_000
LEXICON = 400
THRESHOLD = 0.3
FOLDS = 3
WINDOW = 6

# fixed values: second-person words of English, German, French, Spanish
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# fixed values: signs that stand for letters
UNDO = str.maketrans("013457@$!|€", "oieastasiie")

_SPLIT = re.compile(r"[^\s.,;:?\"()\[\]{}<>…«»“”]+")
_MIXED = re.compile(r"[^\W\d_](?:[0-9@$*#!|€_+.-]+)[^\W\d_]")
_SPACED = re.compile(r"\b[^\W\d_](?:[ .\-_*][^\W\d_]){3,}\b")
_REPEAT = re.compile(r"([!?.])\1+")
NAMES = (
    "strong", "weak", "strong_count", "weight_sum", "weight_max", "near_you", "you", "gap",
    "capitals", "shouted", "exclaim", "question", "punctuation", "repeated", "mixed", "undone", "spaced", "length",
)


def kin(text: str) -> int:
    """Equal for copies and mostly equal for near copies: the least hash of three words in a row."""
    w = text.split()
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0)


def words(text: str) -> list[str]:
    return [w.strip("!'*-_") or w for w in _SPLIT.findall(text.lower())]


def features(text: str | None, lexicon: dict[str, float], strong: float) -> list[float]:
    text = text or ""
    raw = _SPLIT.findall(text)
    n = max(1, len(raw))
    low = [w.strip("!'*-_") for w in map(str.lower, raw)]
    hits = [(i, lexicon[w]) for i, w in enumerate(low) if w in lexicon]
    mixed = [w for w in raw if not w.isalpha() and _MIXED.search(w)]
    undone = [x for w in mixed if (x := lexicon.get(re.sub(r"[^\w]", "", w.lower().translate(UNDO)), 0.0)) and w.lower() not in lexicon]
    you = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near, gap = 0, 1.0
    if hits and you:
        y = np.array(you)
        for i, _ in hits:
            d = int(np.abs(y - i).min())
            near += d <= WINDOW
            gap = min(gap, d / (d + WINDOW))
    weights = [x for _, x in hits] + undone
    letters = sum(map(len, raw)) or 1
    capitals = sum(1 for c in text if c.isupper())
    ex, qu = text.count("!"), text.count("?")
    return [
        sum(x >= strong for x in weights) / n,
        sum(x < strong for x in weights) / n,
        float(min(20, sum(x >= strong for x in weights))),
        sum(weights) / n,
        max(weights, default=0.0),
        near / n,
        len(you) / n,
        gap if hits and you else 1.0,
        capitals / letters,
        sum(1 for w in raw if len(w) > 1 and w.isupper()) / n,
        ex / n,
        qu / n,
        (ex + qu + text.count(".") + text.count(",")) / n,
        len(_REPEAT.findall(text)) / n if ex or qu or ".." in text else 0.0,
        len(mixed) / n,
        len(undone) / n,
        len(_SPACED.findall(text)) / n,
        float(np.log1p(len(raw))),
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, l2: float = 1.0, least: float = 0.8):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        self.nodes: list[list[tuple]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(codes, p - y, p * (1 - p))
            self.nodes.append(tree)
            margin += leaf
        return self

    def _grow(self, codes, g, h):
        """A tree as a list by heap order: (feature, cut index) or (None, value)."""
        tree: list = [None] * (2 ** (self.depth + 1) - 1)
        at, leaf = np.zeros(len(g), np.int64), np.zeros(len(g))
        for node in range(len(tree)):
            rows = np.flatnonzero(at == node)
            if node and tree[(node - 1) // 2] is None or node and tree[(node - 1) // 2][0] is None:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-3, None, None)
            if node < 2**self.depth - 1 and hs >= 2 * self.least:
                for f in range(codes.shape[1]):
                    if not len(self.cuts[f]):
                        continue
                    c = codes[rows, f]
                    gl = np.cumsum(np.bincount(c, g[rows], len(self.cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], len(self.cuts[f]) + 1))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    gain[(hl < self.least) | (hs - hl < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            if best[1] is None:
                value = -self.rate * gs / (hs + self.l2)
                tree[node] = (None, value)
                leaf[rows] = value
            else:
                tree[node] = (best[1], float(self.cuts[best[1]][best[2]]))
                at[rows] = 2 * node + 1 + (codes[rows, best[1]] > best[2])
        return tree, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.nodes:
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                f, v = tree[node]
                if f is None:
                    out[rows] += v
                else:
                    right = x[rows, f] > v
                    todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots (x, probability), interpolated between, are kept apart by a trace of slope."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a), float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    mean = y.mean() if len(y) else 0.0
    ks, vs = [], []
    for s, n, lo, hi in blocks:
        v = (s + prior * mean) / (n + prior)
        for k in dict.fromkeys((lo, hi)):
            ks.append(k)
            vs.append(v)
    return np.array(ks), np.maximum.accumulate(np.array(vs))


class Model:
    def __init__(self, lexicon: dict[str, float], strong: float):
        self.lexicon, self.strong, self.trees, self.share, self.knots = lexicon, strong, None, 0.0, None

    def matrix(self, texts) -> np.ndarray:
        return np.array([features(t, self.lexicon, self.strong) for t in texts], float).reshape(-1, len(NAMES))

    def fit(self, x: np.ndarray, y: np.ndarray, folds: list[tuple[np.ndarray, np.ndarray]] = ()) -> Model:
        """``folds``: for each, which rows it holds and the features of all rows under a lexicon that those rows had
        no part in. Margins for the calibration come from trees fitted to the other rows under that lexicon."""
        self.share = float(y.mean()) if len(y) else 0.0
        if len(np.unique(y)) < 2:
            return self
        self.trees = Trees().fit(x, y)
        margin = np.full(len(y), np.nan)
        for out, seen in folds:
            if len(np.unique(y[~out])) == 2:
                margin[out] = Trees().fit(seen[~out], y[~out]).margin(seen[out])
        left = np.isnan(margin)
        margin[left] = self.trees.margin(x[left])
        self.knots = isotonic(margin, y)
        return self

    def score(self, texts) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.full(len(texts), self.share)
        m = self.trees.margin(self.matrix(texts))
        p = np.interp(m, *self.knots)
        # order within a step of the calibration follows the trees
        return np.clip(p + 1e-4 * (1 / (1 + np.exp(-m)) - p), 0.0, 1.0)


def bucket(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def once(t: DataFrame) -> DataFrame:
    """doc_id, text, toxic: equal texts with equal labels are one row, under the least id. A text that was copied a
    thousand times is one piece of evidence."""
    return t.groupBy(F.coalesce("text", F.lit("")).alias("text"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "toxic")


def lexicon(counts: pd.DataFrame, n: int, pos: int) -> dict[str, float]:
    """The words of highest log-odds score among ``n`` rows, ``pos`` of them toxic. ``counts``: w, n, t."""
    c = counts[(counts["t"] >= 3) & (counts["n"] > 0)]
    seen, toxic = c["n"].to_numpy(float), c["t"].to_numpy(float)
    odds = np.log((toxic + 0.5) / (pos + 1.0 - toxic + 0.5)) - np.log((seen - toxic + 0.5) / (n - pos + 1.0 - seen + toxic + 0.5))
    z = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (seen - toxic + 0.5))
    found = sorted((-s, w, o) for s, w, o in zip(z, c["w"], odds, strict=True) if s > 3.5 and o > 0.7)[:LEXICON]
    return {w: float(o) for _, w, o in found}


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    # a label without a document takes no place in the sample
    y = materialize(y.where(bucket() != 2).join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    y = least_hashed(y, F.xxhash64("doc_id"), rows).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    t = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")  # at most ``rows`` pairs of numbers

    t = materialize(once(t), "labelled")

    def count(batches):
        seen = [Counter() for _ in range(FOLDS)]
        toxic = [Counter() for _ in range(FOLDS)]
        for d in batches:
            for text, flag in zip(d["text"], d["toxic"], strict=True):
                own, k = {"", *words(text or "")}, kin(text or "") % FOLDS
                seen[k].update(own)
                if flag:
                    toxic[k].update(own)
        yield pd.DataFrame([(w, k, c, toxic[k][w]) for k in range(FOLDS) for w, c in seen[k].items()], columns=["w", "k", "n", "t"])
        del seen, toxic
        trim()

    # words of fewer than three toxic rows are in no lexicon; the empty word counts rows. At most ``rows`` texts are counted
    each = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for c in ("n", "t") for k in range(FOLDS)]
    counts = t.mapInPandas(count, "w string, k int, n long, t long").groupBy("w").agg(*each).where(" + ".join(f"t{k}" for k in range(FOLDS)) + " >= 3 or w = ''")
    counts = counts.toPandas()

    def chosen(folds) -> Model:
        c = pd.DataFrame({"w": counts["w"], "n": sum(counts[f"n{k}"] for k in folds), "t": sum(counts[f"t{k}"] for k in folds)})
        whole = c[c["w"] == ""]
        return Model(lexicon(c[c["w"] != ""], int(whole["n"].sum()), int(whole["t"].sum())), 2.0)

    model, without = chosen(range(FOLDS)), [chosen([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)]

    def featurise(batches):
        for d in batches:
            x = np.stack([m.matrix(d["text"]) for m in (model, *without)], 1).reshape(len(d), -1)
            yield pd.DataFrame({"doc_id": d["doc_id"].astype(str), "toxic": d["toxic"], "kin": [kin(v) for v in d["text"]], "x": list(x)})
        trim()

    data = t.mapInPandas(featurise, "doc_id string, toxic int, kin long, x array<double>").toPandas().sort_values(["doc_id", "toxic", "kin"], kind="stable")
    x = np.array(data["x"].tolist(), float).reshape(len(data), 1 + FOLDS, len(NAMES))
    fold = data["kin"].to_numpy(np.int64) % FOLDS
    return model.fit(x[:, 0], data["toxic"].to_numpy(float), [(fold == k, x[:, k + 1]) for k in range(FOLDS)])


def score(docs: DataFrame, model: Model, name: str = "tox_score") -> DataFrame:
    """All columns of ``docs`` as they are, and a score."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            p = pa.array(model.score(b.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, p], [*b.schema.names, name])
        trim()

    return docs.mapInArrow(run, plus(docs.schema, name, "double"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = score(docs, model, "score")
    return out.select("doc_id", (bucket() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored at the threshold or above go."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, "__tox_score").where(F.col("__tox_score") < THRESHOLD).drop("__tox_score")
