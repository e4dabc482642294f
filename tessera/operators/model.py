"""Grouped calibration of a quality model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import running_sum

GRID = (0.1, 1.0, 10.0)


class Logistic:
    """ML1: median imputation, standardisation, and an L2 logistic fit with balanced class weights, by Newton
    steps on the small normal matrix. The intercept is regularised like the weights."""

    def __init__(self, c: float = 1.0):
        self.c = c

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        with np.errstate(all="ignore"):
            self.median = np.array([np.median(col[~np.isnan(col)]) if (~np.isnan(col)).any() else 0.0 for col in x.T])
        x = np.where(np.isnan(x), self.median, x)
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(sd > 0, sd, 1.0)
        z = np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))
        n, pos = len(y), y.sum()
        weight = self.c * np.where(y == 1, n / (2 * max(pos, 1)), n / (2 * max(n - pos, 1)))
        self.w = np.zeros(z.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -35, 35)))
            g = z.T @ (weight * (p - y)) + self.w
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(self.w))
            step = np.linalg.solve(h, g)
            self.w -= step
            if np.abs(step).max() < 1e-10:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.median, x) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -35, 35)))


def average_precision(y: np.ndarray, s: np.ndarray) -> float:
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    hits = np.cumsum(y)[last]
    recall = hits / max(y.sum(), 1)
    return float((np.diff(recall, prepend=0.0) * hits / (last + 1)).sum())


def out_of_fold(data: DataFrame, features: list[str], target: str, fold: str, key: str, grid=GRID) -> DataFrame:
    """ML2 to ML4: (key, probability, c) for every row, from models of the other folds.

    The strength is chosen inside the other folds by average precision, ties to the smaller one. One task a
    held-out fold; the labelled table is of calibration size, a documented precondition.
    """
    cols = [key, target, fold, *features]
    narrow = data.select(*cols)
    held = F.broadcast(narrow.select(F.col(fold).alias("_held")).distinct())  # a row a fold
    kind = dict(data.dtypes)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        out_fold = d["_held"].iloc[0]
        d = d.sort_values(key, kind="stable")
        inside, out = d[d[fold] != out_fold], d[d[fold] == out_fold]
        x, y, f = inside[features].to_numpy(float), inside[target].to_numpy(float), inside[fold].to_numpy()
        best = (-1.0, None)
        for c in grid:
            s = np.full(len(y), np.nan)
            for k in np.unique(f):
                if len(np.unique(y[f != k])) == 2:
                    s[f == k] = Logistic(c).fit(x[f != k], y[f != k]).predict(x[f == k])
            ok = ~np.isnan(s)
            ap = average_precision(y[ok], s[ok]) if ok.any() else 0.0
            if ap > best[0] + 1e-12:
                best = (ap, c)
        p = Logistic(best[1]).fit(x, y).predict(out[features].to_numpy(float))
        return pd.DataFrame({key: out[key], "probability": p, "c": best[1]})

    return narrow.crossJoin(held).groupBy("_held").applyInPandas(run, f"{key} {kind[key]}, probability double, c double")


def rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ML5: ROC-AUC by tie-averaged ranks, average precision by steps over distinct scores, prevalence.

    Both come from counts by score, summed by ranges, so ties and large inputs need no sort of rows in one task.
    """
    c = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    c = running_sum(running_sum(c, F.col("n"), "s", out="before"), F.col("p"), "s", out="below")
    c = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("_N"), F.sum("p").alias("_P"))))  # one row
    c = c.withColumn("tn", F.col("_N") - F.col("before")).withColumn("tp", F.col("_P") - F.col("below"))
    a = c.agg(F.sum("n").alias("rows"), F.sum("p").alias("positives"), F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum(F.col("p") * F.col("tp") / F.col("tn")).alias("steps"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    auc = (F.col("ranks") - F.col("positives") * (F.col("positives") + 1) / 2.0) / (F.col("positives") * (F.col("rows") - F.col("positives")))
    return a.select("rows", "positives", F.when(both, auc).alias("roc_auc"), F.when(both, F.col("steps") / F.col("positives")).alias("average_precision"), (F.col("positives") / F.col("rows")).alias("prevalence"))


def confusion(flag: Column, poor: Column) -> list[Column]:
    """AG18, aggregates: counts, precision and recall, null without a denominator."""
    tp, fp, fn, tn = F.count_if(flag & poor), F.count_if(flag & ~poor), F.count_if(~flag & poor), F.count_if(~flag & ~poor)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall")]


def gates(compression: Column, logprob: Column, no_speech: Column, hit_max: Column) -> dict[str, Column]:
    """FLT6: missing compression counts as 0, a missing mean log-probability as minus infinity."""
    lp = F.coalesce(logprob, F.lit(float("-inf")))
    return {"compression": F.coalesce(compression, F.lit(0.0)) > 2.4, "logprob": lp < -1.0, "no_speech": (no_speech > 0.6) & (lp < -1.0), "hit_max": hit_max}


def poor_score(confidence: Column) -> Column:
    """FN28."""
    return F.coalesce(1.0 - confidence, F.lit(1.0))


def scorer(df: DataFrame, make, schema: str) -> DataFrame:
    """UDF1, INF1 to INF3: a pluggable batch scorer; ``make()`` is called once a task and returns a function
    from a pandas frame to a pandas frame."""

    def run(batches):
        score = make()
        for b in batches:
            yield score(b)

    return df.mapInPandas(run, schema)
