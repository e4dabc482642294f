"""Samples, splits and capped selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digests import draw, unsigned64
from tessera.operators.ranking import global_position, running_sum


def capped_selection(df: DataFrame, key: str, group: str, size: str, score: str, target: float, group_cap: float, group_rows: int) -> DataFrame:
    """SEL1: rows in order of (score, id as text); a row is skipped when it would pass the target, its group's
    cap or its group's number of rows. Skipping is not stopping, and the target couples all groups, so the
    fold is sequential: one task reads four narrow columns, with rows that could never fit already gone.
    """
    narrow = df.where(F.col(size) <= min(target, group_cap)).select(F.col(key).cast("string").alias("k"), F.col(group).cast("string").alias("g"), F.col(size).cast("double").alias("d"), F.col(score).cast("double").alias("s"))

    def fold(batches):
        total, used, rows = 0.0, {}, {}
        for b in batches:
            keep = []
            for g, d in zip(b["g"], b["d"], strict=True):
                ok = total + d <= target and used.get(g, 0.0) + d <= group_cap and rows.get(g, 0) < group_rows
                keep.append(ok)
                if ok:
                    total += d
                    used[g] = used.get(g, 0.0) + d
                    rows[g] = rows.get(g, 0) + 1
            yield b.loc[keep, ["k"]]

    ordered = narrow.repartition(1).sortWithinPartitions("s", "k")  # the scan before stays parallel; the sort spills
    chosen = ordered.mapInPandas(fold, "k string")
    return df.join(chosen, df[key].cast("string") == chosen["k"], "left_semi")


def spread(n: Column, k: int) -> Column:
    """The k places (from 0) spread over n rows: rint(i (n - 1) / (k - 1)); the middle one for k = 1."""
    if k == 1:
        return F.array(F.floor(n / 2).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / F.lit(k - 1)).cast("bigint"))


def stratified_sample(df: DataFrame, order: list, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """SEL2 and SEL3: k rows, evenly spread over the order, in each stratum."""
    d = global_position(df, *order, by=by, out="_r")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).select(*(F.col(c).alias(f"_{c}") for c in by), F.explode(spread(F.col("_n"), k)).alias("_p")).distinct()
    on = d["_r"] == sizes["_p"]
    for c in by:
        on = on & d[c].eqNullSafe(sizes[f"_{c}"])
    return d.join(sizes, on, "left_semi").drop("_r")


def error_stratum(rate: Column) -> Column:
    """FLT4."""
    return F.when(rate <= 0.4, "low").when(rate <= 0.5, "middle").when(rate <= 0.8, "high").otherwise("extreme")


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """SEL4."""
    return df.orderBy(*order).limit(k)


def seeded_sample(df: DataFrame, seed: int, key: str, k: int) -> DataFrame:
    """SEL5: the first k of a seeded shuffle, without sorting the rest."""
    return df.orderBy(draw(str(seed), F.col(key)), F.col(key).cast("string")).limit(k)


def split_search(sizes: DataFrame, group: str, trials: int, seed: int, held_out: Column | int, ratios=(0.8, 0.1, 0.1), most_share: float | None = None) -> DataFrame:
    """SEL7 and SEL8: groups (group, rows, hours) dealt to train, validation and test, the best of many shuffles.

    Each trial ranks the groups by a seeded draw; the first ``held_out`` are validation, the next as many test.
    A trial scores the squared relative deviation of rows and hours from the ratios; with ``most_share`` no
    group may hold more of a held-out split. Trials are rows, so all are searched at once.
    """
    w = Window.partitionBy("trial")
    t = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    t = t.withColumn("_r", F.row_number().over(w.orderBy(draw(str(seed), F.col("trial"), F.col(group)), F.col(group).cast("string"))) - 1)
    t = t.withColumn("_g", F.count("*").over(w))
    h = held_out if isinstance(held_out, Column) else F.lit(held_out)
    t = t.withColumn("split", F.when(F.col("_r") < h, "validation").when(F.col("_r") < 2 * h, "test").otherwise("train"))
    totals = sizes.agg(F.sum("rows").alias("_R"), F.sum("hours").alias("_H"))
    parts = t.groupBy("trial", "split").agg(F.sum("rows").alias("r"), F.sum("hours").alias("h"), F.max("rows").alias("mr"), F.max("hours").alias("mh")).crossJoin(F.broadcast(totals))  # one row
    ratio = F.when(F.col("split") == "train", ratios[0]).when(F.col("split") == "validation", ratios[1]).otherwise(ratios[2])
    dev = lambda x, y: F.pow((F.col(x) - ratio * F.col(y)) / (ratio * F.col(y)), 2)
    parts = parts.withColumn("_s", dev("r", "_R") + dev("h", "_H"))
    ok = F.lit(True) if most_share is None else F.bool_and((F.col("split") == "train") | ((F.col("mr") <= most_share * F.col("r")) & (F.col("mh") <= most_share * F.col("h"))))
    scored = parts.groupBy("trial").agg(F.round(F.sum("_s"), 12).alias("score"), ok.alias("ok"), F.count("*").alias("splits")).where("ok and splits = 3")
    best = scored.agg(F.min(F.struct("score", "trial")).alias("b")).select("b.score", F.col("b.trial").alias("trial"))
    return t.join(F.broadcast(best), "trial").select(group, "rows", "hours", "split", "trial", "score")


def hash_partition(key: Column, salt: str, weights: dict[str, int]) -> Column:
    """SEL9: a named part by the hash of salted content, in proportion to weights."""
    b = unsigned64(F.sha2(F.concat_ws(":", F.lit(salt), key), 256)) % F.lit(sum(weights.values())).cast("decimal(20,0)")
    out, upto = None, 0
    for name, w in weights.items():
        upto += w
        out = F.when(b < upto, name) if out is None else out.when(b < upto, name)
    return out


def lane(position: Column, lanes: int) -> Column:
    """SEL14."""
    return position % lanes


def union_of_selectors(selected: dict[str, DataFrame], key: str) -> DataFrame:
    """SEL11: keys of any selector with the sorted names of all that chose them."""
    parts = None
    for name, df in sorted(selected.items()):
        p = df.select(key, F.lit(name).alias("_s"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy(key).agg(F.sort_array(F.collect_set("_s")).alias("shortlist_sources"))


def cap_violations(df: DataFrame, group: str, hours: str, most_hours: float, most_rows: int, least_groups: int) -> DataFrame:
    """SEL12: groups over a cap, and one row (null group) if there are too few groups."""
    g = df.groupBy(group).agg(F.count("*").alias("rows"), F.sum(hours).alias("hours"))
    over = g.where((F.col("rows") > most_rows) | (F.col("hours") > most_hours + 1e-9))
    few = g.agg(F.count("*").alias("rows")).where(F.col("rows") < least_groups).select(F.lit(None).cast(dict(df.dtypes)[group]).alias(group), "rows", F.lit(None).cast("double").alias("hours"))
    return over.union(few)


def grouped_folds(counts: DataFrame, group: str, folds: int) -> DataFrame:
    """SEL13: groups (group, n, positives) dealt to folds: the largest first, each to the lightest fold.

    Sequential over groups, which are few; one task folds one narrow row a group.
    """
    def deal(batches):
        d = pd.concat(list(batches))
        d = d.sort_values(["n", group], ascending=[False, True], kind="stable")
        load = [0] * folds
        out = []
        for n in d["n"]:
            f = min(range(folds), key=lambda i: (load[i], i))
            load[f] += n
            out.append(f)
        yield d[[group]].assign(fold=out)

    kind = dict(counts.dtypes)[group]
    return counts.select(group, "n").repartition(1).mapInPandas(deal, f"{group} {kind}, fold long")


def cohort_override(cells: DataFrame, overrides: DataFrame, keys: list[str], run: str) -> DataFrame:
    """SEL15: the run that stands for a cell: the override by provenance if there is one, else the default."""
    o = overrides.select(*keys, F.col(run).alias("_o"))
    return cells.join(o, keys, "left").withColumn(run, F.coalesce("_o", run)).drop("_o")


def pick_candidate(speech: DataFrame, noise: DataFrame, key: str, noise_key: str, length: str, seed: int) -> DataFrame:
    """JN8 and FLT7: for each row, a seeded pick among candidates at least as long.

    No pairs are made: candidates are ranked by falling length, in their length and after the longer ones, which
    are counted by length; the number that fit a row comes from one merged running count, and the pick is an
    equi-join on rank.
    """
    n = noise.select(F.col(noise_key).alias("candidate"), F.col(length).alias("_len"))
    ranked = global_position(n.where("_len is not null"), -F.col("_len"), F.col("candidate").cast("string"), out="_rank").withColumn("_rank", F.col("_rank") + 1)
    # lengths of candidates and lengths asked for in one falling order; asked ones count nothing and come last of equals
    lengths = speech.select(F.col(length).alias("_need")).where("_need is not null").distinct().select("_need", F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_own"))
    fits = n.where("_len is not null").groupBy(F.col("_len").alias("_need")).agg(F.count("*").alias("_n")).withColumn("_own", F.lit(False))
    table = running_sum(fits.unionByName(lengths), F.col("_n"), -F.col("_need"), "_own", out="eligible").where("_own").select("_need", F.col("eligible").cast("int").alias("eligible"))
    d = speech.join(table, speech[length] == table["_need"], "left").drop("_need").withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    pick = (draw(str(seed), F.col(key)) % F.greatest("eligible", F.lit(1)).cast("decimal(20,0)")).cast("int") + 1
    d = d.withColumn("_rank", F.when(F.col("eligible") > 0, pick))
    return d.join(ranked.select("_rank", "candidate"), "_rank", "left").drop("_rank")
