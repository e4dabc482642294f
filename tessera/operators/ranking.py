"""Ranks, positions, curricula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digests import draw


#: Rows of a range that one task sorts, and ranges at most.
RANGE_ROWS, RANGES = 1 << 18, 1024


def _columns(order) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in order]


def ranged(df: DataFrame, *order: Column | str, out: str = "_range", ranges: int | None = None) -> DataFrame:
    """``df`` with the number of the range of the order that a row falls into.

    Bounds are drawn from a sample of some thousand keys and are literals of the plan, so a row's range depends on the
    row alone, in every task and every rerun; which bounds were drawn changes no result that is made with them. A key
    held by very many rows should be counted first (``tie_percentile``) or be told apart by further columns.
    """
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_columns(order))))
    keys = df.select(key.alias("k"))
    n = keys.count() if ranges is None or ranges > 1 else 0
    ranges = max(1, min(RANGES, n // RANGE_ROWS)) if ranges is None else ranges
    if ranges == 1 or n == 0:
        return df.withColumn(out, F.lit(0))
    kind = keys.schema["k"].dataType
    drawn = [r["k"] for r in keys.sample(min(1.0, 32.0 * ranges / n), 7).select("k").distinct().limit(64 * ranges).orderBy("k").collect()]
    bounds = [drawn[len(drawn) * i // ranges] for i in range(1, ranges) if drawn]
    bounds = [b for i, b in enumerate(bounds) if not i or b != bounds[i - 1]]
    lit = lambda r: F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields))

    def search(lo: int, hi: int) -> Column:
        """The number of bounds at or below the key, when it is in lo..hi."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return df.withColumn(out, search(0, len(bounds)))


def running_sum(df: DataFrame, amount: Column, *order: Column | str, by: tuple[str, ...] = (), out: str = "before", ranges: int | None = None) -> DataFrame:
    """The sum of ``amount`` over the rows before a row in an order, on any number of rows: ranges of the order are summed
    first (with map-side combine), and only rows of one range are sorted together. The order must tell rows apart."""
    order = _columns(order)
    names = [f"__o{i}" for i in range(len(order))]
    d = ranged(df, *order, out="__range", ranges=ranges).withColumns({"__a": amount} | dict(zip(names, order, strict=True)))
    sums = d.groupBy(*by, "__range").agg(F.sum("__a").alias("__s"))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = sums.select(*(F.col(c).alias(f"__b_{c}") for c in by), F.col("__range").alias("__r"), F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__base"))
    own = Window.partitionBy(*by, "__range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__own", F.coalesce(F.sum("__a").over(own), F.lit(0)))
    on = d["__range"] == base["__r"]
    for c in by:
        on = on & d[c].eqNullSafe(base[f"__b_{c}"])
    return d.join(base, on).withColumn(out, F.col("__base") + F.col("__own")).drop("__range", "__r", "__a", "__own", "__base", *names, *(f"__b_{c}" for c in by))


def global_position(df: DataFrame, *order: Column | str, by: tuple[str, ...] = (), out: str = "position", ranges: int | None = None) -> DataFrame:
    """WN2 on any number of rows: places from 0. Rows that are equal in the order are placed in any way."""
    return running_sum(df, F.lit(1).cast("bigint"), *order, by=by, out=out, ranges=ranges)


def ordered_position(df: DataFrame, *order: Column | str, by: tuple[str, ...] = (), out: str = "position") -> DataFrame:
    """WN2 in groups that one task can sort."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def tie_percentile(df: DataFrame, value: str, out: str, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """WN1: (first place + last place of a value) / 2 / (n - 1), ties averaged; 0.5 for a single row.

    Ranks are made on distinct values with their counts, so a value held by very many rows is one row there, and
    distinct values are summed by ranges.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    totals = df.groupBy(*by).agg(F.count("*").alias("_total")).select(*(F.col(b).alias(f"_t_{b}") for b in by), "_total")
    ranks = running_sum(counts, F.col("_n"), value, by=by, out="_before", ranges=ranges)
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_t_{b}"))
    ranks = ranks.join(totals, on) if by else ranks.crossJoin(F.broadcast(totals))  # one row
    rank = F.when(F.col("_total") > 1, (F.col("_before") + (F.col("_n") - 1) / 2.0) / (F.col("_total") - 1)).otherwise(0.5)
    ranks = ranks.select(*(F.col(b).alias(f"_{b}") for b in by), F.col(value).alias("_v"), rank.alias(out))
    on = df[value].eqNullSafe(ranks["_v"])
    for b in by:
        on = on & df[b].eqNullSafe(ranks[f"_{b}"])
    return df.join(ranks, on).drop("_v", *(f"_{b}" for b in by))


def occurrence(df: DataFrame, key: str, position: str, out: str = "occurrence") -> DataFrame:
    """WN3: how often a key has come before, along a sequence."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(position)) - 1)


def running_max(df: DataFrame, value: str, order: list, by: tuple[str, ...] = (), out: str = "running_max") -> DataFrame:
    """WN4."""
    return df.withColumn(out, F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def first_stage(rank: Column, n: Column, fractions: list[float]) -> Column:
    """WN5: the first stage (from 1) whose share of the order holds a rank (from 0)."""
    out = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(fractions, 1))):
        out = F.when(rank < F.least(n, F.ceil(n * F.lit(f))), i).otherwise(out)
    return out


def first_seen(df: DataFrame, key: str, order: list[str], out: str = "is_duplicate") -> DataFrame:
    """WN7: whether a key occurred before in scan order. The first of a key is an aggregate, combined before the shuffle,
    and a key with very many rows is split by the join."""
    place = F.struct(*order)
    first = df.groupBy(F.col(key).alias("_k")).agg(F.min(place).alias("_first"))
    return df.join(first, df[key].eqNullSafe(first["_k"])).withColumn(out, place != F.col("_first")).drop("_k", "_first")


def breaks_of_order(df: DataFrame, value: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """WN8: rows whose value is below that of the row before."""
    return df.withColumn("_b", F.lag(value).over(Window.partitionBy(*by).orderBy(*order))).where(F.col(value) < F.col("_b")).drop("_b")


def min_max(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """WN9: (value - least) / range, 0 where the range is 0."""
    r = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if by:
        r = r.select(*(F.col(b).alias(f"_{b}") for b in by), "_lo", "_hi")
        on = F.lit(True)
        for b in by:
            on = on & df[b].eqNullSafe(r[f"_{b}"])
        j = df.join(r, on).drop(*(f"_{b}" for b in by))
    else:
        j = df.crossJoin(F.broadcast(r))  # one row
    return j.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def hash_order(df: DataFrame, seed: int, key: str, out: str = "position") -> DataFrame:
    """SEL5, SEL6: a seeded permutation, the same for every partitioning."""
    return global_position(df, draw(str(seed), F.col(key)), F.col(key).cast("string"), out=out)


def with_total(df: DataFrame, out: str) -> DataFrame:
    """``df`` with its number of rows."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(out))))  # one row


def snr_difficulty(df: DataFrame, snr: str) -> DataFrame:
    """CUR2."""
    return tie_percentile(df, snr, "_p").withColumn("difficulty", 1.0 - F.col("_p")).drop("_p")


def joint_difficulty(df: DataFrame, duration: str, snr: str) -> DataFrame:
    """CUR3: half long, half noisy."""
    d = tie_percentile(tie_percentile(df, duration, "_d"), snr, "_s")
    return d.withColumn("difficulty", 0.5 * F.col("_d") + 0.5 * (1.0 - F.col("_s"))).drop("_d", "_s")


def static_order(df: DataFrame, score: str, key: str, index: str) -> DataFrame:
    """CUR1: by score, then id as text, then index; the same in each epoch."""
    return global_position(df, score, F.col(key).cast("string"), index)


def random_priority(df: DataFrame, seed: int, key: str) -> DataFrame:
    """CUR4: the place in a seeded permutation over n - 1."""
    n = F.col("_n")
    return with_total(hash_order(df, seed, key, "_r"), "_n").withColumn("priority", F.when(n > 1, F.col("_r") / (n - 1)).otherwise(0.0)).drop("_r", "_n")


def pacing(df: DataFrame, priority: str, key: str, seed: int, fractions: list[float]) -> DataFrame:
    """CUR5: for each epoch n presentations from the first ceil(n * f) rows, counts apart by one at most.

    Every row of the pool comes div(n, k) times, and those first in the epoch's shuffle once more.
    """
    text = F.col(key).cast("string")
    ranked = with_total(global_position(df, priority, text, out="rank"), "n")
    stages = F.explode(F.array(*(F.struct(F.lit(i).alias("epoch"), F.lit(float(f)).alias("f")) for i, f in enumerate(fractions, 1)))).alias("s")
    pool = ranked.select("*", stages).withColumn("k", F.least("n", F.ceil(F.col("n") * F.col("s.f")))).where("rank < k").withColumn("epoch", F.col("s.epoch"))
    pool = global_position(pool, draw(str(seed), F.col("epoch"), F.col(key)), text, by=("epoch",), out="shuffle")
    reps = F.floor(F.col("n") / F.col("k")) + F.when(F.col("shuffle") < F.col("n") % F.col("k"), 1).otherwise(0)
    shown = pool.withColumn("repeat", F.explode(F.sequence(F.lit(1), reps.cast("int"))))
    again = draw(str(seed), F.lit("again"), F.col("epoch"), F.col(key), F.col("repeat"))
    return global_position(shown, again, text, "repeat", by=("epoch",)).drop("s", "k", "shuffle", "n")


def sorted_first_epoch(df: DataFrame, duration: str, key: str, seed: int, epochs: int) -> DataFrame:
    """CUR6: by duration in epoch 1, seeded permutations afterwards."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    first = F.col("epoch") == 1
    order = [F.when(first, F.col(duration)), F.when(~first, draw(str(seed), F.col("epoch"), F.col(key))), F.col(key).cast("string")]
    return global_position(e, *order, by=("epoch",))


def loss_order(state: DataFrame, index: str = "dataset_index") -> DataFrame:
    """CUR7: the next order by loss per second, then duration, id and index. ``state``: nll, duration, id, index."""
    return global_position(state.withColumn("score", F.col("nll") / F.col("duration")), "score", "duration", F.col("id").cast("string"), index)


def hybrid_order(state: DataFrame, acoustic_weight: float, index: str = "dataset_index") -> DataFrame:
    """CUR8: an acoustic score and the percentile of loss per second, weighted."""
    s = tie_percentile(state.withColumn("_l", F.col("nll") / F.col("duration")), "_l", "_p")
    s = s.withColumn("score", acoustic_weight * F.col("acoustic") + (1.0 - acoustic_weight) * F.col("_p")).drop("_l", "_p")
    return global_position(s, "score", "duration", F.col("id").cast("string"), index)


def error_order(state: DataFrame, index: str = "dataset_index") -> DataFrame:
    """CUR9: by error rate, with the rate normalised to 0..1."""
    return global_position(min_max(state, "wer", "normalized"), "wer", "duration", F.col("id").cast("string"), index)


def state_violations(state: DataFrame, keys: DataFrame) -> DataFrame:
    """CUR7 and CUR11: what is wrong with an epoch's state: (id, problem)."""
    def bad(cond, what):
        return state.where(cond).select(F.col("id").cast("string").alias("id"), F.lit(what).alias("problem"))

    nan = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    out = bad(nan("nll") | (F.col("nll") < 0), "loss").union(bad(nan("duration") | (F.col("duration") <= 0), "duration"))
    twice = state.groupBy("id").count().where("count > 1").select(F.col("id").cast("string"), F.lit("repeated"))
    gone = keys.select("id").join(state.select("id"), "id", "left_anti").select(F.col("id").cast("string"), F.lit("missing"))
    return out.union(twice).union(gone)


def epochs(state: DataFrame, sampler, loss, n: int) -> list[DataFrame]:
    """UDF5, the hooks of a trainer: ``sampler`` gives the order of an epoch from the state so far (a row an item, with a
    position), ``loss`` the state after it. Returns the order of each epoch with its number (from 1)."""
    out = []
    for i in range(1, n + 1):
        order = sampler(state, i)
        out.append(order.withColumn("epoch", F.lit(i)))
        state = loss(order.select(*state.columns), i)
    return out
