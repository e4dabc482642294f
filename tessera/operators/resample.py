"""Bootstrap and factorial statistics by hash draws: rows in, rows out, no driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digests import draw
from tessera.operators.ranking import global_position, with_total


def draws(clusters: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """replicate, and the columns of a cluster, once for each of as many draws as there are clusters.

    ``clusters`` is one row a cluster, already aggregated, so this is replicate-sized work.
    """
    c = with_total(global_position(clusters, F.col(key).cast("string"), out="_i"), "_k")
    slots = c.select(F.col("_i").alias("_slot"), F.col("_k").alias("_kk"))
    grid = slots.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    pick = (draw(str(seed), F.col("replicate"), F.col("_slot")) % F.col("_kk").cast("decimal(20,0)")).cast("bigint")
    return grid.withColumn("_i", pick).drop("_kk", "_slot").join(c.drop("_k"), "_i").drop("_i")


def bootstrap_deltas(clusters: DataFrame, key: str, base: str, candidate: str, words: str, replicates: int, seed: int) -> DataFrame:
    """STA1, a row a replicate: 100 * sum(base - candidate) / sum(words)."""
    d = draws(clusters, key, replicates, seed)
    return d.groupBy("replicate").agg((100.0 * F.sum(F.col(base) - F.col(candidate)) / F.sum(words)).alias("delta"))


def interval(deltas: DataFrame, threshold: float = 0.5, level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """STA1, the report: interval (type 7), share above 0 (strict) and at the threshold or above."""
    tail = (1 - level) / 2
    return deltas.groupBy(*by).agg(
        F.count("*").alias("replicates"),
        F.percentile("delta", F.lit(tail)).alias("ci_low"),
        F.percentile("delta", F.lit(1 - tail)).alias("ci_high"),
        F.avg((F.col("delta") > 0).cast("double")).alias("p_positive"),
        F.avg((F.col("delta") >= threshold).cast("double")).alias("p_threshold"),
    )


def factorial_effects(w00: Column, w_noise: Column, w_rir: Column, w_both: Column) -> dict[str, Column]:
    """STA3: two main effects and the interaction of four cells."""
    return {
        "noise": ((w00 - w_noise) + (w_rir - w_both)) / 2.0,
        "rir": ((w00 - w_rir) + (w_noise - w_both)) / 2.0,
        "interaction": w_noise + w_rir - w_both - w00,
    }


def centred_p(samples: DataFrame, value: str, observed: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """STA4: two-sided p of an observed value against samples centred on it."""
    far = F.abs(F.col(value) - observed) >= F.abs(observed)
    return samples.groupBy(*by).agg(((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p"))


def holm(df: DataFrame, p: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """STA5: adjusted p, ties by name, at most 1, never falling."""
    w = Window.partitionBy(*by)
    o = w.orderBy(p, name)
    step = F.least(F.lit(1.0), (F.count("*").over(w) - F.row_number().over(o) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_adjusted", F.max("_s").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def seed_effects(a0: Column, a1: Column, a2: Column, a3: Column) -> dict[str, Column]:
    """STA6: five named effects of a seed."""
    return {
        "augmentation_without_curriculum": a0 - a2,
        "curriculum_without_augmentation": a0 - a1,
        "curriculum_with_augmentation": a2 - a3,
        "augmentation_with_curriculum": a1 - a3,
        "interaction": (a2 - a3) - (a0 - a1),
    }


def spread_of(value: str) -> list[Column]:
    """AG13: mean, sample deviation, least, most and count."""
    return [F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")]


def sign_flip(values: Column, effect: Column) -> Column:
    """STA8: exact p over all sign vectors of three values."""
    signs = F.array(*(F.array(F.lit(a), F.lit(b), F.lit(c)) for a in (1.0, -1.0) for b in (1.0, -1.0) for c in (1.0, -1.0)))
    means = F.transform(signs, lambda s: F.aggregate(F.zip_with(s, values, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y) / 3.0)
    return F.size(F.filter(means, lambda m: F.abs(m) >= F.abs(effect) - 1e-12)) / F.size(signs)


def contrast(a: Column, b: Column, c: Column, d: Column) -> Column:
    """STA9."""
    return (a - b) - (c - d)


def tercile(value: Column, low: Column, high: Column) -> Column:
    """JN9: bin by two cuts; a value equal to a cut goes up."""
    return F.when(value >= high, 2).when(value >= low, 1).otherwise(0)
