"""Array and token functions: statistics of token lists, and signals as arrays."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least positive normal double, the floor of decibels.
TINY = 2.2250738585072014e-308
SILENCE_DB, FRAME_SECONDS, SNR_CAP = 40.0, 0.1, 60.0


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dbfs(v: Column) -> Column:
    """FN20."""
    return 20.0 * F.log10(F.greatest(v, F.lit(TINY)))


def rms(x: Column) -> Column:
    """FN21: root mean square in doubles; null for an empty array."""
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(x)))


def percentile(sorted_array: Column, q: float) -> Column:
    """AG10 over a sorted array: linear interpolation between neighbours."""
    p = q * (F.size(sorted_array) - 1)
    lo = F.floor(p).cast("int")
    f = p - lo
    a, b = F.get(sorted_array, lo), F.get(sorted_array, F.least(lo + 1, F.size(sorted_array) - 1))
    return a * (1 - f) + b * f


def trim_at_end(ids: Column, end: int, pad: int | None = None) -> Column:
    """FN18: ids before the first end or pad after position 0, the end itself kept."""
    hit = F.filter(F.transform(ids, lambda v, i: F.when((i > 0) & ((v == end) | (v == pad if pad is not None else F.lit(False))), i)), lambda i: i.isNotNull())
    first = F.get(hit, F.lit(0))
    keep = F.when(first.isNull(), F.size(ids)).when(F.get(ids, first) == end, first + 1).otherwise(first)
    return F.slice(ids, F.lit(1), keep)


def token_statistics(ids: Column, logp: Column, end: int, special: list[int]) -> dict[str, Column]:
    """FN17: ids up to the first end (kept), and statistics over tokens that are not special; null without any."""
    at = F.array_position(ids, end)
    n = F.when(at > 0, at.cast("int")).otherwise(F.size(ids))
    kept, lp = F.slice(ids, F.lit(1), n), F.slice(logp, F.lit(1), n)
    pairs = F.filter(F.arrays_zip(kept.alias("i"), lp.alias("p")), lambda z: ~z["i"].isin([*special, end]))
    content = F.transform(pairs, lambda z: z["p"])
    size = F.size(content)
    some = size > 0
    probability = F.sort_array(F.transform(content, lambda v: F.exp(v)))
    return {
        "token_ids": kept,
        "content_token_count": size,
        "log_probability_sum": F.when(some, total(content)),
        "log_probability_mean": F.when(some, total(content) / size),
        "geometric_confidence": F.when(some, F.exp(total(content) / size)),
        "minimum_probability": F.when(some, F.array_min(probability)),
        "p10_probability": F.when(some, percentile(probability, 0.1)),
        "end_generated": at > 0,
        "end_position": F.when(at > 0, at.cast("int") - 1),
        "end_log_probability": F.when(at > 0, F.get(logp, at.cast("int") - 1)),
        "hit_max_length": at == 0,  # FN19
    }


def frames(x: Column, rate: Column) -> Column:
    """The signal in frames of a tenth of a second, the last one padded with zeros."""
    f = F.greatest(F.lit(1), F.rint(rate * FRAME_SECONDS).cast("int"))
    n = F.ceil(F.size(x) / f).cast("int")
    padded = F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), n * f - F.size(x)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(padded, i * f + 1, f))


def acoustic_profile(df: DataFrame, x: str, rate: Column) -> DataFrame:
    """ARR1: levels, silence at the ends, share of active frames, and a signal-to-noise proxy capped at 60 dB.

    In three steps, so that frame levels are computed once for all that is read off them.
    """
    d = df.withColumn("_level", F.transform(frames(F.col(x), rate), lambda fr: rms(fr))).withColumn("_seconds", F.size(x) / rate)
    d = d.withColumn("_peak", F.array_max("_level"))
    cut = F.col("_peak") * (10.0 ** (-SILENCE_DB / 20.0))
    alive = F.col("_peak") > 0
    d = d.withColumn("_flags", F.transform("_level", lambda v: (v >= cut) & alive)).withColumn("_active", F.sort_array(F.filter("_level", lambda v: (v >= cut) & alive)))
    d = d.withColumn("_speech", percentile(F.col("_active"), 0.75)).withColumn("_sorted", F.sort_array("_level"))
    d = d.withColumn("noise_rms", percentile(F.col("_sorted"), 0.2))
    seconds = F.col("_seconds")
    first = F.array_position("_flags", True) - 1
    last = F.size("_flags") - F.array_position(F.reverse("_flags"), True)
    out = {
        "measured_duration": seconds,
        "peak_dbfs": dbfs(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))),
        "rms_dbfs": dbfs(rms(F.col(x))),
        "speech_ratio": F.when(alive, F.size("_active") / F.size("_level")).otherwise(0.0),
        "speech_rms": F.when(alive, F.col("_speech")).otherwise(0.0),
        "leading_silence": F.when(alive, F.least(seconds, first * FRAME_SECONDS)).otherwise(seconds),
        "trailing_silence": F.when(alive, F.greatest(F.lit(0.0), seconds - F.least(seconds, (last + 1) * FRAME_SECONDS))).otherwise(seconds),
        "snr_proxy_db": F.when(alive, F.least(F.lit(SNR_CAP), dbfs(F.col("_speech")) - dbfs(F.col("noise_rms")))).otherwise(0.0),
    }
    return d.withColumns(out).drop("_level", "_seconds", "_peak", "_flags", "_active", "_speech", "_sorted")


def fit_without_tiling(noise: Column, length: Column, offset: Column) -> Column:
    """ARR3: a stretch of noise as long as the speech; an error when the noise is too short."""
    ok = F.size(noise) >= length
    return F.when(ok, F.slice(noise, F.least(offset, F.size(noise) - length) + 1, length)).otherwise(F.raise_error(F.lit("noise is shorter than speech")))


def fit_by_tiling(noise: Column, length: Column, offset: Column) -> Column:
    """ARR2: noise repeated to the length, from an offset."""
    n = F.size(noise)
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(noise, (F.pmod(i + offset, n)).cast("int")))


def mix_at_snr(speech: Column, noise: Column, snr_db: Column) -> dict[str, Column]:
    """ARR4: speech plus noise scaled to a ratio in decibels, with the gain and the ratio achieved."""
    gain = rms(speech) / (rms(noise) * F.pow(F.lit(10.0), snr_db / 20.0))
    scaled = F.transform(noise, lambda v: v.cast("double") * gain)
    return {
        "mixed": F.zip_with(speech, scaled, lambda a, b: a.cast("double") + b),
        "gain": gain,
        "achieved_snr_db": 20.0 * F.log10(rms(speech) / rms(scaled)),
    }


def anti_clip(x: Column, limit: float = 0.99) -> dict[str, Column]:
    """ARR8: one gain that keeps the peak under a limit; 1 for silence."""
    peak = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    gain = F.when(peak > 0, F.least(F.lit(1.0), F.lit(limit) / peak)).otherwise(1.0)
    return {"gain": gain, "samples": F.transform(x, lambda v: v.cast("double") * gain)}


def pad_batch(x: Column, width: Column, fill: int = -100) -> Column:
    """ARR13: an array filled up to a width."""
    return F.concat(x, F.array_repeat(F.lit(fill).cast("int"), F.greatest(F.lit(0), width - F.size(x))))


def drop_shared_start(x: Column, start: int, shared: Column) -> Column:
    """ARR13: the leading start token dropped where a whole batch has it."""
    return F.when(shared & (F.get(x, F.lit(0)) == start), F.slice(x, F.lit(2), F.size(x))).otherwise(x)


def _seeded(seed: int) -> np.random.Generator:
    return np.random.default_rng(int(seed) & 0xFFFFFFFFFFFFFFFF)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def convolve(x: pd.Series, impulse: pd.Series, most: pd.Series) -> pd.Series:
    """ARR5: convolution with an impulse response of unit energy, cut to a length."""

    def one(a, b, n):
        if a is None or b is None or not len(a) or not len(b):
            return None
        b = np.asarray(b, float)
        energy = float(np.sqrt((b * b).sum()))
        return np.convolve(np.asarray(a, float), b / energy if energy else b)[: int(n)]

    return pd.Series([one(a, b, n) for a, b, n in zip(x, impulse, most, strict=True)])


def ratio(factor: float, most: int = 1000) -> tuple[int, int]:
    """FN27: a factor as a fraction of small numbers."""
    f = Fraction(factor).limit_denominator(most)
    return f.numerator, f.denominator


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def stretch(x: pd.Series, factor: pd.Series) -> pd.Series:
    """ARR7: length divided by a factor at the same pitch, by a phase vocoder (frames of 256, hop 64)."""

    def one(a, f):
        if a is None:
            return None
        a, n, hop = np.asarray(a, float), 256, 64
        if f == 1.0 or not len(a):
            return a
        w = np.hanning(n)
        padded = np.concatenate((np.zeros(n), a, np.zeros(2 * n)))
        z = np.stack([np.fft.rfft(w * padded[i : i + n]) for i in range(0, len(padded) - n, hop)])
        at = np.arange(0, len(z) - 1, f)
        advance = 2 * np.pi * hop * np.arange(z.shape[1]) / n
        phase, out, norm = np.angle(z[0]), np.zeros(len(at) * hop + n), np.zeros(len(at) * hop + n)
        for k, t in enumerate(at):
            i, part = int(t), t - int(t)
            size = (1 - part) * np.abs(z[i]) + part * np.abs(z[i + 1])
            out[k * hop : k * hop + n] += w * np.fft.irfft(size * np.exp(1j * phase), n)
            norm[k * hop : k * hop + n] += w * w
            turn = np.angle(z[i + 1]) - np.angle(z[i]) - advance
            phase = phase + advance + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
        out /= np.maximum(norm, 1e-3)
        skip = round(n / f)
        return out[skip : skip + max(1, round(len(a) / f))]

    return pd.Series([one(a, f) for a, f in zip(x, factor, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def change_speed(x: pd.Series, factor: pd.Series) -> pd.Series:
    """ARR6: resampled to length / factor by band-limited (Fourier) interpolation; factor 1 leaves a copy."""

    def one(a, f):
        if a is None:
            return None
        a = np.asarray(a, float)
        up, down = ratio(f)
        n = max(1, round(len(a) * down / up)) if len(a) else 0
        if f == 1.0 or n == len(a):
            return a
        z = np.fft.rfft(a)
        keep = n // 2 + 1
        z = z[:keep] if keep <= len(z) else np.concatenate((z, np.zeros(keep - len(z))))
        return np.fft.irfft(z, n) * (n / len(a))

    return pd.Series([one(a, f) for a, f in zip(x, factor, strict=True)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def mask_spectrum(mel: pd.Series, valid: pd.Series, seed: pd.Series, spec: pd.Series) -> pd.Series:
    """ARR11 and ARR12: bands of frequency (full width) and spans of time (within valid frames) set to 0.

    ``spec``: struct of frequency_width, frequency_masks, time_width, time_masks, time_share, probability.
    """

    def one(m, n, s, c):
        if m is None:
            return None
        x = np.array([np.asarray(r, np.float32) for r in m])
        g = _seeded(s)
        if g.random() >= c["probability"]:
            return list(x)
        n = min(int(n), x.shape[1])
        for _ in range(c["frequency_masks"]):
            w = int(g.integers(0, min(c["frequency_width"], x.shape[0]) + 1))
            a = int(g.integers(0, x.shape[0] - w + 1))
            x[a : a + w, :] = 0
        most = min(c["time_width"], int(c["time_share"] * n))
        for _ in range(c["time_masks"]):
            w = int(g.integers(0, most + 1))
            a = int(g.integers(0, n - w + 1))
            x[:, a : a + w] = 0
        return list(x)

    rows = spec.to_dict("records") if isinstance(spec, pd.DataFrame) else list(spec)
    return pd.Series([one(m, n, s, c) for m, n, s, c in zip(mel, valid, seed, rows, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def augment(x: pd.Series, noise: pd.Series, impulse: pd.Series, seed: pd.Series, condition: pd.Series) -> pd.Series:
    """ARR9 and ARR10: the kernels of a condition (clean, noise, rir, noise-rir, speed) with seeded draws, peak-limited."""

    def one(a, b, r, s, c):
        if a is None:
            return None
        a = np.asarray(a, float)
        if c == "clean":
            return a
        g = _seeded(s)
        if c == "speed":
            f = (0.9, 1.0, 1.1)[int(g.integers(0, 3))]
            n = max(1, round(len(a) / f))
            a = np.interp(np.linspace(0, len(a) - 1, n), np.arange(len(a)), a)
        if c in ("rir", "noise-rir") and r is not None and len(r):
            r = np.asarray(r, float)
            a = np.convolve(a, r / max(np.sqrt((r * r).sum()), TINY))[: len(a)]
        if c in ("noise", "noise-rir") and b is not None and len(b):
            b = np.resize(np.roll(np.asarray(b, float), -int(g.integers(0, len(b)))), len(a))
            ratio = 10 ** (g.uniform(5, 20) / 20)
            level = np.sqrt((b * b).mean())
            if level > 0:
                a = a + b * np.sqrt((a * a).mean()) / (level * ratio)
        peak = np.abs(a).max() if len(a) else 0.0
        return a * min(1.0, 0.99 / peak) if peak > 0 else a

    return pd.Series([one(*z) for z in zip(x, noise, impulse, seed, condition, strict=True)])
