"""Text functions: normalisation, splitting, diagnostics.

Builtins wherever they are exact. Unicode normal forms have no builtin, so texts with characters beyond
ASCII go through an Arrow function, and only those: the ASCII branch stays in generated code.
"""

from __future__ import annotations

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: apostrophe forms that become '
APOSTROPHES = "‘’‚‛ʼ`´"
_ASCII = r"^[\x00-\x7F]*$"


def _clean_v1(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).lower()
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PNSC" else c for c in folded).split())


def _clean_v2(text: str) -> str:
    folded = unicodedata.normalize("NFC", text).casefold()
    out = []
    for c in folded:
        if c in APOSTROPHES or c == "'":
            out.append("'")
        elif unicodedata.category(c)[0] in "LMN":
            out.append(c)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


@F.pandas_udf(T.StringType())
def _unicode_v1(s: pd.Series) -> pd.Series:
    return s.map(_clean_v1, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unicode_v2(s: pd.Series) -> pd.Series:
    return s.map(_clean_v2, na_action="ignore")


def _ascii_only(c: Column, native: Column, general) -> Column:
    plain = c.rlike(_ASCII)
    return F.when(c.isNull() | plain, native).otherwise(general(F.when(~plain, c)))


def normalize_v1(c: Column) -> Column:
    """FN1: compatibility form, lower case, no punctuation, numbers, signs or control characters, single spaces."""
    native = F.trim(F.regexp_replace(F.lower(c), r"[^a-z]+", " "))
    return _ascii_only(c, native, _unicode_v1)


def normalize_v2(c: Column) -> Column:
    """FN2: composed form, case-folded, letters, marks, numbers and apostrophes kept, single spaces."""
    native = F.trim(F.regexp_replace(F.lower(F.translate(c, "`", "'")), r"[^a-z0-9']+", " "))
    return _ascii_only(c, native, _unicode_v2)


def basic_normalize(c: Column) -> Column:
    """FN6: lower case, marks kept, signs and punctuation to spaces. What the library behind the original did is
    not stated anywhere, so this is FN2 without its apostrophes."""
    return F.trim(F.regexp_replace(F.replace(normalize_v2(c), F.lit("'"), F.lit(" ")), " +", " "))


def only_characters(c: Column, allowed: str) -> Column:
    """FN3: whether a text has characters of a class only (regular-expression class body)."""
    return c.rlike(f"^[{allowed}]*$")


def has_number(c: Column) -> Column:
    """FN4."""
    return c.rlike(r"\p{N}")


def words(c: Column) -> Column:
    """FN5: words between white space; no words in an empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def legacy_upper(c: Column) -> Column:
    """FN7: upper case without . , ! ? and without spaces."""
    return F.translate(F.upper(c), ". ,!?", "")


@F.pandas_udf(T.DoubleType())
def _ratio(s: pd.Series) -> pd.Series:
    def one(t):
        raw = t.encode()
        return len(raw) / len(zlib.compress(raw)) if raw else None

    return s.map(one, na_action="ignore").astype("Float64").astype("float64")


def compression_ratio(c: Column) -> Column:
    """FN8: bytes over compressed bytes; null for an empty text."""
    return F.when(F.length(c) > 0, _ratio(c))


def ngrams(w: Column, n: int) -> Column:
    """Runs of n words, each as one string: the array zipped with itself shifted, in one pass."""
    none = F.array().cast("array<string>")
    out = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
    for k in range(1, n):
        out = F.zip_with(out, F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) >= n, out).otherwise(none)


def repeated_fraction(w: Column, n: int) -> Column:
    """FN9: share of n-grams that repeat an earlier one; 0 when there is none."""
    some = F.size(w) >= n
    total = F.size(w) - (n - 1)
    return F.when(some, (total - F.size(F.array_distinct(ngrams(w, n)))) / total).otherwise(F.lit(0.0))


def longest_run(w: Column) -> Column:
    """WN6: the longest run of equal consecutive words."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(w, start, step, lambda s: s["best"])


def with_diagnostics(df: DataFrame, text: str, duration: Column) -> DataFrame:
    """FN10 without the compression ratio (FN8). Words are split once, in a step of their own."""
    t = F.col(text)
    d = df.withColumn("_w", words(t)).withColumn("_bare", F.length(F.regexp_replace(t, r"(?U)\s", "")))
    w, n, bare = F.col("_w"), F.size("_w"), F.col("_bare")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return d.withColumns({
        "empty_text": n == 0,
        "word_count": n,
        "character_count": bare,
        "words_per_second": n / duration,
        "characters_per_second": bare / duration,
        "unique_word_ratio": F.when(n > 0, F.size(F.array_distinct(w)) / n),
        "maximum_consecutive_word_run": longest_run(w),
        "repeated_bigram_fraction": repeated_fraction(w, 2),
        "repeated_trigram_fraction": repeated_fraction(w, 3),
        "non_letter_fraction_raw": F.when(F.length(t) > 0, (bare - letters) / F.length(t)),
    }).drop("_w", "_bare")


def disagreement(a: Column, b: Column) -> Column:
    """FN11: edits over the longer length; 0 for two empty texts."""
    return F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))
