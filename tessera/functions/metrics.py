"""Word and character error metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import words

#: Types as objects: names of types can only be read with a session.
_SPLIT = T.StructType([T.StructField(n, T.LongType()) for n in ("substitutions", "deletions", "insertions", "hits")])


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two arrays of words, in generated code: each distinct word of the pair becomes one
    character, and the builtin distance works on those. Pairs have at most some 50,000 distinct words."""
    v = F.array_distinct(F.concat(a, b))
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(v, w) + 255), 4, "0")), "UTF-16BE")
    text = lambda x: F.array_join(F.transform(x, code), "")
    return F.levenshtein(text(a), text(b))


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """FN12 and FN13, the total: substitutions, deletions and insertions together."""
    return edit_distance(words(reference), words(hypothesis))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """FN14: without reference words, the number of inserted words."""
    r, h = words(reference), words(hypothesis)
    return F.when(F.size(r) == 0, F.size(h).cast("double")).otherwise(edit_distance(r, h) / F.size(r))


def align(reference: list, hypothesis: list) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, hits) of one least-cost alignment, by rows of the edit table.

    Of equal costs the alignment with most hits is taken, so the split is a function of the pair.
    """
    n, m = len(reference), len(hypothesis)
    wide = n + m + 1
    # cost * wide - hits, one number to minimise
    row = np.arange(m + 1, dtype=np.int64) * wide
    h = np.empty(m, object)
    h[:] = hypothesis
    for i in range(n):
        same = np.fromiter((x == reference[i] for x in hypothesis), bool, m)
        reach = np.minimum(row[:-1] + np.where(same, -1, wide), row[1:] + wide)
        reach = np.concatenate(([row[0] + wide], reach))
        # insertions run along the row: subtract the slope, take the running least, add it back
        slope = np.arange(m + 1, dtype=np.int64) * wide
        row = np.minimum.accumulate(reach - slope) + slope
    best = int(row[-1])
    cost = -(-best // wide)
    hits = cost * wide - best
    # n = hits + subs + dels, m = hits + subs + ins, cost = subs + dels + ins
    subs = n + m - 2 * hits - cost
    return subs, n - hits - subs, m - hits - subs, hits


@F.pandas_udf(_SPLIT)
def _split(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], columns=["substitutions", "deletions", "insertions", "hits"])


@F.pandas_udf(_SPLIT)
def _split_characters(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(list(x or ""), list(y or "")) for x, y in zip(a, b, strict=True)], columns=["substitutions", "deletions", "insertions", "hits"])


def alignment(reference: Column, hypothesis: Column, characters: bool = False) -> Column:
    """FN12 and FN13 with the split of errors, as a struct."""
    return (_split_characters if characters else _split)(reference, hypothesis)


def micro_rate(errors: Column, total: Column) -> Column:
    """AG2: 100 * sum of errors / sum of reference words; null when there are none."""
    return F.when(F.sum(total) > 0, 100.0 * F.sum(errors) / F.sum(total))
