"""Multi-string Burrows-Wheeler transforms over super-symbols, and their merge by interleave refinement.

A string is cut, at each of ``step`` phases, into symbols of ``step`` bytes; a symbol is the hash of its bytes,
and any order of hashes serves as the alphabet's. The transform of a shard lists its suffixes in the order of
their first ``depth`` symbols, each with the symbol before it. Two transforms are merged without sorting their
suffixes again: start with all of one before all of the other; in each round read the symbols before the
suffixes in the present order and deal the origins out by symbol, stably. After k rounds the interleave is
right to k symbols, and the round in which two neighbours first part is their common prefix.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _P) -> np.ndarray:
    """The first ``n`` powers; those of a few megabytes are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def rolling(text: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` bytes."""
    n = len(text)
    if n < width:
        return np.zeros(0, np.uint64)
    inverse = pow(_P, -1, 1 << 64)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(n, inverse), out=s[1:])
    h = (s[width:] - s[:-width]) * powers(n - width + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _stable(symbols: np.ndarray) -> np.ndarray:
    """The permutation that sorts non-negative 31-bit symbols stably."""
    key = symbols.astype(np.int64)
    key <<= 32
    key |= np.arange(len(symbols), dtype=np.int64)
    key.sort()
    key &= 0xFFFFFFFF
    return key.astype(np.int32)


class Transform:
    """suffix: positions in order; before: the symbol before each, -1 at the start of a string; ends: how many
    suffixes are empty (they come first)."""

    def __init__(self, suffix: np.ndarray, before: np.ndarray, ends: int):
        self.suffix, self.before, self.ends = suffix, before, ends


def build(starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, step: int, depth: int) -> Transform:
    """The transform of the strings at ``starts``; ``symbols[p]`` is the rank of the symbol at p.

    Sorted by the same rounds, from one symbol on; a suffix is known by its position, and an empty one by the
    position where its symbol would begin.
    """
    spans = sizes + 1
    # a shard holds less than 2 GB, so 32 bits tell its places apart
    place = np.arange(spans.sum(), dtype=np.int32)
    position = np.repeat((starts - np.concatenate(([0], np.cumsum(spans)[:-1]))).astype(np.int32), spans) + place
    empty = np.repeat((starts + sizes).astype(np.int32), spans) - position < step
    ends = np.flatnonzero(empty).astype(np.int32)
    before_of = np.where(position - np.repeat(starts.astype(np.int32), spans) >= step, place - np.int32(step), np.int32(-1))
    sym = np.full(len(position), -1, np.int32)
    sym[~empty] = symbols[position[~empty]]
    order = place
    for _ in range(depth):
        q = before_of[order]
        q = q[q >= 0]
        order = np.concatenate((ends, q[_stable(sym[q])]))
    q = before_of[order]
    return Transform(position[order], np.where(q >= 0, sym[q], np.int32(-1)), len(ends))


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The merged transform, and for each place the common prefix, in symbols up to ``depth``, with the place before."""
    n, ends = len(a.suffix) + len(b.suffix), a.ends + b.ends
    first = np.repeat(np.array([False, True]), [a.ends, b.ends])
    origin = np.repeat(np.array([False, True]), [len(a.suffix), len(b.suffix)])
    prefix = np.full(n, depth, np.int32)
    prefix[0] = 0
    block = np.zeros(n, np.int32)
    for k in range(depth):
        s = np.empty(n, np.int32)
        s[~origin], s[origin] = a.before, b.before
        keep = np.flatnonzero(s >= 0)
        s = s[keep]
        dealt = _stable(s)
        s, come = s[dealt], keep[dealt]
        origin = np.concatenate((first, origin[come]))
        # neighbours part where the symbol changes, or what follows was parted before; empty suffixes always do
        parted = np.ones(n, bool)
        behind = block[come]
        parted[ends + 1 :] = (s[1:] != s[:-1]) | (behind[1:] != behind[:-1])
        prefix[parted & (prefix == depth)] = k
        block = np.cumsum(parted, dtype=np.int32)
    suffix, before = np.empty(n, np.int32), np.empty(n, np.int32)
    suffix[~origin], suffix[origin] = a.suffix, b.suffix
    before[~origin], before[origin] = a.before, b.before
    return Transform(suffix, before, ends), prefix


def repeated(texts: list[bytes], length: int, step: int, shards: int = 2, weights: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text the starts of the ``length``-byte strings that begin at two places or more among all texts.

    ``length`` is a multiple of ``step``. Texts are dealt into shards; their transforms are merged in pairs. A text of
    weight n stands for n equal ones, so an interval may hold two places though it holds one suffix.
    """
    depth = length // step
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    _, symbols = np.unique(rolling(text, step), return_inverse=True)
    parts = [build(starts[i::shards], sizes[i::shards], symbols, step, depth) for i in range(shards) if len(starts[i::shards])]
    if len(parts) == 1:
        parts.append(Transform(np.zeros(0, np.int32), np.zeros(0, np.int32), 0))
    while len(parts) > 1:
        merged = [merge(parts[i], parts[i + 1], depth) for i in range(0, len(parts) - 1, 2)]
        parts = [t for t, _ in merged] + parts[2 * len(merged) :]
    order, prefix = parts[0].suffix, merged[0][1]
    alike = prefix >= depth  # with the place before
    inside = alike | np.concatenate((alike[1:], [False]))
    if weights is not None:
        own = np.searchsorted(starts, order, "right") - 1
        inside |= (weights[own] > 1) & (starts[own] + sizes[own] - order >= length) & (np.arange(len(order)) >= parts[0].ends)
    found = np.sort(order[inside])
    cuts = np.searchsorted(found, starts)
    return [f - s for f, s in zip(np.split(found, cuts[1:]), starts, strict=True)]
