"""Word shingles of whole texts in numpy: hashed sets, digests and min-max signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from brinewave.llm.common import flat_bytes

#: words per shingle
WIDTH = 5
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base, grown to the longest batch seen."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.up) < n:
            self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE), dtype=np.uint64)])
        return self.up[:n]


_powers = _Powers()


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column in row order, and the row offsets into them."""
    data, offsets = flat_bytes(column)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (edge | ~before))
    after = np.concatenate([inside[1:], [False]])
    last = np.concatenate([edge[1:], [True]])
    ends = np.flatnonzero(inside & (last | ~after)) + 1
    up = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)])
    # brought to one power of the base, so that equal words at any place agree
    value = (total[ends] - total[starts]) * up[n - starts]
    # and to one base for every batch: multiply by the inverse of the last power
    value *= _inverse_power(n)
    hashes = mix(value ^ mix((ends - starts).astype(np.uint64)))
    return hashes, np.searchsorted(starts, offsets)


_INVERSE = pow(int(_BASE), -1, 1 << 64)


def _inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(_INVERSE, n, 1 << 64))


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    hashes, rows = words(column)
    if len(hashes) >= width:
        rolled = sum(hashes[k : len(hashes) - width + 1 + k] * _PLACE[k] for k in range(width))
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    for start, end in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if end - start >= width:
            yield np.unique(rolled[start : end - width + 1])
        elif end > start:
            n = end - start
            whole = np.sum(hashes[start:end] * _PLACE[:n], dtype=np.uint64) + np.uint64(n)
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class MinMax:
    """Signatures that keep the smallest and the largest value under each hash function.

    Both are as likely to agree as the sets' Jaccard similarity, and their errors are
    negatively correlated, so ``count`` hash functions give ``2 * count`` values.
    """

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = rng.integers(0, 1 << 64, count, dtype=np.uint64)

    def __call__(self, items: np.ndarray, block: int = 2048) -> np.ndarray:
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(len(self.factor), np.uint64)
        for start in range(0, len(items), block):
            values = items[None, start : start + block] * self.factor[:, None] + self.offset[:, None]
            np.minimum(low, values.min(axis=1), out=low)
            np.maximum(high, values.max(axis=1), out=high)
        return np.concatenate([low, high])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` values; a key holds its band's number."""
    bands = signature.reshape(-1, rows)
    place = mix(np.arange(1, rows + 1, dtype=np.uint64))
    number = mix(np.arange(len(bands), dtype=np.uint64) + np.uint64(1 << 32))
    return mix((mix(bands) * place | np.uint64(1)).sum(axis=1, dtype=np.uint64) ^ number)


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()
