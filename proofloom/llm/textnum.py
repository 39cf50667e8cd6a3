"""Whole-array text primitives: token boundaries, token hashes and hash tables in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, kept for the next call."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


class Tokens:
    """Words of texts, A-Z lower-cased if `lower`, split at the bytes that `blank` marks, those of a line feed among them.
    hashes: 64 bits of each word; doc: number of its text."""

    def __init__(self, texts: Sequence[bytes], lower: bool = True, blank: np.ndarray = _BLANK):
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        blank = blank[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.r_[0, edge]
        self.starts, self.ends = edge[0::2], edge[1::2]
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=np.uint64, out=prefix[1:])
        back = powers(_BASE_INVERSE, len(data))
        self.hashes = mix((prefix[self.ends] - prefix[self.starts]) * back[self.starts])
        self.doc = np.searchsorted(np.cumsum(sizes), self.starts, side="right")
        self.n_docs = len(texts)


def slices(texts: Sequence[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit bytes; a longer text makes a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def distinct_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


class Lookup:
    """Open addressing over distinct 64-bit keys; get() raises KeyError for a key that is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3 // 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.used = np.zeros(1 << bits, dtype=bool)
        self.values = np.zeros(1 << bits, dtype=values.dtype)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = ~self.used[at]
            self.keys[at[free]] = keys[left[free]]
            won = free & (self.keys[at] == keys[left])
            self.used[at[won]] = True
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        miss = np.flatnonzero((self.keys[at] != keys) | ~self.used[at])
        while len(miss):
            if not self.used[at[miss]].all():
                raise KeyError("a key is missing from the table")
            at[miss] = (at[miss] + 1) & self.mask
            miss = miss[(self.keys[at[miss]] != keys[miss]) | ~self.used[at[miss]]]
        return self.values[at]
