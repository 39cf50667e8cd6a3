"""Induced sorting of byte strings in whole-array steps: `induced` with tuples moved in blocks.

The priority queues hold, for each byte, a sequence of blocks of (position, common prefix) in order of arrival. All
tuples under the least byte leave together, and what they induce is dealt to the queues by a stable sort on the byte
before them, so each step handles a whole block. Blocks beyond `memory` entries wait in an unnamed scratch file of the
task. The string of names is sorted in memory by prefix doubling while it fits, else by the recursion of `induced`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from proofloom.llm import induced
from proofloom.llm.induced import Scratch
from proofloom.llm.textnum import mix

MEMORY = 1 << 23  # entries of blocks kept in memory
NAMES = 1 << 24  # names sorted in memory
FAR = np.int32(np.iinfo(np.int32).max - 1)


class BlockQueue:
    """Blocks of (position, common prefix) per symbol; the longest-kept go to disk beyond `memory` entries."""

    def __init__(self, scratch: Scratch, memory: int):
        self.scratch, self.memory, self.held = scratch, memory, 0
        self.blocks: list[list] = [[] for _ in range(256)]

    def put(self, symbol: int, pos: np.ndarray, common: np.ndarray) -> None:
        block = np.stack([pos, common]).astype(np.int32)
        if self.held + len(pos) > self.memory:
            self.blocks[symbol].append((self.scratch.put(block.tobytes()), len(pos)))
        else:
            self.held += len(pos)
            self.blocks[symbol].append(block)

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that is under the symbol now, in order of arrival."""
        blocks, self.blocks[symbol] = self.blocks[symbol], []
        if not blocks:
            return None
        out = []
        for b in blocks:
            if isinstance(b, tuple):
                b = np.frombuffer(self.scratch.get(b[0]), dtype=np.int32).reshape(2, b[1])
            else:
                self.held -= b.shape[1]
            out.append(b)
        both = out[0] if len(out) == 1 else np.concatenate(out, axis=1)
        return both[0], both[1]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number, first byte uppermost; zeros beyond the end."""
    x = np.zeros(len(data) + 8, dtype=np.uint64)
    x[: len(data)] = data
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return ((x[:-4] << np.uint64(32)) | x[4:])[: len(data)]


def block_hashes(data: np.ndarray, width: int = 64) -> np.ndarray:
    """Hash of the `width` bytes from each position that has so many; two adjacent words are folded at a time."""
    x = words_at(data)
    size = 8
    while size < width:
        x = mix(x[: max(0, len(x) - size)] * np.uint64(0x9E3779B97F4A7C15) ^ x[size:])
        size *= 2
    return x[: max(0, len(data) - width + 1)]


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, blocks: np.ndarray | None = None, enough: int | None = None) -> np.ndarray:
    """Common prefix of the suffixes at a and b, pair by pair; a differs from b. From `enough` on it is not followed
    further. blocks: hashes of 64 bytes, to skip equal stretches."""
    n = len(words)
    out = np.zeros(len(a), dtype=np.int64)
    x, y = a.astype(np.int64), b.astype(np.int64)
    active = np.arange(len(a))
    if blocks is not None and len(blocks):
        last = len(blocks) - 1
        while len(active):
            same = (np.maximum(x, y) <= last) & (blocks[np.minimum(x, last)] == blocks[np.minimum(y, last)])
            active, x, y = active[same], x[same] + 64, y[same] + 64
            out[active] += 64
            if enough is not None and len(active):
                more = out[active] < enough
                active, x, y = active[more], x[more], y[more]
        active = np.arange(len(a)) if enough is None else np.flatnonzero(out < enough)
        x, y = a[active].astype(np.int64) + out[active], b[active].astype(np.int64) + out[active]
    while len(active):
        inside = np.maximum(x, y) + 8 <= n
        same = inside & (words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)])
        rest = np.flatnonzero(~same)
        if len(rest):
            u, v = x[rest], y[rest]
            diff = np.where(np.maximum(u, v) < n, words[np.minimum(u, n - 1)] ^ words[np.minimum(v, n - 1)], np.uint64(1 << 63))
            top = np.zeros(len(rest), dtype=np.int64)
            for shift in range(56, -1, -8):  # equal bytes from the left
                top += (diff >> np.uint64(shift)) == 0
            out[active[rest]] += np.minimum(top, np.maximum(0, n - np.maximum(u, v)))
        active, x, y = active[same], x[same] + 8, y[same] + 8
        out[active] += 8
        if enough is not None and len(active):
            more = out[active] < enough
            active, x, y = active[more], x[more], y[more]
    return out


def name_pieces(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of the pieces; equal pieces share one. A piece that begins another is larger than it, but for the last."""
    m = len(starts)
    names = np.zeros(m, dtype=np.int64)
    active = np.arange(m)
    at = 0
    n = len(words)
    while len(active):
        left = lengths[active] - at  # bytes of the piece from here on; its end mark counts as the byte 255
        place = starts[active] + at
        w = np.where(place < n, words[np.minimum(place, n - 1)], np.uint64(0))
        fill = np.clip(8 - left, 0, 8).astype(np.uint64)
        ones = np.where(fill >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (fill * np.uint64(8))) - np.uint64(1))
        ones[active == m - 1] = 0  # the last piece ends with the text, which is less than any byte
        w = np.where(fill >= 8, ones, w | ones)
        order = np.lexsort((w, names[active]))
        ranked, group = w[order], names[active][order]
        new_group = np.r_[True, group[1:] != group[:-1]]
        new = new_group | np.r_[True, ranked[1:] != ranked[:-1]]
        index = np.arange(len(order))
        offset = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(new_group, index, 0))
        names[active[order]] = group + offset
        size = np.diff(np.r_[np.flatnonzero(new), len(order)])
        several = np.repeat(size > 1, size)
        again = np.zeros(len(order), dtype=bool)
        again[order] = several
        active = active[again & (left >= 8)]
        at += 8
    return names


def sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of numbers by prefix doubling; only unsettled groups are sorted again."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(m, dtype=np.int64)
    sorted_names = names[order]
    first = np.r_[True, sorted_names[1:] != sorted_names[:-1]]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(m), 0))
    k = 1
    while True:
        size = np.diff(np.r_[np.flatnonzero(first), m])
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        who = order[at]
        after = np.where(who + k < m, rank[np.minimum(who + k, m - 1)] + 1, 0)
        base = rank[who]
        again = np.lexsort((after, base))
        who, after, base = who[again], after[again], base[again]
        order[at] = who
        new_base = np.r_[True, base[1:] != base[:-1]]
        new = new_base | np.r_[True, after[1:] != after[:-1]]
        first = first.copy()
        first[at] = new
        rank[who] = np.maximum.accumulate(np.where(new, at, 0))
        k *= 2


def star_order(text: bytes, words: np.ndarray, stars: np.ndarray, scratch: Scratch, names_in_memory: int, blocks: np.ndarray | None, enough: int | None) -> tuple[np.ndarray, np.ndarray]:
    """S* positions in order of their suffixes, and common prefixes with the one before."""
    n = len(text)
    lengths = np.diff(np.r_[stars, n]) + 1
    lengths[-1] -= 1
    names = name_pieces(words, stars, lengths)
    if len(np.unique(names)) == len(names):
        order = np.argsort(names)
    elif len(names) <= names_in_memory:
        order = sort_names(names)
    else:
        dense = np.unique(names, return_inverse=True)[1] + 1
        order = np.fromiter((x >> induced._BITS for x in induced._sort(dense.tolist(), scratch)), dtype=np.int64, count=len(names))
    pos = stars[order]
    common = np.zeros(len(pos), dtype=np.int64)
    common[1:] = common_prefixes(words, pos[:-1], pos[1:], blocks, enough)
    return pos, common


class _Dealer:
    """Deals a block's preceding positions to the queue, with common prefixes from the minima since the last of each symbol."""

    def __init__(self, data: np.ndarray, queue: BlockQueue):
        self.data, self.queue = data, queue
        self.least = np.full(256, -1, dtype=np.int32)  # since the last tuple of the symbol; -1: there was none

    def deal(self, pos: np.ndarray, common: np.ndarray, wanted: np.ndarray) -> None:
        """wanted: which positions have a preceding one of the type that is being induced."""
        values = np.r_[common.astype(np.int32), FAR, FAR]
        at = np.flatnonzero(wanted)
        if not len(at):
            np.minimum(self.least, values[:-2].min(initial=FAR), out=self.least)
            return
        symbol = self.data[pos[at] - 1]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        head = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        low = np.empty(len(at), dtype=np.int64)
        low[1:] = at[:-1] + 1
        low[head] = 0
        mins = np.minimum.reduceat(values, np.stack([low, at + 1], axis=1).ravel())[::2]
        heads = symbol[head]
        mins[head] = np.minimum(mins[head], self.least[heads])
        np.minimum(self.least, values[:-2].min(), out=self.least)
        tail = np.r_[head[1:], len(at)]
        last = at[tail - 1] + 1
        rest = np.minimum.reduceat(values, np.stack([last, np.full(len(last), len(values) - 1)], axis=1).ravel())[::2]
        self.least[heads] = rest
        before = pos[at] - 1
        for s, lo, hi in zip(heads.tolist(), head.tolist(), tail.tolist(), strict=True):
            self.queue.put(s, before[lo:hi], mins[lo:hi] + 1)


def neighbours(text: bytes, memory: int = MEMORY, names_in_memory: int = NAMES, enough: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in falling order, as blocks of (start, common prefix with the one before, which is larger). A common
    prefix below `enough` is exact, of others only that much is known."""
    n = len(text)
    if not n:
        return
    scratch = Scratch()
    try:
        data = np.frombuffer(text, dtype=np.uint8)
        words = words_at(data)
        blocks = block_hashes(data) if enough is not None else None
        ends = np.flatnonzero(np.r_[data[1:] != data[:-1], True])
        rises = np.r_[data[np.minimum(ends + 1, n - 1)[:-1]] > data[ends[:-1]], False]
        smaller = np.repeat(rises, np.diff(np.r_[-1, ends]))  # S suffixes
        stars = np.flatnonzero(np.r_[False, smaller[1:] & ~smaller[:-1]])
        seeds, seed_common = star_order(text, words, stars, scratch, names_in_memory, blocks, enough) if len(stars) else (stars, stars)
        bounds = np.searchsorted(data[seeds], np.arange(257))

        queue = BlockQueue(scratch, memory)
        dealer = _Dealer(data, queue)
        larger = BlockQueue(scratch, memory)
        queue.put(int(data[n - 1]), np.array([n - 1]), np.array([0]))
        dealer.least[data[n - 1]] = FAR
        for c in range(256):
            last, first = -1, True
            while (block := queue.take(c)) is not None:
                pos, common = block
                if first:
                    common = common.copy()
                    common[0] = 0  # another symbol stands before it
                    first = False
                larger.put(c, pos, common)
                last = int(pos[-1])
                dealer.deal(pos, common, (pos > 0) & (data[pos - 1] >= c))
            lo, hi = bounds[c], bounds[c + 1]
            if lo < hi:
                pos, common = seeds[lo:hi], seed_common[lo:hi].copy()
                common[0] = common_prefixes(words, np.array([last]), pos[:1])[0] if last >= 0 else 0
                dealer.deal(pos, common, np.ones(len(pos), dtype=bool))

        queue = BlockQueue(scratch, memory)
        dealer = _Dealer(data, queue)
        for c in range(255, -1, -1):
            last, first = -1, True
            while (block := queue.take(c)) is not None:
                pos, common = block
                if first:
                    common = common.copy()
                    common[0] = 0
                    first = False
                yield pos, common
                last = int(pos[-1])
                dealer.deal(pos, common, (pos > 0) & smaller[pos - 1])
            block = larger.take(c)
            if block is not None:
                pos, up = block[0][::-1], block[1][::-1]
                common = np.r_[common_prefixes(words, np.array([last]), pos[:1])[0] if last >= 0 else 0, up[:-1]]
                yield pos, common
                dealer.deal(pos, common, (pos > 0) & smaller[pos - 1])
    finally:
        scratch.close()
