"""Suffix arrays with common-prefix values by external induced sorting.

A suffix is L if it is larger than the one after it, S if smaller, S* if S after an L. S* suffixes are sorted first: the
pieces between them are sorted and named, and the string of names is sorted recursively. L suffixes then come out in
order from a priority queue of tuples keyed by (first symbol, order of the suffix after it), S suffixes in falling order
from a second one. Each tuple carries its common-prefix value with the tuple before it under the same symbol: one more
than the least value between the two suffixes that induced them.

Tuples under one symbol arrive in the order in which they leave, so a queue keeps one sequence per symbol. Sequences,
sorted runs of pieces and the results live in memory up to BLOCK entries each and beyond that in one unnamed scratch
file, which no other task reads and which goes when the sort ends.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

BLOCK = 1 << 16
_BITS = 31
_LOW = (1 << _BITS) - 1


class Scratch:
    """Blocks of bytes in an unnamed temporary file, opened at the first write."""

    def __init__(self, block: int = BLOCK):
        self.block, self.file, self.end = block, None, 0

    def put(self, data: bytes) -> tuple[int, int]:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        self.file.write(data)
        self.end += len(data)
        return self.end - len(data), len(data)

    def get(self, place: tuple[int, int]) -> bytes:
        self.file.seek(place[0])
        return self.file.read(place[1])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Run:
    """A sequence of 64-bit integers that is appended to and then read forwards or backwards."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.tail, self.blocks = scratch, array("q"), []

    def append(self, x: int) -> None:
        self.tail.append(x)
        if len(self.tail) >= self.scratch.block:
            self.blocks.append(self.scratch.put(self.tail.tobytes()))
            self.tail = array("q")

    def _block(self, place: tuple[int, int]) -> array:
        out = array("q")
        out.frombytes(self.scratch.get(place))
        return out

    def __iter__(self) -> Iterator[int]:
        for place in self.blocks:
            yield from self._block(place)
        yield from self.tail

    def __reversed__(self) -> Iterator[int]:
        yield from reversed(self.tail)
        for place in reversed(self.blocks):
            yield from reversed(self._block(place))


class SymbolQueue:
    """Priority queue of integers keyed by (symbol, arrival). Its long sequences are on disk."""

    def __init__(self, scratch: Scratch, falling: bool):
        self.scratch, self.sign = scratch, -1 if falling else 1
        self.heads: dict[int, deque] = {}
        self.rest: dict[int, deque] = {}  # blocks on disk, then the block being filled
        self.symbols: list[int] = []

    def push(self, symbol: int, x: int) -> None:
        head = self.heads.get(symbol)
        if head is None:
            self.heads[symbol] = deque((x,))
            heapq.heappush(self.symbols, self.sign * symbol)
            return
        rest = self.rest.get(symbol)
        if rest is None:
            head.append(x)
            if len(head) >= self.scratch.block:
                self.rest[symbol] = deque((array("q"),))
            return
        rest[-1].append(x)
        if len(rest[-1]) >= self.scratch.block:
            rest[-1] = self.scratch.put(rest[-1].tobytes())
            rest.append(array("q"))

    def first(self) -> int | None:
        return self.sign * self.symbols[0] if self.symbols else None

    def drain(self, symbol: int) -> Iterator[int]:
        """Takes everything under the symbol, also what is pushed meanwhile."""
        while True:
            head = self.heads[symbol]
            while head:
                yield head.popleft()
            rest = self.rest.get(symbol)
            if rest is None:
                break
            block = rest.popleft()
            if isinstance(block, tuple):
                data = array("q")
                data.frombytes(self.scratch.get(block))
                block = data
            if not rest:
                del self.rest[symbol]
            self.heads[symbol] = deque(block)
        del self.heads[symbol]
        self.symbols.remove(self.sign * symbol)
        heapq.heapify(self.symbols)


class Minima:
    """Least of the values seen since a time, for values that arrive one by one."""

    def __init__(self):
        self.times: list[int] = []
        self.values: list[int] = []
        self.now = -1

    def add(self, value: int) -> None:
        self.now += 1
        values, times = self.values, self.times
        while values and values[-1] >= value:
            values.pop()
            times.pop()
        values.append(value)
        times.append(self.now)

    def since(self, time: int) -> int:
        return self.values[bisect_right(self.times, time)]


def _sorted_pieces(pieces: Iterable[tuple[bytes, int]], scratch: Scratch) -> Iterator[tuple[bytes, int]]:
    """Sorted runs of at most BLOCK pieces, merged."""
    runs, part = [], []

    def stored(places: list) -> Iterator[tuple[bytes, int]]:
        for place in places:
            yield from pickle.loads(scratch.get(place))

    for piece in pieces:
        part.append(piece)
        if len(part) >= scratch.block:
            part.sort()
            step = max(1, scratch.block // 64)
            runs.append(stored([scratch.put(pickle.dumps(part[i : i + step])) for i in range(0, len(part), step)]))
            part = []
    part.sort()
    return heapq.merge(*runs, part) if runs else iter(part)


def _common(s: Sequence[int], i: int, j: int) -> int:
    n, start = len(s) - max(i, j), i
    step = 32
    while n >= step and s[i : i + step] == s[j : j + step]:
        i, j, n = i + step, j + step, n - step
    while n > 0 and s[i] == s[j]:
        i, j, n = i + 1, j + 1, n - 1
    return i - start


def _star_order(s: Sequence[int], stars: Sequence[int], scratch: Scratch) -> Iterator[tuple[int, int]]:
    """(position, common prefix with the one before) of the S* suffixes in order."""
    wide = not isinstance(s, bytes)

    def piece(j: int) -> bytes:
        part = s[stars[j] : stars[j + 1] + 1] if j + 1 < len(stars) else s[stars[j] :]
        if not wide:
            return part + (b"\xff" if j + 1 < len(stars) else b"\x00")
        data = array("I", part)
        data.byteswap()
        return data.tobytes() + (b"\xff\xff\xff\xff" if j + 1 < len(stars) else b"\0\0\0\0")

    names, last, name, order = array("q", bytes(8 * len(stars))), None, 0, Run(scratch)
    for key, j in _sorted_pieces(((piece(j), j) for j in range(len(stars))), scratch):
        if key != last:
            last, name = key, name + 1
        names[j] = name
        order.append(j << _BITS)
    if name < len(stars):
        order = _sort(names.tolist(), scratch)
    before = -1
    for x in order:
        j, equal = x >> _BITS, x & _LOW
        common = 0
        if before >= 0:
            # `equal` names agree; the shorter of both is never cut off there, as the last piece is the only one of its name
            skip = stars[j + equal] - stars[j]
            common = skip + _common(s, stars[before] + skip, stars[j] + skip)
        yield stars[j], common
        before = j


def _sort(s: Sequence[int], scratch: Scratch) -> Run:
    """position << 31 | common prefix with the suffix before, in ascending order. Symbols are 1 and up."""
    n = len(s)
    smaller = bytearray(n)  # 1: S, smaller than the suffix after it
    for i in range(n - 2, -1, -1):
        smaller[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and smaller[i + 1])
    stars = array("q", (i for i in range(1, n) if smaller[i] and not smaller[i - 1]))
    seeds = _star_order(s, stars, scratch) if stars else iter(())

    # L suffixes, ascending
    queue, minima, pushed = SymbolQueue(scratch, False), Minima(), {}
    larger = Run(scratch)
    minima.add(0)  # the empty suffix
    if n:
        queue.push(s[n - 1], (n - 1) << _BITS)
        pushed[s[n - 1]] = 0
    seed = next(seeds, None)
    while True:
        c = queue.first()
        if seed is not None and (c is None or s[seed[0]] < c):
            c = s[seed[0]]
        if c is None:
            break
        last = -1
        if c in queue.heads:
            for x in queue.drain(c):
                i = x >> _BITS
                minima.add(x & _LOW)
                larger.append(x)
                last = i
                if i and s[i - 1] >= c:
                    d = s[i - 1]
                    queue.push(d, (i - 1) << _BITS | (1 + minima.since(pushed[d]) if d in pushed else 0))
                    pushed[d] = minima.now
        while seed is not None and s[seed[0]] == c:
            i, common = seed
            if last >= 0:
                common, last = _common(s, last, i), -1
            minima.add(common)
            d = s[i - 1]
            queue.push(d, (i - 1) << _BITS | (1 + minima.since(pushed[d]) if d in pushed else 0))
            pushed[d] = minima.now
            seed = next(seeds, None)

    # S suffixes, descending, between the L suffixes
    queue, minima, pushed = SymbolQueue(scratch, True), Minima(), {}
    falling = Run(scratch)  # position << 31 | common prefix with the larger neighbour
    back = reversed(larger)
    item = next(back, None)
    while True:
        c = queue.first()
        if item is not None and (c is None or s[item >> _BITS] > c):
            c = s[item >> _BITS]
        if c is None:
            break
        last = -1
        if c in queue.heads:
            for x in queue.drain(c):
                i = x >> _BITS
                minima.add(x & _LOW)
                falling.append(x)
                last = i
                if i and smaller[i - 1]:
                    d = s[i - 1]
                    queue.push(d, (i - 1) << _BITS | (1 + minima.since(pushed[d]) if d in pushed else 0))
                    pushed[d] = minima.now
        after = 0
        while item is not None and s[item >> _BITS] == c:
            i = item >> _BITS
            common = _common(s, last, i) if last >= 0 else after
            last, after = -1, item & _LOW
            minima.add(common)
            falling.append(i << _BITS | common)
            if i and smaller[i - 1]:
                d = s[i - 1]
                queue.push(d, (i - 1) << _BITS | (1 + minima.since(pushed[d]) if d in pushed else 0))
                pushed[d] = minima.now
            item = next(back, None)
    out, before = Run(scratch), -1
    above = 0
    for x in reversed(falling):
        out.append((x >> _BITS) << _BITS | (above if before >= 0 else 0))
        before, above = x, x & _LOW
    return out


def suffix_array(text: bytes, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(start, common prefix with the suffix before) of all suffixes of text in ascending order. Bytes 1 to 254 only."""
    scratch = Scratch(block)
    try:
        for x in _sort(text, scratch):
            yield x >> _BITS, x & _LOW
    finally:
        scratch.close()
