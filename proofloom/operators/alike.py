"""Fingerprints of many texts as arrays, and classes of alike ones within a task.

A mean of `least` bounds each of its parts: with the other two at 1 a part must reach what is left. Texts are compared by
whole columns of numbers, from the cheapest part to the dearest: bits of SimHash, equal slots, then sizes and common 3-grams,
each only where the mean can still be reached.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from proofloom.functions.hashing import MERSENNE, coefficients
from proofloom.operators.parse import TOKEN

SLOTS = 128
SIM, MINS, GRAM = 0.25, 0.35, 0.40  # parts of the mean
SLACK = 1e-9

_TOKEN = re.compile(TOKEN.replace(r"\x{4e00}", "一").replace(r"\x{9fff}", "鿿").replace(r"[\p{L}]+", r"[^\W\d_]+"))
_MARK = re.compile(r"[\W_]")


def tokens_of(text: str) -> list[str]:
    out: list[str] = []
    for piece in _TOKEN.findall(text):
        if "一" <= piece[0] <= "鿿":
            out += [piece[i : i + 2] for i in range(len(piece) - 1)] if len(piece) > 1 else [piece]
        else:
            out.append(piece.lower())
    return out


@lru_cache(maxsize=1 << 16)
def _hash64(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def grams_of(text: str, n: int = 3) -> frozenset[str]:
    letters = _MARK.sub("", text)
    return frozenset(letters[i : i + n] for i in range(max(1, len(letters) - n + 1))) if letters else frozenset()


@lru_cache(maxsize=8)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.array(coefficients(n), dtype=np.uint64).T[:, :, None]
    return a >> np.uint64(24), a & np.uint64(0xFFFFFF), b


def min_slots(low: list[int], n: int) -> np.ndarray:
    """hashing.minhash of 32-bit hashes in numpy: a is cut in halves of 24 bits; times 2**24 is a rotation modulo 2**61 - 1."""
    if not low:
        return np.zeros(n, dtype=np.int64)
    upper_a, lower_a, b = _factors(n)
    h, m = np.array(low, dtype=np.uint64), np.uint64(MERSENNE)
    folded = lambda x: (x & m) + (x >> np.uint64(61))
    upper = folded(upper_a * h)
    turned = ((upper & np.uint64((1 << 37) - 1)) << np.uint64(24)) | (upper >> np.uint64(37))
    value = folded(folded(turned + lower_a * h + b))
    return (np.where(value >= m, value - m, value).min(axis=1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sim_bits(counts: Counter) -> int:
    """SimHash of token counts: 64 votes, a bit where the vote is above 0."""
    if not counts:
        return 0
    hashes = np.array([_hash64(t) for t in counts], dtype=np.uint64)
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    votes = np.array(list(counts.values()), dtype=np.int64) @ (2 * bits.astype(np.int64) - 1)
    return int((votes > 0).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def shingle_numbers(text: str, k: int = 3) -> np.ndarray:
    """The 32-bit hashes that MinHash of `signature_of` takes, with repeats."""
    toks = tokens_of(text)
    if not toks:
        return np.zeros(0, dtype=np.int64)
    made = b"".join(hashlib.md5(" ".join(toks[i : i + k]).encode()).digest() for i in range(max(1, len(toks) - k + 1)))
    return np.frombuffer(made, dtype=">u4")[1::4].astype(np.int64)


@dataclass(frozen=True)
class Fingerprint:
    """SimHash, MinHash and 3-grams of one text, as `similarity.fingerprints` makes them, in Python."""

    simhash: int
    minhash: np.ndarray
    grams: frozenset[str]


def signature_of(text: str, n: int = SLOTS, k: int = 3) -> tuple[int, np.ndarray]:
    """SimHash and MinHash of one text."""
    toks = tokens_of(text)
    shingles = {" ".join(toks[i : i + k]) for i in range(max(1, len(toks) - k + 1))} if toks else set()
    return sim_bits(Counter(toks)), min_slots([_hash64(s) & 0xFFFFFFFF for s in shingles], n)


def fingerprint_of(text: str, n: int = SLOTS, k: int = 3) -> Fingerprint:
    return Fingerprint(*signature_of(text, n, k), grams_of(text))


def mean_of(sim, mins, gram):
    """The weighted mean of the three parts (P09), of numbers or arrays."""
    return SIM * sim + MINS * mins + GRAM * gram


def scores_of(a: Fingerprint, b: Fingerprint) -> tuple[float, float, float, float]:
    """SimHash, MinHash and 3-gram similarity and their weighted mean."""
    sim = 1 - (a.simhash ^ b.simhash).bit_count() / 64
    mins = float((a.minhash == b.minhash).mean())
    both = len(a.grams | b.grams)
    gram = len(a.grams & b.grams) / both if both else 0.0
    return sim, mins, gram, mean_of(sim, mins, gram)


def gram_columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of the distinct 3-grams of each text, as `grams_of` makes them, by text; grams are numbers of this
    collection. Marks hold no code 0, so it fills up texts of one or two letters."""
    letters = [x.ljust(3, "\0") if x else x for x in (_MARK.sub("", t) for t in texts)]
    codes = np.frombuffer("".join(letters).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    sizes = np.array([len(x) for x in letters], dtype=np.int64)
    n = np.maximum(sizes - 2, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n)
    names, gram = np.unique((codes[at] << 42) | (codes[at + 1] << 21) | codes[at + 2], return_inverse=True)
    pairs = np.unique(owner * max(1, len(names)) + gram)
    return pairs // max(1, len(names)), pairs % max(1, len(names))


FEW, LOOKS = 8, 256  # texts that one is compared with at first, and before it counts as meeting one


def meeting(texts: list[str], need: float) -> list[int]:
    """Places of the texts whose 3-grams share `need` of their union with those of another one, and of a few more.

    Of two such sets in one order, rarest first, the first elements, as many as that share lets differ and one more, have one
    in common. What meets another one there is compared with it whole; one that meets more than LOOKS others and has
    found none like it is left in, so that the work for a text is bounded and none is lost.
    """
    if need <= 0:
        return list(range(len(texts)))
    owner, gram = gram_columns(texts)
    if not len(gram):
        return []
    counts, sizes = np.bincount(gram), np.bincount(owner, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    order = np.lexsort((gram, counts[gram], owner))
    o, g = owner[order], gram[order]
    heads = sizes - np.ceil(need * sizes - SLACK).astype(np.int64) + 1
    head = (np.arange(len(o)) - first[o] < heads[o]) & (counts[g] > 1)  # those of one set alone come first and meet nothing
    o, g = o[head], g[head]
    met = np.bincount(g, minlength=len(counts))
    o, g = o[met[g] > 1], g[met[g] > 1]
    if not len(o):
        return []
    posts, place = o[np.argsort(g, kind="stable")], np.cumsum(np.where(met > 1, met, 0)) - np.where(met > 1, met, 0)
    like, mark = np.zeros(len(texts), dtype=bool), np.zeros(len(counts), dtype=bool)
    asked, starts = np.unique(o, return_index=True)
    for i, lo, hi in zip(asked.tolist(), starts.tolist(), [*starts[1:].tolist(), len(o)], strict=True):
        if like[i]:
            continue
        own = g[lo:hi]
        mine = gram[first[i] : first[i] + sizes[i]]
        mark[mine] = True
        for most in (FEW, LOOKS):
            n = np.minimum(met[own], most + 1)
            others, times = np.unique(posts[np.arange(n.sum()) + np.repeat(place[own] - (np.cumsum(n) - n), n)], return_counts=True)
            left = (others > i) | like[others]  # an earlier one that is like none has met this one
            left &= (others != i) & (np.minimum(sizes[others], sizes[i]) >= need * np.maximum(sizes[others], sizes[i]) - SLACK)
            others, times = others[left], times[left]
            some = others[np.argsort(-times, kind="stable")[:most]]
            if len(some):
                k = sizes[some]
                held = mark[gram[np.arange(k.sum()) + np.repeat(first[some] - (np.cumsum(k) - k), k)]]
                shared = np.add.reduceat(held, np.cumsum(k) - k, dtype=np.int64)
                good = some[shared >= need * (k + sizes[i] - shared) - SLACK]
                like[good] = True
                like[i] = len(good) > 0
            whole = n.max() <= most and len(others) <= most
            if like[i] or whole:
                break
        like[i] |= not whole
        mark[mine] = False
    return np.flatnonzero(like).tolist()


class Prints:
    """Fingerprints of texts in columns; grams are numbers of this collection."""

    def __init__(self, texts: list[str], grams: list[frozenset[str]]):
        made: dict[str, tuple[int, np.ndarray]] = {}
        for t in texts:
            if t not in made:
                made[t] = signature_of(t)
        self.sim = np.array([made[t][0] for t in texts], dtype=np.uint64)
        self.slots = np.stack([made[t][1] for t in texts]).astype(np.uint32)
        self.brief = self.slots.astype(np.uint16)  # as many slots are equal at least
        self.sizes = np.array([len(g) for g in grams], dtype=np.int64)
        names = {g: i for i, g in enumerate({g for s in grams for g in s})}
        self.ids = np.array([names[g] for s in grams for g in s], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.mark = np.zeros(len(names), dtype=bool)

    def equal_slots(self, j: int, others: np.ndarray) -> np.ndarray:
        """How many slots are equal in their lower halves, at least as many as in whole."""
        same = (self.brief[others] == self.brief[j]).view(np.uint64).sum(axis=1)
        return ((same * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)

    def means(self, j: int, others: np.ndarray, sim: float, least: float) -> np.ndarray:
        """The mean of j with each of others, or -1 where it stays under `least` or SimHash under `sim`."""
        out = np.full(len(others), -1.0)
        share = 1 - np.bitwise_count(self.sim[others] ^ self.sim[j]).astype(np.int64) / 64
        small, large = np.minimum(self.sizes[others], self.sizes[j]), np.maximum(self.sizes[others], self.sizes[j])
        most = np.divide(small, large, out=np.zeros(len(others)), where=large > 0)
        at = np.flatnonzero((share >= sim) & (mean_of(share, 1.0, most) >= least - SLACK))
        mins = self.equal_slots(j, others[at]) / SLOTS
        keep = mean_of(share[at], mins, most[at]) >= least - SLACK
        at = at[keep]
        mins = (self.slots[others[at]] == self.slots[j]).mean(axis=1)
        keep = mean_of(share[at], mins, most[at]) >= least - SLACK
        at, mins = at[keep], mins[keep]
        if len(at):
            own = self.ids[self.first[j] : self.first[j + 1]]
            self.mark[own] = True
            sizes = self.sizes[others[at]]
            place = np.repeat(self.first[others[at]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            held = np.concatenate([[0], np.cumsum(self.mark[self.ids[place]])])
            ends = np.cumsum(sizes)
            shared = held[ends] - held[ends - sizes]
            self.mark[own] = False
            both = sizes + len(own) - shared
            out[at] = mean_of(share[at], mins, np.divide(shared, both, out=np.zeros(len(at)), where=both > 0))
            out[out < least] = -1.0
        return out


def alike_classes(texts: list[str], sim: float = 0.85, least: float = 0.9) -> list[tuple[int, int, int, float]]:
    """(class, first, second, mean) of each text that is a near duplicate of an earlier one: the first such, and the first text
    of its class, which holds all that links join (A13).

    One row a text, however many are alike. A text is compared with one class after the other, with early texts first, and
    what shares a class with a hit is not looked at again: alike texts cost one comparison each, others the bits of their
    SimHash. All pairs of links are those a comparison of all pairs finds, up to links within a class.
    """
    need = max(0.0, (least - SIM - MINS) / GRAM)
    active = meeting(texts, need)
    if len(active) < 2:
        return []
    prints = Prints([texts[i] for i in active], [grams_of(texts[i]) for i in active])
    label = np.arange(len(active))  # the first text of the class
    found = []
    for j in range(1, len(active)):
        left = np.flatnonzero(np.bitwise_count(prints.sim[:j] ^ prints.sim[j]) <= 64 * (1 - sim) + SLACK)
        hits: list[tuple[int, float]] = []
        step = 1
        while len(left):
            some, rest = left[:step], left[step:]
            means = prints.means(j, some, sim, least)
            good = np.flatnonzero(means >= 0)
            if not len(good):
                left, step = rest, min(step * 8, 1 << 13)
                continue
            i = int(some[good[0]])
            hits.append((i, float(means[good[0]])))
            left = left[step:] if step == 1 else left[good[0] + 1 :]
            left = left[label[left] != label[i]]
        if hits:
            first, mean = min(hits)
            classes = np.unique(label[[i for i, _ in hits]])
            for c in classes[1:]:
                label[:j][label[:j] == c] = classes[0]
            label[j] = classes[0]
            found.append((first, j, mean))
    return [(active[label[j]], active[i], active[j], m) for i, j, m in found]
