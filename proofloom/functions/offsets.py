"""Offset-exact text primitives. Offsets are code points, start inclusive, end exclusive, counted from 0."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import utils as origins
from pyspark.sql import Column
from pyspark.sql import functions as F


def quickly(build: Callable) -> Callable:
    """A builder of large expressions that notes no place in the caller's code for each of their parts: that takes longer
    than making them."""

    @wraps(build)
    def run(*args, **kwargs):
        before = getattr(origins, "_enable_debugging_cache", None)
        if hasattr(origins, "_enable_debugging_cache"):
            origins._enable_debugging_cache = False
        try:
            return build(*args, **kwargs)
        finally:
            if hasattr(origins, "_enable_debugging_cache"):
                origins._enable_debugging_cache = before

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: Catalyst copies a column into every place of a lambda that names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK = 32  # entries that are folded one by one


Step = Callable[[Column, Column], Column]


def _fold(values: Column, zero: int, step: Step) -> Column:
    """What zero and the entries up to each one make, zero itself first."""
    return F.aggregate(values, F.array(F.lit(zero)), lambda acc, n: F.array_append(acc, step(F.element_at(acc, -1), n)))


def scan(values: Column, zero: int, step: Step) -> Column:
    """For an int array, what an associative step makes of zero and all entries before each one.

    Each step of a fold copies what it has so far; so more than BLOCK entries are folded in blocks, then the blocks' results, and
    the work stays near linear.
    """
    short = lambda a: F.slice(_fold(a, zero, step), F.lit(1), F.size(a))

    def blocks(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / F.lit(BLOCK)).cast("int")), lambda i: _fold(F.slice(a, i * BLOCK + 1, BLOCK), zero, step))
        inner = lambda x: F.slice(x, F.lit(1), F.size(x) - 1)
        return let(parts, lambda p: F.flatten(F.zip_with(p, short(F.transform(p, lambda x: F.element_at(x, -1))), lambda x, base: F.transform(inner(x), lambda s: step(base, s)))))

    return let(values, lambda a: F.when(F.size(a) <= BLOCK, short(a)).otherwise(blocks(a)))


def prefix_sums(lengths: Column) -> Column:
    """For an int array, the sum of all entries before each one."""
    return scan(lengths, 0, lambda a, b: a + b)


def first_of_runs(items: Column, same: Step) -> Column:
    """Of a sorted array, the first entry of each run of entries that are the same as the one before."""
    return let(items, lambda a: F.filter(a, lambda x, i: (i == 0) | ~same(F.get(a, i - 1), x)))


def ranks(positions: Column, starts: Column) -> Column:
    """For each of an int array of positions, how many of the starts are at or before it. One sort of both together."""
    marked = F.concat(F.transform(starts, lambda s: F.struct(s.alias("at"), F.lit(0).alias("asked"), F.lit(0).alias("i"))), F.transform(positions, lambda p, i: F.struct(p.alias("at"), F.lit(1).alias("asked"), i.alias("i"))))
    counted = let(F.sort_array(marked), lambda m: F.zip_with(m, prefix_sums(F.transform(m, lambda x: 1 - x["asked"])), lambda x, n: F.struct(x["asked"].alias("asked"), x["i"].alias("i"), n.alias("n"))))
    return F.transform(F.sort_array(F.transform(F.filter(counted, lambda x: x["asked"] == 1), lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n")))), lambda x: x["n"])


def tiles(segments: Column) -> Column:
    """Segments that tile a text as array of (start, end, text)."""
    starts = prefix_sums(F.transform(segments, F.length))
    return F.zip_with(segments, starts, lambda s, at: F.struct(at.alias("start"), (at + F.length(s)).alias("end"), s.alias("text")))


def find_all(text: Column, pattern: str | Column) -> Column:
    """All matches from left to right as array of (start, end, text). The pattern must not match the empty string."""
    own = pattern if isinstance(pattern, Column) else F.lit(pattern)
    parts = F.struct(F.split(text, own, -1).alias("gaps"), F.regexp_extract_all(text, own, F.lit(0)).alias("hits"))

    def located(p: Column) -> Column:
        spans = F.zip_with(F.slice(p["gaps"], 1, F.greatest(F.size(p["hits"]), F.lit(0))), p["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), h.alias("text")))
        return let(spans, lambda s: F.zip_with(s, prefix_sums(F.transform(s, lambda x: x["gap"] + x["len"])), lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"), x["text"].alias("text"))))

    return let(parts, located)


CHUNK = 8  # bits of a place in a chunk


def cutting(text: Column, body: Callable[[Column, Callable[[Column, Column], Column]], Column]) -> Column:
    """body(n, cut) with n the length of a text and cut(start, end) what stands there. Both a length and a substring walk the
    text from its beginning; it is cut in chunks once, so that many spans of a long text do not walk it many times."""
    parts = F.struct(F.length(text).alias("n"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK}}}"), F.lit(0)).alias("chunks"))

    def cut_of(p: Column) -> Callable[[Column, Column], Column]:
        def cut(start: Column, end: Column) -> Column:
            lo = F.shiftright(F.greatest(start, F.lit(0)), CHUNK)
            held = F.slice(p["chunks"], lo + 1, F.greatest(F.shiftright(end - 1, CHUNK) - lo, F.lit(0)) + 1)
            return F.when(start < 0, F.substring(text, start + 1, end - start)).otherwise(F.substring(F.array_join(held, ""), start - F.shiftleft(lo, CHUNK) + 1, end - start))

        return cut

    return let(parts, lambda p: body(p["n"], cut_of(p)))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def characters(text: Column) -> Column:
    """The code points as array; [] for ''."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def ngrams(items: Column, n: int, sep: str = "") -> Column:
    """Runs of n neighbours joined by sep; fewer than n items: all of them as one; none: []."""
    many = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), sep))
    return let(items, lambda a: F.when(F.size(a) >= n, many(a)).when(F.size(a) > 0, F.array(F.array_join(a, sep))).otherwise(F.array().cast("array<string>")))
