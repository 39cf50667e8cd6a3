"""Exact substring dedup: bytes covered by a string of `LENGTH` bytes that starts anywhere else, by suffix sorting.

Sharding. Every window of LENGTH bytes has a smallest hash among its GRAM-byte strings, so equal windows have equal
smallest hashes. A document is cut into pieces: longest stretches of windows with one smallest hash. Pieces with equal
bytes collapse before anything else; a piece that stands twice is repeated throughout. Only pieces whose hash also has
another piece with other bytes (or that may repeat within themselves) need sorting: they are fetched, dealt into shards
by hash, and each shard is suffix-sorted by external induced sorting (`blocksort`, whose recursion is `induced`). A window is repeated if the common
prefix with a neighbour in suffix order is LENGTH or more.

Nothing is kept per byte outside a shard. A hash whose pieces exceed SHARD bytes together, such as that of a line in a third
of all documents, is split: in equal windows the gram stands at the same place, so either half or more of the window's other
bytes stand before it, or more than half behind it. Windows of the first kind are dealt by the bytes in that half before
the gram, the others by those behind; what is still too large is split again about the longer string now known to be shared.
After nine such steps the string is the window. No window meets fewer partners by it.

Passages of WORDS words that stand in several documents are reported beside (`shared_passages`): they may be shorter than
LENGTH bytes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.blocksort import neighbours
from proofloom.llm.common import BITMAP_BITS, documents, drop_staged, filled_bitmap, key_bitmap, staged, temporary, text_or_empty, wrapped
from proofloom.llm.textnum import Tokens, mix, powers, slices

LENGTH = 400
GRAM = 128
SLICE = 1 << 19
SHARD = 1 << 19  # bytes sorted together, and the most of one hash that are not split
WORDS = 51  # of a passage
ANCHOR = 26  # words whose least hash stands for a passage
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(301, 557, dtype=np.uint64))
_SHIFT = bytes(min(255, b + 2) for b in range(256))  # bytes of UTF-8 become 2 to 247; 1 parts pieces


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes from each position."""
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=np.uint64, out=prefix[1:])
    n = len(data) - gram + 1
    return mix((prefix[gram:] - prefix[:n]) * powers(_BACK, len(data))[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def pieces(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int, bool]]:
    """(text, start, number of windows, smallest hash, may repeat within itself) of all pieces."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < length:
        return []
    hashes = gram_hashes(data, gram)
    least = sliding_min(hashes, length - gram + 1)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= ends[doc]
    cut = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]]
    start = np.flatnonzero(cut & inside)
    if not len(start):
        return []
    at = np.flatnonzero(cut | ~inside)
    stop = np.append(at, len(least))[np.searchsorted(at, start, side="right")]
    # hashes that stand at two places of a text: pieces of it may repeat within themselves
    mark = np.zeros(1 << 16, dtype=bool)
    mark[(least[start] >> np.uint64(48)).astype(np.int64)] = True
    found = np.flatnonzero(mark[(hashes >> np.uint64(48)).astype(np.int64)])
    owner = np.repeat(np.arange(len(texts)), sizes)[found]
    held, times = np.unique(hashes[found] ^ mix(owner.astype(np.uint64)), return_counts=True)
    twice = held[times > 1]
    own = np.isin(least[start] ^ mix(doc[start].astype(np.uint64)), twice)
    first = ends - sizes
    return list(zip(doc[start].tolist(), (start - first[doc[start]]).tolist(), (stop - start).tolist(), least[start].view(np.int64).tolist(), own.tolist(), strict=True))


def repeated_spans(parts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each part, the maximal spans covered by strings of `length` bytes that start elsewhere in any part."""
    text = b"\x01".join(p.translate(_SHIFT) for p in parts)
    again = np.zeros(len(text) + 1, dtype=np.int8)
    last = -1
    for at, common in neighbours(text, enough=length):
        close = common >= length
        again[at[close]] = 1
        again[np.r_[last, at[:-1]][close]] = 1
        last = at[-1]
    out, base = [], 0
    for p in parts:
        starts = np.flatnonzero(again[base : base + len(p) - length + 1])  # later ones run into the next part
        out.append(merged([(int(s), int(s) + length) for s in starts]))
        base += len(p) + 1
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


PIECE = [*((c, pa.int64()) for c in ("h", "c1", "c2", "times", "t1", "t2")), ("start", pa.int32()), ("bytes", pa.binary())]


def _batch(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], [name for name, _ in columns])


def gram_segments(data: bytes, h: int, length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(first byte, end, place of the gram in it, its end there): a piece cut by which gram of the hash is the first in a
    window."""
    at = np.flatnonzero(gram_hashes(np.frombuffer(data, dtype=np.uint8), gram).view(np.int64) == h).tolist()
    windows, out, first = len(data) - length + 1, [], 0
    for g in at:
        if first >= windows:
            break
        last = min(g, windows - 1)
        out.append((first, last + length, g - first, g - first + gram))
        first = last + 1
    return out


def halves(data: bytes, lo: int, hi: int, length: int) -> list[tuple[int, bytes, int, int]]:
    """(first byte, bytes, lo, hi): the windows of data, which all hold its bytes lo to hi, by where most of their other
    bytes stand; lo to hi are then the bytes that a window shares with all windows equal to it and their like."""
    windows, other = len(data) - length + 1, length - (hi - lo)
    if not other:
        return [(0, data, lo, hi)]
    half = -(-other // 2)
    out = []
    if lo >= half:
        out.append((0, data[: min(lo - half, windows - 1) + length], lo - half, hi))
    first = max(0, lo - half + 1)
    if first < windows:
        out.append((first, data[first:], lo - first, hi - first + other - half + 1))
    return out


def split_hot(parts: DataFrame, length: int, gram: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of which the hashes are too frequent, as (smaller pieces, spans that are repeated throughout)."""
    kinds = f"{', '.join(f'{c} long' for c in ('h', 'c1', 'c2', 'times', 't1', 't2'))}, start int, bytes binary, lo int, hi int"

    def split(batches):
        for batch in batches:
            rows = []
            for h, times, t1, t2, start, data, lo, hi in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7, 8, 9)), strict=True):
                for at, end, a, b in gram_segments(data, h, length, gram) if lo < 0 else [(0, len(data), lo, hi)]:
                    for more, piece, x, y in halves(data[at:end], a, b, length):
                        key = xxhash.xxh3_64_intdigest(piece[x:y]) ^ (y - x)
                        c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(piece), dtype=np.int64).tolist()
                        rows.append((key - (1 << 64) if key >> 63 else key, c1, c2, times, t1, t2, start + at + more, piece, x, y))
            yield _batch(rows, [*PIECE, ("lo", pa.int32()), ("hi", pa.int32())])

    left = parts.withColumn("lo", F.lit(-1)).withColumn("hi", F.lit(-1))
    done, whole = [], []
    while True:
        # pieces that equal another one are repeated throughout; one of them stays, for others that share part of it
        cut = staged(left.mapInArrow(split, kinds), "hot-pieces")
        equal = cut.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.max("times").alias("most")).withColumn("several", F.greatest("n", "most"))
        again = cut.filter("times = 1").join(equal.filter("n > 1"), ["h", "c1", "c2"], "left_semi")
        whole.append(again.select("t1", "t2", F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.octet_length("bytes")).alias("hi"))).alias("spans")))
        kept = cut.dropDuplicates(["h", "c1", "c2"]).drop("times").join(equal.select("h", "c1", "c2", F.col("several").alias("times")), ["h", "c1", "c2"])
        sizes = cut.select("h", "c1", "c2", F.octet_length("bytes").cast("long").alias("size"), (F.col("hi") - F.col("lo")).alias("shared")).distinct().groupBy("h").agg(F.count("*").alias("kinds"), F.sum("size").alias("total"), F.max("shared").alias("shared")).filter("kinds > 1")
        kept = staged(kept.join(sizes, "h"), "hot-kept")
        large = (F.col("total") > shard) & (F.col("shared") < length)
        done.append(kept.filter(~large).select(*[c for c, _ in PIECE]))
        left = kept.filter(large).select(*[c for c, _ in PIECE], "lo", "hi")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, whole)


def repeated_substrings(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """t1, t2, spans: for each text with repeated bytes (named by two hashes) its spans, possibly overlapping."""
    named = df.select(text_or_empty(text).alias("text")).select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("\x02"), "text").alias("t2"))
    long_ones = named.filter(F.octet_length("text") >= length)

    def cut(batches):
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(0)]
            t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for lo, hi in slices(texts, SLICE):
                part = texts[lo:hi]
                rows = pieces(part, length, gram)
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(part[d][s : s + n - 1 + length]) for d, s, n, _, _ in rows]), dtype=np.int64).reshape(-1, 2)
                doc = np.array([r[0] for r in rows], dtype=np.int64) + lo
                arrays = [pa.array(t1[doc]), pa.array(t2[doc]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.bool_()), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
                yield pa.RecordBatch.from_arrays(arrays, ["t1", "t2", "start", "n", "h", "own", "c1", "c2"])

    cuts = staged(long_ones.mapInArrow(cut, "t1 long, t2 long, start int, n int, h long, own boolean, c1 long, c2 long"), "pieces")
    place = F.struct("t1", "t2", "start")
    contents = staged(cuts.groupBy("h", "c1", "c2").agg(F.count("*").alias("times"), F.min(place).alias("at"), F.first("n").alias("n"), F.max("own").alias("own")), "contents")
    twice = contents.filter("times > 1").select("h", "c1", "c2")
    # copies of a text have the same pieces: each is named once, or every copy would get the spans of all of them
    again = cuts.join(twice, ["h", "c1", "c2"], "left_semi").select("t1", "t2", "start", "n").distinct()
    whole = again.select("t1", "t2", F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n") + F.lit(length - 1)).alias("hi"))).alias("spans"))

    total = F.sum(F.col("n").cast("long") + F.lit(length - 1))
    open_hashes = contents.groupBy("h").agg(F.count("*").alias("kinds"), F.max("own").alias("own"), (total > shard).alias("hot")).filter("kinds > 1 OR own").select("h", "hot")
    asked = contents.join(open_hashes, "h").select("h", "hot", "c1", "c2", "times", "n", "at.*")
    per_text = staged(asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "hot", "c1", "c2", "times", "start", "n")).alias("want")), "wanted")
    fetched = long_ones.filter(key_bitmap(per_text, "t1")("t1")).join(per_text, ["t1", "t2"])

    def fetch(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = []
                for t1, t2, t, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                    data = t.as_py().encode()
                    rows += [(w["h"], w["c1"], w["c2"], w["times"], t1, t2, w["start"], data[w["start"] : w["start"] + w["n"] - 1 + length], w["hot"]) for w in want]
                yield _batch(rows, [*PIECE, ("hot", pa.bool_())])

    # copies of a text all answer; one answer of each piece stays
    kinds = "h long, c1 long, c2 long, times long, t1 long, t2 long, start int, bytes binary"
    parts = fetched.select("t1", "t2", "text", "want").mapInArrow(fetch, f"{kinds}, hot boolean").dropDuplicates(["h", "c1", "c2"])
    if not open_hashes.filter("hot").isEmpty():
        parts = staged(parts, "parts")
        split, also = split_hot(parts.filter("hot").drop("hot"), length, gram, shard)
        parts, whole = parts.filter("NOT hot").drop("hot").unionByName(split), whole.unionByName(also)
    dealt = parts.repartition("h").sortWithinPartitions("h", "c1", "c2")

    def sort(batches):
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            spans = repeated_spans([r[3] for r in held], length)
            rows = [(r[0], r[1], [{"lo": r[2] + lo, "hi": r[2] + hi} for lo, hi in s]) for r, s in zip(held, spans, strict=True) if s and r[4] == 1]
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], ["t1", "t2", "spans"])

        for batch in batches:
            for h, times, t1, t2, start, data in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7)), strict=True):
                if h != last and size >= shard:
                    yield flush()
                    held.clear()
                    size = 0
                held.append((t1, t2, start, data, times))
                size += len(data)
                last = h
        if held:
            yield flush()

    partly = dealt.mapInArrow(sort, "t1 long, t2 long, spans array<struct<lo: int, hi: int>>")
    return whole.unionByName(partly).groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def passage_windows(texts: list[bytes], words: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, least hash of `anchor` words in it) of each run of `words` words."""
    t = Tokens(texts)
    n = len(t.hashes) - words + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    prefix = np.zeros(len(t.hashes) + 1, dtype=np.uint64)
    np.cumsum(t.hashes * powers(_BASE, len(t.hashes)), dtype=np.uint64, out=prefix[1:])
    back = powers(_BACK, len(t.hashes))
    runs = lambda k: mix((prefix[k:] - prefix[: len(prefix) - k]) * back[: len(prefix) - k])
    inside = t.doc[:n] == t.doc[words - 1 :]
    return t.doc[:n][inside], runs(words)[inside], sliding_min(runs(anchor), words - anchor + 1)[inside]


def shared_passages(df: DataFrame, text: str = "text", words: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """t1: names of the texts with a run of `words` words, A-Z lower-cased, that another row's text has too.

    Runs are compared only where the least hash among their stretches of `anchor` words stands at several places; equal
    runs have equal ones. A task tells the runs of equal texts once; those are known by their number.
    """
    long_ones = df.select(text_or_empty(text).alias("text")).select("text", F.xxhash64("text").alias("t1")).filter(F.octet_length("text") >= 2 * words - 1)

    def found(batches, asked=None):
        known: set[int] = set()
        for batch in batches:
            names = batch.column(1).to_numpy(zero_copy_only=False)
            fresh = []
            for i, name in enumerate(names.tolist()):
                if name not in known:
                    known.add(name)
                    fresh.append(i)
            texts = [batch.column(0)[i].as_py().encode() for i in fresh]
            own = names[fresh]
            for lo, hi in slices(texts, SLICE):
                doc, run, least = passage_windows(texts[lo:hi], words, anchor)
                new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])][: len(doc)]
                if asked is None:
                    yield pa.RecordBatch.from_arrays([pa.array(own[lo + doc[new]]), pa.array(least[new].view(np.int64))], ["t1", "a"])
                    continue
                place = least >> np.uint64(64 - BITMAP_BITS)
                held = (asked[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                yield pa.RecordBatch.from_arrays([pa.array(own[lo + doc[held]]), pa.array(run[held].view(np.int64))], ["t1", "run"])

    several = [F.min("t1").alias("first"), F.max("t1").alias("last")]
    places = staged(long_ones.mapInArrow(found, "t1 long, a long"), "anchors")
    anchors = places.groupBy("a").agg(*several).filter("first != last")
    asked = df.sparkSession.sparkContext.broadcast(filled_bitmap(anchors, "a"))
    runs = staged(long_ones.mapInArrow(lambda batches: found(batches, asked.value), "t1 long, run long"), "runs")
    again = staged(runs.groupBy("run").agg(*several).filter("first != last").select("run"), "repeated-runs")
    copied = long_ones.groupBy("t1").agg(F.count("*").alias("n")).filter("n > 1").join(places.select("t1").distinct(), "t1", "left_semi").select("t1")
    told = runs.join(again, "run", "left_semi").select("t1")
    out = staged(told.unionByName(copied).distinct(), "passages")
    for t in (places, runs, again):
        drop_staged(t)
    return out


def without_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """df with n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) and shares_passage (whether another row has
    WORDS words of the text in a run), which replace columns so named.

    Null text is empty; texts under `length` bytes lose nothing; equal texts lose everything if they have `length` bytes
    or more. Texts may have any length below 2 GiB, ids may be null or repeated. Other columns are kept. An empty table
    gives an empty one.
    """
    df = df.drop("n_bytes", "n_removed", "n_spans", "kept", "shares_passage")
    with temporary():
        passages = shared_passages(df, text).withColumn("shares_passage", F.lit(True))
        spans = staged(repeated_substrings(df, text, length, shard=shard).join(passages, "t1", "full_outer"), "spans", keep=True)
    named = wrapped(df, text=text_or_empty(text))
    named = named.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit("\x02"), "text")).withColumn("hit", key_bitmap(spans, "t1")("t1"))
    kinds = "n_bytes long, n_removed long, n_spans long, kept binary"

    @F.pandas_udf(kinds)
    def remove(texts: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, given in zip(texts, all_spans, strict=True):
            data = t.encode()
            found = merged([(s["lo"], s["hi"]) for s in given]) if given is not None else []
            at, kept = 0, []
            for lo, hi in found:
                kept.append(data[at:lo])
                at = hi
            kept.append(data[at:])
            left = b"".join(kept)
            rows.append((len(data), len(data) - len(left), len(found), left))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    # texts without repeats, most of them, are neither shuffled nor sent to Python again
    shares = F.coalesce("shares_passage", F.lit(False)).alias("shares_passage")
    told = spans.select(F.col("t1").alias("s1"), F.col("t2").alias("s2"), "spans", "shares_passage")
    hit = named.filter("hit").join(told, (F.col("t1") == F.col("s1")) & F.coalesce(F.col("t2") == F.col("s2"), F.lit(True)), "left").withColumn("out", remove("text", "spans")).select("row.*", "out.*", shares)
    zero = F.lit(0).cast("long")
    rest = named.filter("NOT hit").select("row.*", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("text", "UTF-8").alias("kept"), F.lit(False).alias("shares_passage"))
    return hit.unionByName(rest)


def op3_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")
