"""Benchmark decontamination by spaced-seed hashing.

A seed looks at a stretch of words through a fixed mask that ignores some of them, so words replaced at ignored places
don't hide a copied passage: wherever as many words of a run are replaced as SIMILARITY admits, some mask sees none of
them. Hashes of the masked words of all training positions and of all benchmark
positions are joined; around each hit the words on the hit's diagonal are compared and the hit counts if some RUN of
words (or the whole item, if shorter) holds at least SIMILARITY equal words. An item with fewer words than RUN is sought
whole, through masks of its own length; below MIN_WORDS words an item matches nothing.

Training positions are many and benchmark positions few: a bitmap of the benchmark's hashes with a fixed number of bits
drops nearly all training positions before the shuffle; what it passes wrongly the join drops. Rows of the join carry the
hashes of the words around the position, so a hit is verified where it is found. Items that are equal around a seed share
it; a verified hit then counts for each of them.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.common import documents, staged, text_or_empty, wrapped
from proofloom.llm.textnum import Tokens, mix, slices

#: Fixed masks: 1 looks at a word, 0 ignores it. For any two words of a RUN one of them fits in and ignores both.
MASKS = ("110110010111", "111001101011", "101111000111", "111010110101", "101110101001", "1000011111100", "0011101011100")
#: Words that the masks of items of 5 to 12 words look at.
WEIGHTS = {5: 4, 6: 4, 7: 4, 8: 4, 9: 6, 10: 6, 11: 6, 12: 7}
SPAN = 12
RUN = 13
SIMILARITY = 0.8
MIN_WORDS = 5
BITMAP_BITS = 26  # 8 MB, whatever the benchmark's size
SLICE = 1 << 19
SIDE = RUN - 1  # words of context on both sides of a seed: every run that touches it
WIDE = SIDE + SPAN + SIDE


def _offsets(mask: str) -> np.ndarray:
    return np.flatnonzero([c == "1" for c in mask])


@cache
def short_masks(size: int) -> tuple[np.ndarray, ...]:
    """Offsets of masks for items of `size` words: for any words that SIMILARITY lets differ, one ignores them all."""
    differ = size - int(np.ceil(SIMILARITY * size))
    left = set(combinations(range(size), differ))
    ignored = [(z, set(combinations(z, differ))) for z in combinations(range(size), size - WEIGHTS[size])]
    out = []
    while left:
        z, covered = max(ignored, key=lambda x: len(x[1] & left))
        left -= covered
        out.append(np.setdiff1d(np.arange(size), z))
    return tuple(out)


_SALT = mix(np.arange(1, 257, dtype=np.uint64))


def _combine(hashes: np.ndarray, at: np.ndarray, offsets: np.ndarray, kind: int) -> np.ndarray:
    out = np.full(len(at), kind, dtype=np.uint64)
    for o in offsets:
        out = mix(out ^ hashes[at + o] * _SALT[o])
    return out


def seeds(t: Tokens, short: tuple[int, ...] = (), whole_items: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, length) of every seed: all masks at every position where they fit in one text, with length RUN;
    for each length in `short`, its masks over every such stretch (with whole_items: only of texts of that length)."""
    n = len(t.hashes)
    found = []

    def stretches(size: int) -> np.ndarray:
        at = np.arange(max(0, n - size + 1))
        return at[t.doc[at] == t.doc[at + size - 1]]

    for kind, mask in enumerate(MASKS):
        at = stretches(len(mask))
        found.append((_combine(t.hashes, at, _offsets(mask), kind), at, np.full(len(at), RUN)))
    per_text = np.bincount(t.doc, minlength=t.n_docs)
    for size in short:
        at = stretches(size)
        if whole_items:
            at = at[per_text[t.doc[at]] == size]
        for number, offsets in enumerate(short_masks(size)):
            found.append((_combine(t.hashes, at, offsets, 64 * size + number), at, np.full(len(at), size)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def surroundings(t: Tokens, at: np.ndarray, missing: int) -> np.ndarray:
    """32 bits of the WIDE words from SIDE before each position; `missing` beyond the text's ends."""
    place = at[:, None] + np.arange(-SIDE, SPAN + SIDE)
    inside = (place >= 0) & (place < len(t.hashes))
    place = np.clip(place, 0, max(0, len(t.hashes) - 1))
    inside &= t.doc[place] == t.doc[at][:, None]
    words = (t.hashes[place] & np.uint64(0xFFFFFFFE)).astype(np.uint32)
    return np.where(inside, words, np.uint32(missing))


def verified(train: np.ndarray, bench: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the overlap around each hit is close enough. bench holds 1 and train 3 beyond their texts' ends."""
    equal = train == bench
    ok = np.zeros(len(train), dtype=bool)
    need = -(-RUN * SIMILARITY // 1)
    runs = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
    close = (runs[:, RUN:] - runs[:, :-RUN]) >= need
    ok |= close.any(axis=1)
    # a whole item of fewer than RUN words
    item_words = (bench != 1).sum(axis=1)
    short = item_words < RUN
    ok |= short & (equal.sum(axis=1) >= np.ceil(SIMILARITY * item_words)) & (item_words >= MIN_WORDS)
    return ok & (length > 0)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows, dtype=np.uint32)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def benchmark_seeds(bench: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, h, size, around: seeds of distinct item texts; equal texts are the item with the smallest key."""
    kind = bench.schema[key].dataType.simpleString()
    items = bench.select(F.col(key).alias("item"), text_or_empty(text).alias("text")).groupBy("text").agg(F.min("item").alias("item")).select("item", "text")

    def run(batches):
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(1)]
            for lo, hi in slices(texts, SLICE):
                t = Tokens(texts[lo:hi])
                h, at, size = seeds(t, tuple(range(MIN_WORDS, RUN)), whole_items=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + t.doc[at])), pa.array(h.view(np.int64)), pa.array(size.astype(np.int32)), _binary(surroundings(t, at, 1))], ["item", "h", "size", "around"])

    return items.mapInArrow(run, f"item {kind}, h long, size int, around binary").distinct()


def contaminated(df: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", bench_key: str = "item_id", bench_text: str = "text") -> DataFrame:
    """doc, n_items, first_item, n_hits for each document that shares a passage with the benchmark, and no other rows.

    Texts are read whole, whatever their length. Null and empty texts share nothing; rows of equal key count together; an empty benchmark or table gives no rows.
    """
    owned = staged(benchmark_seeds(bench, bench_key, bench_text).withColumn("near", F.xxhash64("around")), "benchmark-seeds")
    known = owned.select("h", "near", "size", "around").dropDuplicates(["h", "near"])
    filled = known.select(F.shiftrightunsigned("h", 64 - BITMAP_BITS).alias("x")).select(F.shiftright("x", 6).alias("w"), F.expr("shiftleft(1L, CAST(x & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    rows = filled.toPandas()  # 2**20 rows at most
    bitmap[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    short = tuple(sorted(r["size"] for r in known.select("size").filter(F.col("size") < RUN).distinct().collect()))
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    doc_type = df.schema[key].dataType.simpleString()

    def probe(batches):
        bits = shared.value
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(1)]
            for lo, hi in slices(texts, SLICE):
                t = Tokens(texts[lo:hi])
                h, at, _ = seeds(t, short)
                place = h >> np.uint64(64 - BITMAP_BITS)
                hit = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                h, at = h[hit], at[hit]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + t.doc[at])), pa.array(h.view(np.int64)), _binary(surroundings(t, at, 3))], ["doc", "h", "words"])

    hits = df.select(F.col(key).alias("doc"), text_or_empty(text)).mapInArrow(probe, f"doc {doc_type}, h long, words binary").join(known, "h").select("doc", "h", "near", "size", "words", "around")

    def verify(batches):
        for batch in batches:
            train, around = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, WIDE) for i in (4, 5))
            ok = verified(train, around, batch.column(3).to_numpy(zero_copy_only=False))
            picked = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), picked.column(2)], ["doc", "h", "near"])

    seen = hits.mapInArrow(verify, f"doc {doc_type}, h long, near long").groupBy("doc", "h", "near").agg(F.count("*").alias("n_hits"))
    found = seen.join(owned.select("h", "near", "item"), ["h", "near"])
    return found.groupBy("doc", "item").agg(F.sum("n_hits").alias("n_hits")).groupBy("doc").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item"), F.sum("n_hits").alias("n_hits"))


def flag_contaminated(df: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df plus contaminated, n_items, first_item (replaced if present): every row once."""
    df = df.drop("contaminated", "n_items", "first_item")
    found = contaminated(df, bench, key, text)
    joined = wrapped(df, k=F.col(key)).join(found, F.col("k").eqNullSafe(F.col("doc")), "left")
    return joined.select("row.*", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item")


def drop_contaminated(df: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that share no passage with the benchmark."""
    return wrapped(df, k=F.col(key)).join(contaminated(df, bench, key, text), F.col("k").eqNullSafe(F.col("doc")), "left_anti").select("row.*")


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("doc")), "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item")
