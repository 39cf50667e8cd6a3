"""Target-distribution importance resampling over hashed runs of words, with overlap chunking of long texts.

Features are all runs of 1 to n words, hashed into buckets. Bucket counts of all documents and of the target's texts give
each bucket an integer gain; a document's weight is the mean gain of its features, and documents are drawn without
replacement by adding a hash-seeded Gumbel number to the weight and taking the highest.

A text beyond CHUNK bytes is split at word boundaries. A chunk owns the features that start in it and carries the n - 1 words
behind it, so that runs across the cut are whole; it goes to a task of its own, and counts and gains are summed by document
afterwards. So one long text is no long task, and no chunk needs another.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.llm.common import documents, staged, text_or_empty, wrapped
from proofloom.llm.textnum import slices

WORDS = 1  # longest run of words that is a feature
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
CHUNK = 1 << 16  # bytes of text
SLICE = 1 << 19
VECTOR = 64  # bytes of a feature up to which checksums are made for all features together

_OTHER = np.zeros(256, dtype=bool)
_OTHER[0x00:0x30] = _OTHER[0x3A:0x61] = _OTHER[0x7B:0x80] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] for all pairs at once, byte by byte; long ones one by one."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, VECTOR + 1), kind="stable")
    s, n = starts[order], size[order]
    out = np.full(len(s), 0xFFFFFFFF, dtype=np.uint32)
    far = int((n > VECTOR).sum())
    left = np.searchsorted(-n[far:], -np.arange(1, VECTOR + 1), side="right")  # how many have so many bytes
    for k, m in enumerate(left.tolist()):
        if not m:
            break
        part = out[far : far + m]
        part[:] = _CRC[(part ^ data[s[far : far + m] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in range(far):
        out[i] = zlib.crc32(data[s[i] : s[i] + n[i]].tobytes())
    result = np.empty_like(out)
    result[order] = out
    return result


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes that end with no word."""
    word = ~_OTHER[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.r_[0, edge]
    return edge[0::2], edge[1::2]


def cut_text(text: bytes, size: int, carry: int) -> list[tuple[int, int, int]]:
    """(first byte, end, words owned) of the chunks of a text: each begins at a word and owns the words that start before the
    next one's first; `carry` words follow. Their owned words together are the words of the text, each once."""
    starts, ends = word_edges(np.frombuffer(text.lower() + b" ", dtype=np.uint8))
    if not len(starts):
        return []
    first = np.unique(np.searchsorted(starts, np.arange(0, starts[-1] + 1, size)))  # the word at or behind each mark
    stop = np.append(first[1:], len(starts))
    return list(zip(starts[first].tolist(), ends[np.minimum(stop + carry, len(starts)) - 1].tolist(), (stop - first).tolist(), strict=True))


def bucket_runs(texts: list[bytes], owned: list[int], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of chunks, and each chunk's owned words; owned < 0: all words."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer((b"\n".join(texts) + b"\n").lower(), dtype=np.uint8)
    starts, ends = word_edges(data)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    held = np.bincount(owner, minlength=len(texts))
    limit = np.array(owned, dtype=np.int64)
    limit = np.where(limit < 0, held, limit)
    # words parted by one space, one behind each
    length = ends - starts
    at = np.cumsum(length + 1) - length - 1
    plain = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
    plain[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[~_OTHER[data]]
    place = np.arange(len(starts)) - (np.cumsum(held) - held)[owner]
    whose, found = [], []
    for k in range(n):
        fits = np.flatnonzero((place < limit[owner]) & (place + k < held[owner]))
        whose.append(owner[fits])
        found.append(checksums(plain, at[fits], at[fits + k] + length[fits + k]) % np.uint32(buckets))
    return np.concatenate(whose), np.concatenate(found).astype(np.int64), limit


def measured(piece: Column, owned: Column, gains: np.ndarray, n: int) -> Column:
    """Struct of n_features, n_words and gain (summed) of chunks."""

    @F.pandas_udf("n_features long, n_words long, gain long")
    def measure(pieces: pd.Series, owns: pd.Series) -> pd.DataFrame:
        texts, own = [x.encode() for x in pieces], owns.tolist()
        done = [np.zeros((3, 0), dtype=np.int64)]
        for lo, hi in slices(texts, SLICE):
            whose, found, words = bucket_runs(texts[lo:hi], own[lo:hi], n, len(gains))
            order = np.argsort(whose, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gains[found[order]])])
            ends = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=hi - lo))])
            done.append(np.stack([np.diff(ends), words, np.diff(sums[ends])]))
        return pd.DataFrame(np.concatenate(done, axis=1).T, columns=["n_features", "n_words", "gain"])

    return measure(piece, owned)


def chunks(long_ones: DataFrame, keys: list[str], n: int = WORDS, size: int = CHUNK) -> DataFrame:
    """keys, part, piece, owned: the chunks of rows (keys, text), dealt out to all tasks."""

    def cut(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(len(keys))):
                data = text.as_py().encode()
                found = cut_text(data, size, n - 1)
                for lo in range(0, len(found), 64):
                    some = found[lo : lo + 64]
                    own = [batch.column(c).take(pa.array([i] * len(some), pa.int32())) for c in range(len(keys))]
                    made = [pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([data[a:b].decode() for a, b, _ in some], pa.string()), pa.array([w for _, _, w in some], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*own, *made], [*keys, "part", "piece", "owned"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long_ones.select(*keys).schema)
    return long_ones.select(*keys, "text").mapInArrow(cut, f"{kinds}, part int, piece string, owned int").repartition(*keys, "part")


def bucket_counts(df: DataFrame, text: str = "text", n: int = WORDS, buckets: int = BUCKETS, size: int = CHUNK) -> np.ndarray:
    """How many features of all rows fall in each bucket; a task sends one row for each of its buckets at most."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts, owned = [x.as_py().encode() for x in batch.column(0)], batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                total += np.bincount(bucket_runs(texts[lo:hi], owned[lo:hi], n, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    rows = df.select(text_or_empty(text).alias("text"))
    short = rows.filter(F.octet_length("text") <= size).select(F.col("text").alias("piece"), F.lit(-1).alias("owned"))
    parts = chunks(rows.filter(F.octet_length("text") > size).withColumn("t", F.xxhash64("text")), ["t"], n, size)
    totals = [x.mapInArrow(count, "bucket int, n long") for x in (short, parts.select("piece", "owned"))]
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, total in totals[0].unionByName(totals[1]).groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = total
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer gain of each bucket: thousandths of the log ratio of its smoothed shares in target and source."""
    s_all, t_all, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(df: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", n: int = WORDS, size: int = CHUNK) -> DataFrame:
    """key, t (xxhash64 of the text), n_features, n_words, weight of each row. Texts that are cut are measured by chunks, which
    are summed by document and joined with their rows."""
    rows = df.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("t", F.xxhash64("text"))
    long_one = F.octet_length("text") > size
    short = rows.filter(~long_one).select("key", "t", measured(F.col("text"), F.lit(-1), gains, n).alias("m")).select("key", "t", "m.*")
    named = rows.filter(long_one).withColumn("u", F.xxhash64(F.lit("\x02"), "text"))
    keys = ["key", "t", "u"]
    parts = chunks(named, keys, n, size).withColumn("m", measured(F.col("piece"), F.col("owned"), gains, n)).select(*keys, "part", "m.*")
    # equal rows each bring their chunks: one of each counts
    sums = parts.dropDuplicates([*keys, "part"]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_features", "n_words", "gain")])
    on = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.u") == F.col("b.u"))
    none = lambda c: F.coalesce(f"b.{c}", F.lit(0).cast("long")).alias(c)  # noqa: E731  a text without words has no chunk
    cut = named.select(*keys).alias("a").join(sums.alias("b"), on, "left").select("a.key", "a.t", none("n_features"), none("n_words"), none("gain"))
    down = F.expr("(gain - pmod(gain, n_features)) div n_features")
    return short.unionByName(cut).select(F.col("key").alias(key), "t", "n_features", "n_words", F.when(F.col("n_features") > 0, down).otherwise(F.lit(0)).cast("long").alias("weight"))


def ranked(scored: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """scored, a staged table, with rank 1, 2, 3 ... in the given order, null beyond limit. Ranges are sorted apart and start
    at the sum of those before: no task sees all rows."""
    ranges = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(scored.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range_").count().select("range_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start_"))  # a row each
    place = F.col("start_") + F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    out = dealt.join(F.broadcast(starts), "range_").withColumn("rank", place.cast("long")).drop("range_", "start_")
    return out.withColumn("rank", F.when(F.col("rank") <= limit, F.col("rank")))


def draws(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """key, t, n_features, n_words, weight, score, rank of each row of df; rank is null for rows that are not drawn.

    Null text has no words, weight 0 and is not drawn; a null key seeds like an empty one and comes last among ties. Rows of
    one key share the random number and are drawn apart; equal rows are ties. Texts may have any length below 2 GiB. With an
    empty target or table all gains come of the smoothing; an empty table gives an empty one. Other columns are not read.
    """
    gains = gains_of(bucket_counts(df, text, n, buckets, size), bucket_counts(target, target_text, n, buckets, size))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = staged(weighed(df, gains, key, text, n, size).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("t").asc()]
    chosen = ranked(scored.filter(fit), order, scored.filter(fit).count() * percent // 100)
    return chosen.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def resampled(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that are drawn, as they are. Of rows with one key and text all stay if one is drawn."""
    won = draws(df, target, key, text, **options).filter("rank IS NOT NULL").select(F.col(key).alias("k"), "t").distinct()
    rows = wrapped(df, k=F.col(key), t=F.xxhash64(text_or_empty(text)))
    return rows.alias("a").join(won.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.t") == F.col("b.t")), "left_semi").select("row.*")


def op12_overlap_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = draws(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = "list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)"
OP12_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark),
u AS (SELECT rid, unnest(w) AS word FROM d),
v AS (SELECT DISTINCT word FROM (SELECT word FROM u UNION ALL SELECT word FROM b)),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, c: xor(a >> 8, crc.t[(xor(a, c) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS n FROM u JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT rid, sum(gain)::BIGINT AS total FROM u JOIN k USING (word) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, CASE WHEN len(d.w) = 0 THEN 0 ELSE (m.total - ((m.total % len(d.w)) + len(d.w)) % len(d.w)) // len(d.w) END::BIGINT AS weight,
      ('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m ON d.rid = m.rid),
y AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score, n_features >= {LEAST_WORDS} AS fit FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= (SELECT count(*) FROM y WHERE fit) * {PERCENT} // 100 THEN r END::BIGINT AS rank FROM z"""
