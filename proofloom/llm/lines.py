"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without blanks at both ends, A-Z lower-cased; it is stored as two 64-bit hashes (128 bits).
`LineIndex` holds, as tables in the shared folder,
  counts   (shard, h1, h2, n_docs): in how many documents each key stands, exactly;
  filters  (shard, filter): a cuckoo filter of the keys that stand in at least `min_docs` documents.
Inserting or deleting documents adds to or takes from the counts; keys that cross the threshold enter or leave their
shard's filter, so a deletion undoes an insertion; a filter that is full is made anew, larger, of the exact counts. Dropping lines streams (document, key) rows through the filter of
their shard; what it lets pass is checked against the exact counts, so a false positive of a filter drops nothing.
A key in a third of all documents is spread over `SALTS` copies of its shard's filter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.common import documents, input_bytes, staged, text_or_empty, wrapped

MIN_DOCS = 10
SALTS = 16
SHARD_BYTES = 32 << 20  # text bytes for one shard
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets, each found from the other and the fingerprint."""

    WIDTH, KICKS, LOAD = 4, 500, 0.85

    def __init__(self, capacity: int):
        self._empty(max(1, capacity))

    def _empty(self, capacity: int) -> None:
        n = 1
        while n * self.WIDTH * self.LOAD < capacity:
            n *= 2
        self.table = np.zeros((n, self.WIDTH), dtype=np.uint16)
        self.size = 0

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each key."""
        h = self._mix(keys.astype(np.uint64))
        mask = np.uint64(len(self.table) - 1)
        prints = (h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        first = h & mask
        return prints.astype(np.uint16), first, first ^ (self._mix(prints) & mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, key: int) -> bool:
        """False if the filter is too full; the caller then builds a larger one from the exact counts."""
        prints, a, b = (x[0] for x in self.places(np.array([key]).astype(np.uint64)))
        mask = np.uint64(len(self.table) - 1)
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = prints
                self.size += 1
                return True
        bucket, undo = a, []
        for kick in range(self.KICKS):
            slot = (int(prints) + kick) % self.WIDTH
            undo.append((bucket, slot, self.table[bucket, slot]))
            self.table[bucket, slot], prints = prints, self.table[bucket, slot]
            bucket = bucket ^ (self._mix(np.array([prints], dtype=np.uint64))[0] & mask)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = prints
                self.size += 1
                return True
        for bucket, slot, old in reversed(undo):
            self.table[bucket, slot] = old
        return False

    def delete(self, key: int) -> bool:
        prints, a, b = (x[0] for x in self.places(np.array([key]).astype(np.uint64)))
        for bucket in (a, b):
            held = np.flatnonzero(self.table[bucket] == prints)
            if len(held):
                self.table[bucket, held[0]] = 0
                self.size -= 1
                return True
        return False

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = max(8, len(keys))
        while True:
            out = cls(capacity)
            if all(out.insert(k) for k in keys):
                return out
            capacity = max(capacity + 1, out.table.size * 2)

    def to_bytes(self) -> bytes:
        return self.size.to_bytes(8, "little") + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.size = int.from_bytes(data[:8], "little")
        out.table = np.frombuffer(data, dtype=np.uint16, offset=8).reshape(-1, cls.WIDTH).copy()
        return out


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(line):
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("\x01"), key).alias("h2"), (F.length(key) > 0).alias("counted"))


def _lines(text: str):
    return F.split(text_or_empty(text), "\n", -1)


class LineIndex:
    """Reference counts and filters of the documents inserted and not deleted since. A document is its id.

    Counts are sums of changes: a document inserted twice counts twice, one deleted that was never inserted takes what others
    brought. Callers keep track of what they have inserted; a text of any length is keyed whole.
    """

    def __init__(self, spark: SparkSession, n_shards: int, min_docs: int = MIN_DOCS):
        self.spark, self.n_shards, self.min_docs = spark, n_shards, min_docs
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None

    def keys_of(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Distinct (doc, shard, h1, h2): repeated rows of a document and repeated lines count once."""
        found = F.array_distinct(F.filter(F.transform(_lines(text), _hashes), lambda h: h["counted"]))
        rows = df.select(F.col(key).alias("doc"), F.explode(found).alias("h")).select("doc", "h.h1", "h.h2").distinct()
        return rows.select("doc", F.pmod("h1", F.lit(self.n_shards)).cast("int").alias("shard"), "h1", "h2")

    def _change(self, keys: DataFrame, sign: int) -> None:
        delta = keys.groupBy("shard", "h1", "h2").agg((F.count("*") * sign).alias("delta"))
        if self.counts is None:
            merged = delta.select("shard", "h1", "h2", F.lit(0).cast("long").alias("old"), F.col("delta").alias("n_docs"))
        else:
            both = self.counts.select("shard", "h1", "h2", F.col("n_docs").alias("old"), F.lit(0).cast("long").alias("delta")).unionByName(delta.withColumn("old", F.lit(0).cast("long")))
            merged = both.groupBy("shard", "h1", "h2").agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("delta")).alias("n_docs"))
        merged = staged(merged.filter("old > 0 OR n_docs > 0"), "line-counts")
        bar = F.lit(self.min_docs)
        crossing = merged.filter((F.col("old") >= bar) != (F.col("n_docs") >= bar)).select("shard", "h1", (F.col("n_docs") >= bar).alias("enters"), F.lit(None).cast("binary").alias("filter"))
        self.counts = merged.filter("n_docs > 0").drop("old")
        old = crossing.limit(0) if self.filters is None else self.filters.select("shard", F.lit(0).cast("long").alias("h1"), F.lit(True).alias("enters"), "filter")
        hot = self.counts.filter(F.col("n_docs") >= bar).groupBy("shard").agg(F.count("*").alias("n_hot"))
        rows = old.unionByName(crossing).join(F.broadcast(hot) if self.n_shards <= 4096 else hot, "shard", "left")

        def rebuild(key, pdf):
            blobs = pdf["filter"].notna()
            up = pdf.loc[~blobs & pdf["enters"], "h1"].to_numpy(np.int64).view(np.uint64)
            down = pdf.loc[~blobs & ~pdf["enters"], "h1"].to_numpy(np.int64).view(np.uint64)
            kept = CuckooFilter.from_bytes(pdf.loc[blobs, "filter"].iloc[0]) if blobs.any() else CuckooFilter(int(pdf["n_hot"].fillna(8).max()))
            for k in down:
                kept.delete(k)
            full = not all(kept.insert(k) for k in up)
            return pd.DataFrame({"shard": [key[0]], "filter": [None if full else kept.to_bytes()]})

        def enlarge(key, pdf):
            return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.build(pdf["h1"].to_numpy(np.int64).view(np.uint64)).to_bytes()]})

        built = staged(rows.groupBy("shard").applyInPandas(rebuild, "shard int, filter binary"), "line-filters")
        full = built.filter("filter IS NULL").select("shard")
        if full.limit(1).count():  # a filter without room is made anew of the shard's exact counts
            held = self.counts.filter(F.col("n_docs") >= bar).join(full, "shard", "left_semi").select("shard", "h1")
            larger = held.groupBy("shard").applyInPandas(enlarge, "shard int, filter binary")
            built = staged(built.filter("filter IS NOT NULL").unionByName(larger), "line-filters")
        self.filters = built

    def insert(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        keys = staged(self.keys_of(df, key, text), "line-keys")
        self._change(keys, 1)
        return keys

    def delete(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """df: documents inserted before, as they were inserted."""
        self._change(staged(self.keys_of(df, key, text), "line-keys"), -1)

    def hot_keys(self, keys: DataFrame) -> DataFrame:
        """The rows (doc, h1, h2) of keys whose line stands in at least min_docs documents."""
        salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
        blank = [F.lit(None).cast("long").alias(c) for c in ("h1", "h2")]
        doc_type = keys.schema["doc"].dataType
        held = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast(doc_type).alias("doc"), *blank, "filter")
        asked = keys.select("shard", salt.alias("salt"), F.lit(1).alias("kind"), "doc", "h1", "h2", F.lit(None).cast("binary").alias("filter"))
        dealt = held.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

        def probe(batches):
            here, filters = None, []
            for batch in batches:
                shard, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                kind = batch.column(2).to_numpy(zero_copy_only=False)
                h1 = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
                cuts = np.flatnonzero(np.diff(shard) | np.diff(salt)) + 1
                passed = np.zeros(len(kind), dtype=bool)
                for lo, hi in zip([0, *cuts], [*cuts, len(kind)], strict=True):
                    if lo == hi:
                        continue
                    if here != (shard[lo], salt[lo]):
                        here, filters = (shard[lo], salt[lo]), []
                    blobs = lo + int((kind[lo:hi] == 0).sum())
                    filters += [CuckooFilter.from_bytes(batch.column(6)[i].as_py()) for i in range(lo, blobs)]
                    for f in filters:
                        passed[blobs:hi] |= f.contains(h1[blobs:hi])
                picked = batch.filter(pa.array(passed))
                yield pa.RecordBatch.from_arrays([picked.column(i) for i in (3, 4, 5)], ["doc", "h1", "h2"])

        passed = dealt.mapInArrow(probe, f"doc {doc_type.simpleString()}, h1 long, h2 long")
        exact = self.counts.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        return passed.join(exact, ["h1", "h2"])


def drop_lines(df: DataFrame, hot: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with text replaced by its kept lines (null text: ''), plus n_lines and n_dropped.

    hot: rows (doc, h1, h2) of LineIndex.hot_keys. Rows with a null id belong to the document null. Columns named
    n_lines or n_dropped are replaced.
    """
    df = df.drop("n_lines", "n_dropped")
    per_doc = hot.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("hot"))
    joined = wrapped(df, k=F.col(key), lines=_lines(text)).join(per_doc, F.col("k").eqNullSafe(F.col("doc")), "left")

    def stays(line):
        h = _hashes(line)
        return ~F.array_contains(F.col("hot"), F.struct(h["h1"].alias("h1"), h["h2"].alias("h2"))) | ~h["counted"]

    kept = F.when(F.col("hot").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    counted = joined.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    others = [F.col(f"row.`{c}`").alias(c) if c != text else F.array_join("kept", "\n").alias(c) for c in df.columns]
    return counted.select(*others, "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One-shot form: index df, then drop its frequent lines. Empty lines never count; an empty table stays empty."""
    index = LineIndex(df.sparkSession, max(16, -(-input_bytes(df, text) // SHARD_BYTES)), min_docs)
    keys = index.insert(df, key, text)
    return drop_lines(df, index.hot_keys(keys), key, text)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY k.rid, k.doc_id"""
