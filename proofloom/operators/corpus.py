"""Texts against a corpus of any size: the fingerprint store and an exact join by its keys.

A mean of `least` needs so many equal MinHash slots, whatever the other parts are; with (slot, value) as an element, texts
that near share an element among the first few of one of them in any order of all elements, as many as may differ and one more.
The store holds all elements of its texts as hashes; a text asks with its first ones, frequent ones last. What meets is counted,
and only pairs that can still reach the mean by count, SimHash and size are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.functions.hashing import hamming
from proofloom.functions.offsets import strip
from proofloom.operators.alike import GRAM, MINS, SIM, SLACK, SLOTS, fingerprint_of, grams_of, mean_of, shingle_numbers
from proofloom.operators.parse import paragraph_array
from proofloom.operators.similarity import BROADCAST_ROWS, body_paragraphs, small
from proofloom.rules import LATIN, Pack
from proofloom.sources.tables import written

LEAST = 0.72
BITS = 25  # of a hash, by which shingles of a corpus are marked
FREQUENT = 1 << 16  # elements that are asked for last
PRINT = "simhash long, slots array<int>, n_grams int"


def named(texts: DataFrame) -> DataFrame:
    """text, t, u, ...: each distinct text once, named by two hashes."""
    return texts.withColumn("t", F.xxhash64("text")).withColumn("u", F.xxhash64(F.lit("\x02"), "text"))


def printed(texts: DataFrame) -> DataFrame:
    """texts (text) with their fingerprints: simhash, slots, n_grams, in Arrow batches."""

    @F.pandas_udf(PRINT)
    def prints(column: pd.Series) -> pd.DataFrame:
        made = [fingerprint_of(x) for x in column]
        signed = np.array([f.simhash for f in made], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"simhash": signed, "slots": [f.minhash.astype(np.uint32).view(np.int32) for f in made], "n_grams": [len(f.grams) for f in made]})

    return texts.withColumn("print_", prints("text")).select(*texts.columns, "print_.*")


def elements(slots, count: int = SLOTS):
    """The (slot, value) pairs of a signature as hashes."""
    return F.transform(F.slice(slots, 1, count), lambda v, i: F.xxhash64(i, v))


class FingerprintStore:
    """Fingerprints of the texts of a corpus and their elements (P11): `prints` (t, u, source, text, simhash, slots, n_grams), the
    first source of each text, and `keys` (key, t, u, simhash, n_grams).

    `of` makes both from a table for one use. `open` keeps them as tables of the catalog, bucketed by text and by element: what
    is added later is fingerprinted alone, and a join on either does not move them.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, prints: DataFrame, keys: DataFrame, name: str = ""):
        self.spark, self.prints, self.keys, self.name = spark, prints, keys, name

    @staticmethod
    def _made(corpus: DataFrame) -> DataFrame:
        """corpus: source, text. Null texts are none; equal texts are one, of the first source."""
        rows = corpus.filter(F.col("text").isNotNull() & F.col("source").isNotNull()).groupBy("text").agg(F.min("source").alias("source"))
        return printed(named(rows)).select("t", "u", "source", "text", "simhash", "slots", "n_grams")

    @staticmethod
    def _keys(prints: DataFrame) -> DataFrame:
        return prints.select(F.explode(elements(F.col("slots"))).alias("key"), "t", "u", "simhash", "n_grams")

    @classmethod
    def of(cls, corpus: DataFrame) -> FingerprintStore:
        prints = written(cls._made(corpus), "fingerprints")
        return cls(corpus.sparkSession, prints, cls._keys(prints))

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> FingerprintStore:
        if not spark.catalog.tableExists(f"{name}_prints"):
            empty = spark.createDataFrame([], f"t long, u long, source string, text string, {PRINT}")
            cls._append(empty, f"{name}_prints", "t")
            cls._append(cls._keys(empty), f"{name}_keys", "key")
        return cls(spark, spark.table(f"{name}_prints"), spark.table(f"{name}_keys"), name)

    @classmethod
    def _append(cls, rows: DataFrame, table: str, by: str) -> None:
        rows.repartition(cls.BUCKETS, by).write.bucketBy(cls.BUCKETS, by).sortBy(by).format("parquet").mode("append").saveAsTable(table)

    def add(self, corpus: DataFrame) -> int:
        """Fingerprint and keep the texts (source, text) that the store lacks; how many. A text that is held keeps its source."""
        if not self.name:
            raise ValueError("only a store that was opened by name can grow")
        fresh = named(corpus.filter(F.col("text").isNotNull() & F.col("source").isNotNull())).join(self.prints.select("t", "u"), ["t", "u"], "left_anti")
        made = written(self._made(fresh.select("source", "text")), "fingerprints")
        n = made.count()
        if n:
            self._append(made, f"{self.name}_prints", "t")
            self._append(self._keys(made), f"{self.name}_keys", "key")
            self.prints, self.keys = self.spark.table(f"{self.name}_prints"), self.spark.table(f"{self.name}_keys")
        return n

    def frequent(self) -> np.ndarray:
        """The FREQUENT most frequent elements that several texts have, the rarer first."""
        counts = self.keys.groupBy("key").count().filter("count > 1").orderBy(F.desc("count"), "key").limit(FREQUENT)
        return np.array([r[0] for r in counts.collect()][::-1], dtype=np.int64)  # FREQUENT at most


def asked(slots, frequent: np.ndarray, n: int):
    """The first n elements of a signature, the frequent ones last."""
    order = np.argsort(frequent)
    held = frequent[order]

    @F.pandas_udf("array<long>")
    def choose(rows: pd.Series) -> pd.Series:
        if not len(held) or not len(rows):
            return pd.Series([r[:n] for r in rows])
        keys = np.stack([np.asarray(r, dtype=np.int64) for r in rows])
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        rank = np.where(held[at] == keys, order[at] + 1, 0)
        return pd.Series(list(np.take_along_axis(keys, np.argsort(rank, axis=1, kind="stable")[:, :n], axis=1)))

    return choose(elements(slots))


def marks_of(texts: DataFrame) -> np.ndarray:
    """A bit for each number of BITS bits: whether a shingle of texts (text) has it. The last one: whether a text has none."""

    @F.pandas_udf("array<long>")
    def numbers(column: pd.Series) -> pd.Series:
        return pd.Series([np.unique(own & (1 << BITS) - 1) if len(own := shingle_numbers(x)) else np.array([1 << BITS]) for x in column])

    held = texts.select(F.explode(numbers("text")).alias("n"))
    words = held.groupBy(F.shiftright("n", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(n % 32))")).alias("bits"))
    out = np.zeros((1 << BITS - 5) + 1, dtype=np.uint32)
    made = words.toPandas()  # 2**20 rows at most
    out[made["at"].to_numpy(dtype=np.int64)] = made["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def meeting(texts: DataFrame, corpus: DataFrame) -> DataFrame:
    """texts (text) without those that share no shingle with a text of the corpus. Their MinHash slots are equal only where two
    hashes meet by chance in 32 bits, which the 26 slots that a hit needs never do. A text without shingles meets such ones."""
    marks = marks_of(corpus)

    @F.pandas_udf("boolean")
    def meets(column: pd.Series) -> pd.Series:
        made = [shingle_numbers(x) & (1 << BITS) - 1 for x in column]
        made = [own if len(own) else np.array([1 << BITS]) for own in made]
        return pd.Series([bool((marks[own >> 5] >> (own & 31).astype(np.uint32) & np.uint32(1)).any()) for own in made], dtype=bool)

    return texts.filter(meets("text"))


def closest(texts: DataFrame, store: FingerprintStore, least: float = LEAST) -> DataFrame:
    """t, u, source, sim, mins, gram, score of each distinct text (text) with the text of the store that it is most like: SimHash
    0.5 or more, MinHash or 3-grams 0.45 or more, the mean `least` or more; the first source on a tie (A14). All such pairs are
    compared, no text is left out for its length or frequency."""
    wanted = max(1, math.ceil(SLOTS * (least - SIM - GRAM) / MINS - SLACK))
    n = SLOTS - wanted + 1
    given = texts.filter(F.col("text").isNotNull()).select("text").distinct()
    if wanted > SLOTS // 8 and store.prints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # of more, nearly all marks would be set
        given = meeting(given, store.prints)
    own = written(printed(named(given)), "asked")
    ask = own.select("t", "u", "simhash", "n_grams", F.explode(asked(F.col("slots"), store.frequent(), n)).alias("key"))
    held = store.keys.select("key", F.col("t").alias("ct"), F.col("u").alias("cu"), F.col("simhash").alias("csim"), F.col("n_grams").alias("cn"))
    share = lambda count: mean_of(1 - hamming(F.col("simhash"), F.col("csim")) / F.lit(64.0), count, F.least("n_grams", "cn") / F.greatest("n_grams", "cn", F.lit(1))) >= least - SLACK
    met = ask.join(small(held), "key").filter((hamming(F.col("simhash"), F.col("csim")) <= 32) & share(F.lit(1.0)))
    pair = ["t", "u", "ct", "cu"]
    counted = met.groupBy(*pair).agg(F.count("*").alias("n"), F.first("simhash").alias("simhash"), F.first("csim").alias("csim"), F.first("n_grams").alias("n_grams"), F.first("cn").alias("cn"))
    near = counted.filter(share((F.col("n") + F.lit(SLOTS - n)) / F.lit(float(SLOTS)))).select(*pair)
    given = store.prints.select(F.col("t").alias("ct"), F.col("u").alias("cu"), "source", F.col("text").alias("ctext"), F.col("simhash").alias("csim"), F.col("slots").alias("cslots"))
    both = near.join(given, ["ct", "cu"]).join(own.select("t", "u", "text", "simhash", "slots"), ["t", "u"])

    @F.pandas_udf("sim double, mins double, gram double")
    def compare(a: pd.Series, b: pd.Series, sa: pd.Series, sb: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.DataFrame:
        bits = (sa.to_numpy(np.int64) ^ sb.to_numpy(np.int64)).view(np.uint64)
        sim = 1 - np.bitwise_count(bits) / 64
        mins = [float((np.asarray(x) == np.asarray(y)).mean()) for x, y in zip(ma, mb, strict=True)]
        grams = [(grams_of(x), grams_of(y)) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"sim": sim, "mins": mins, "gram": [len(x & y) / len(x | y) if x | y else 0.0 for x, y in grams]})

    scored = both.withColumn("s", compare("text", "ctext", "simhash", "csim", "slots", "cslots")).select("t", "u", "source", "s.*").withColumn("score", mean_of(F.col("sim"), F.col("mins"), F.col("gram")))
    fit = scored.filter((F.col("sim") >= 0.5) & ((F.col("mins") >= 0.45) | (F.col("gram") >= 0.45)) & (F.col("score") >= least))
    first = Window.partitionBy("t", "u").orderBy(F.desc("score"), "source")
    return fit.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def published(docs: DataFrame, store: FingerprintStore, pack: Pack = LATIN, least: float = LEAST) -> DataFrame:
    """doc_id, d (xxhash64 of the text), found: array of (i, source, score) of the body paragraphs of each document that
    stand in the corpus or nearly so; i counts body paragraphs. Documents without any are left out; rows of one id and text are one."""
    text = F.coalesce("text", F.lit(""))
    own = F.transform(body_paragraphs(paragraph_array(text, pack)), lambda p, i: F.struct(i.alias("i"), strip(p["text"]).alias("text")))
    rows = named(docs.select("doc_id", F.xxhash64(text).alias("d"), own.alias("own_")).select("doc_id", "d", F.explode("own_").alias("x")).select("doc_id", "d", "x.*"))
    hits = closest(rows, store, least).select("t", "u", "source", "score")
    told = rows.select("doc_id", "d", "i", "t", "u").join(small(written(hits, "published")), ["t", "u"])
    return told.groupBy("doc_id", "d").agg(F.array_sort(F.collect_set(F.struct("i", "source", "score"))).alias("found"))


def with_matches(rows: DataFrame, docs: DataFrame, store: FingerprintStore, out: str, pack: Pack = LATIN) -> DataFrame:
    """rows (doc_id, text and others) with `out`, the array `found` of `published`, empty where nothing was found. What was found
    is sent to the rows while it is small, so that these are not shuffled."""
    hits = published(docs, store, pack).select(F.col("doc_id").alias("k_"), F.col("d").alias("d_"), F.col("found").alias(out))
    joined = rows.withColumn("h_", F.xxhash64("text")).join(small(written(hits, "matches")), F.col("doc_id").eqNullSafe(F.col("k_")) & (F.col("h_") == F.col("d_")), "left")
    return joined.drop("h_", "k_", "d_").withColumn(out, F.coalesce(out, F.array().cast("array<struct<i:int,source:string,score:double>>")))
