"""Indexes that are built once and searched many times: TF-IDF with bounds (P10), Hamming distance by parts."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.functions.hashing import hamming
from proofloom.operators.parse import tokens
from proofloom.operators.similarity import counted, normed, norms, small, term_table, text_sums
from proofloom.sources.tables import shared_folder, written

BLOCK = 512  # postings of a block
FIRST = 2  # blocks full of a term's postings, in its heaviest blocks, that set the bar a result must pass
UNREAD = 0.25  # of the bar, which the terms that are not read may add together
SLACK = 1e-9


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.explode(tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


class TfidfIndex:
    """Inverted index of (1 + ln tf) (ln((1 + N) / (1 + df)) + 1) weights over the documents' norms, as tables (P10).

    `terms` (token, df, idf), `blocks` (token, shard, block, n, top, postings: (u, doc) by falling u, BLOCK of them at most),
    where u is (1 + ln tf) over the norm, so that u idf is the weight, `vectors` (shard, doc, tfs: counts by token) and `norms`.
    Documents are dealt over shards by their keys and a shard's postings are cut where it lies, so the build shuffles texts
    and counts of documents, no pairs but those with rare terms. A block's top is known without its postings. build() writes
    the tables to a folder, open() reads them; a text that is null counts as a document without terms.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.terms, self.blocks, self.vectors, self.norms, self.sums = (spark.read.parquet(f"{path}/{t}") for t in ("terms", "blocks", "vectors", "norms", "sums"))
        self.n_docs = float(self.sums.first()["n"])

    @classmethod
    def build(cls, docs: DataFrame, key: str, path: str) -> TfidfIndex:
        """docs: key, text. Keys are distinct and not null."""
        spark = docs.sparkSession

        def kept(table: DataFrame, name: str) -> DataFrame:
            table.write.option("compression", "zstd").parquet(f"{path}/{name}")
            return spark.read.schema(table.schema).parquet(f"{path}/{name}")

        n, tasks = text_sums(docs)
        kept(spark.range(1).select(F.lit(n).cast("bigint").alias("n")), "sums")
        counts = kept(counted(docs, key, tasks), "vectors")
        terms = kept(term_table(counts, n), "terms")
        pairs = normed(counts, kept(norms(counts, terms), "norms"), tasks).withColumn("u", (1 + F.log("tf")) / F.col("norm"))
        falling = pairs.groupBy("shard", "token").agg(F.sort_array(F.collect_list(F.struct("u", "doc")), asc=False).alias("p"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / F.lit(BLOCK)).cast("int")), lambda i: F.struct(i.alias("block"), F.slice("p", i * BLOCK + 1, BLOCK).alias("postings")))
        blocks = falling.select("token", "shard", F.explode(cut).alias("x"))
        kept(blocks.select("token", "shard", "x.block", F.size("x.postings").alias("n"), F.get("x.postings", F.lit(0))["u"].alias("top"), "x.postings"), "blocks")
        return cls(spark, path)

    def _asked(self, queries: DataFrame, key: str) -> DataFrame:
        """q, token, qw (over the query's norm, times idf) of the terms that the documents hold; others count in the norm only."""
        held = term_counts(queries, key).join(self.terms, "token", "left")
        weighed = held.select(F.col(key).alias("q"), "token", "idf", ((1 + F.log("tf")) * F.coalesce("idf", F.log(1 + F.lit(self.n_docs)) + 1)).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("q")))
        return weighed.withColumn("qw", F.col("w") / norm * F.col("idf")).filter("idf IS NOT NULL").select("q", "token", "qw")

    def _bounded(self, asked: DataFrame, tops: DataFrame) -> DataFrame:
        """asked with most (the token's largest u) and rest: what the terms up to this one, by rising bound, can add together."""
        bound = F.col("qw") * F.col("most")
        rising = Window.partitionBy("q").orderBy(bound, "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return asked.join(tops.groupBy("token").agg(F.max("top").alias("most")), "token").select("q", "token", "qw", "most", F.sum(bound).over(rising).alias("rest"))

    def search(self, queries: DataFrame, key: str, name: str, k: int = 3) -> DataFrame:
        """key, name, score, rank: the k documents of the highest cosine for each query (key, text), rounded to nine places, then
        by document.

        The bar of a query is the k-th best score that its terms' heaviest blocks give, which the result cannot stay under.
        Terms are taken by rising bound while all together stay under a part of the bar: their postings, the long ones of common
        words, are never added up. The other terms' postings are, left out where a block's top and all other terms cannot
        pass the bar. The k-th best sum is a higher bar; documents that can pass it with what was not read are scored by their
        vectors.
        """
        held = written(self._asked(queries, key), "held")
        tops = written(self.blocks.select("token", "shard", "block", "n", "top").join(small(held.select("token").distinct()), "token"), "tops")
        asked = written(self._bounded(held, tops), "asked")
        terms = small(asked)
        before = F.sum("n").over(Window.partitionBy("token").orderBy(F.desc("top"), "shard", "block")) - F.col("n")
        first = tops.withColumn("before", before).filter(F.col("before") < FIRST * BLOCK).select("token", "shard", "block")
        heavy = self.blocks.join(small(first), ["token", "shard", "block"]).join(terms, "token").select("q", "qw", F.explode("postings").alias("p")).groupBy("q", "p.doc").agg(F.sum(F.col("qw") * F.col("p.u")).alias("s"))
        nth = Window.partitionBy("q").orderBy(F.desc("s"), "doc")
        bars = heavy.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= k).groupBy("q").agg(F.min("s").alias("bar"), F.max("n").alias("n")).select("q", F.when(F.col("n") == k, F.col("bar")).otherwise(F.lit(0.0)).alias("bar"))
        barred = written(asked.join(bars, "q", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)) - F.lit(SLACK)), "barred")
        unread = F.col("rest") < F.col("bar") * F.lit(UNREAD)
        total = barred.groupBy("q").agg(F.sum(F.col("qw") * F.col("most")).alias("total"), F.coalesce(F.max(F.when(unread, F.col("rest"))), F.lit(0.0)).alias("left"))
        need = barred.filter(~unread).join(total, "q").select("q", "token", "qw", "bar", "left", (F.col("total") - F.col("qw") * F.col("most")).alias("others"))
        can = F.col("qw") * F.col("top") + F.col("others") >= F.col("bar")
        met = self.blocks.join(small(need), "token").filter(can).select("q", "qw", "bar", "others", F.explode("postings").alias("p")).filter(F.col("qw") * F.col("p.u") + F.col("others") >= F.col("bar"))
        limits = small(need.groupBy("q").agg(F.first("left").alias("left"), F.first("bar").alias("bar")))
        added = met.groupBy("q", "p.doc").agg(F.sum(F.col("qw") * F.col("p.u")).alias("s"))
        sums = written(added.join(limits, "q").filter(F.col("s") + F.col("left") >= F.col("bar")), "sums")
        again = sums.withColumn("n", F.row_number().over(nth)).filter(F.col("n") == k).select("q", (F.col("s") - F.lit(SLACK)).alias("higher"))
        passed = F.col("s") + F.col("left") >= F.greatest("bar", F.coalesce("higher", F.lit(0.0)))
        pairs = written(sums.join(small(again), "q", "left").filter(passed).select("q", "doc"), "pairs")
        whole = barred.groupBy("q").agg(F.collect_list(F.struct("token", "qw")).alias("terms"))
        product = lambda t: t["qw"] * F.coalesce(1 + F.log(F.try_element_at(F.col("tfs"), t["token"])), F.lit(0.0))
        dots = self.vectors.join(small(pairs), "doc").join(small(whole), "q").select("q", "doc", F.aggregate("terms", F.lit(0.0), lambda s, t: s + product(t)).alias("dot"))
        scored = dots.join(self.norms, "doc").select("q", "doc", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter("score > 0")
        out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)
        return out.select(F.col("q").alias(key), F.col("doc").alias(name), "score", "rank")


def temporary_index(docs: DataFrame, key: str) -> TfidfIndex:
    """An index of docs in the shared folder, for one use."""
    return TfidfIndex.build(docs, key, f"{shared_folder(docs.sparkSession)}/tfidf-{uuid.uuid4().hex}")


def parts_of(simhash: Column, width: int) -> Column:
    """(part, value) of all parts of `width` bits, the last one shorter where 64 is no multiple."""
    return F.array(*[F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(simhash, i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for i in range(-(-64 // width))])


def nearest(prints: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """key, other, bits: the nearest other row of (key, simhash) by Hamming distance, the first on a tie, exactly.

    Numbers are cut in m parts of about log2 of their count bits. Two within m (k + 1) - 1 bits agree in some part up to k bits:
    in round k each number without a neighbour that near asks for its parts with k bits turned, so the radius grows only for
    those far from all others. Rows of one number are each other's nearest and ask nothing.
    """
    if width is None:
        width = max(4, min(20, prints.select("simhash").distinct().count().bit_length()))
    m = -(-64 // width)
    distinct = written(prints.groupBy("simhash").agg(F.min(key).alias("first"), F.count("*").alias("rows")), "numbers")
    index = written(distinct.select("simhash", "first", F.explode(parts_of(F.col("simhash"), width)).alias("x")).select("x.part", "x.value", F.col("simhash").alias("near"), F.col("first").alias("other")), "parts")
    left = distinct.select("simhash")
    best: DataFrame | None = None
    done = []
    for k in range(width + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(width), k)]
        probes = left.select("simhash", F.explode(parts_of(F.col("simhash"), width)).alias("x")).select("simhash", "x.part", F.explode(F.transform(F.lit(masks).cast("array<long>"), lambda v: F.col("x.value").bitwiseXOR(v))).alias("value"))
        met = probes.join(index, ["part", "value"]).filter("simhash != near")
        found = met.groupBy("simhash").agg(F.min(F.struct(hamming(F.col("simhash"), F.col("near")).alias("bits"), "other")).alias("m"))
        now = found if best is None else found.unionByName(best).groupBy("simhash").agg(F.min("m").alias("m"))
        best = written(left.join(now, "simhash", "left").select("simhash", "m"), "near")
        near = F.coalesce(F.col("m.bits") <= m * (k + 1) - 1, F.lit(False))
        done.append(best.filter(near))
        best = best.filter(~near)
        left = best.select("simhash")
        if left.isEmpty():
            break
        best = best.filter("m IS NOT NULL")
    apart = done[0]
    for d in done[1:]:
        apart = apart.unionByName(d)
    if best is not None:
        apart = apart.unionByName(best.filter("m IS NOT NULL"))
    # within a group of one number the first row's nearest is the second, the others' the first
    seconds = prints.join(distinct.filter("rows > 1").select("simhash", "first"), "simhash").filter(F.col(key) != F.col("first")).groupBy("simhash").agg(F.min(key).alias("second"))
    told = distinct.join(seconds, "simhash", "left").join(apart, "simhash", "left").select("simhash", "first", "second", "m")
    rows = prints.select(key, "simhash").join(told, "simhash")
    same = F.when(F.col(key) == F.col("first"), F.col("second")).otherwise(F.col("first"))
    out = rows.select(key, F.when(F.col("second").isNotNull(), same).otherwise(F.col("m.other")).alias("other"), F.when(F.col("second").isNotNull(), F.lit(0)).otherwise(F.col("m.bits")).alias("bits"))
    return out.filter("other IS NOT NULL")
