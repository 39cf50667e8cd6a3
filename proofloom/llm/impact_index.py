"""Ranked lexical search over document shards of precomputed integer impacts.

A shard is a run of documents of about SHARD bytes of text as one row of a table: its terms' hashes in order, the start of
each term's postings, and for each posting the document's place in the shard and its impact, the integer that the term's
weight is multiplied by (compressed sparse rows). Impacts depend on the corpus's sums alone, so they are made once, at
building; document frequencies are sums over the shards' term columns.

A search takes the query set in blocks of bounded size. Every shard adds each item's terms one after the other to a dense
array of its documents' scores (term at a time), picks the k highest by partial sorting with all that tie with the last, and
sends k rows an item; the shards' lists are then merged. A term is known by 64 bits of its hash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.llm.common import documents, staged, text_or_empty
from proofloom.llm.textnum import Tokens, slices

SHARD = 1 << 22  # bytes of text
BLOCK = 1 << 22  # bytes of query text that are searched together
TOP = 10
SCALE = 1_000_000_000
K1, B = 8, 75  # tf saturates as 1000 tf / (1000 tf + K1 m); B hundredths of m follow the document's length

_APART = np.ones(256, dtype=bool)
_APART[0x30:0x3A] = _APART[0x41:0x5B] = _APART[0x61:0x7B] = _APART[0x80:] = False


def terms_of(texts: list[bytes]) -> Tokens:
    return Tokens(texts, blank=_APART)


@dataclass(frozen=True)
class ImpactIndex:
    """shards: the staged table; key: type of the documents' ids; n_docs: documents with a term; n_terms: all terms with repeats."""

    shards: DataFrame
    key: str
    n_docs: int
    n_terms: int


def corpus_sums(rows: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def count(batches):
        docs = total = 0
        for batch in batches:
            texts = [x.as_py().encode() for x in batch.column(0)]
            for lo, hi in slices(texts, SHARD):
                data = np.frombuffer(b"\n" + b"\n".join(texts[lo:hi]), dtype=np.uint8)
                apart = _APART[data]
                begins = np.flatnonzero(apart[:-1] & ~apart[1:]) + 1
                sizes = np.fromiter((len(t) + 1 for t in texts[lo:hi]), dtype=np.int64, count=hi - lo)
                docs += len(np.unique(np.searchsorted(np.cumsum(sizes), begins - 1, side="right")))
                total += len(begins)
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["docs", "total"])

    none = F.lit(0).cast("long")
    return tuple(rows.select("text").mapInArrow(count, "docs long, total long").agg(F.coalesce(F.sum("docs"), none), F.coalesce(F.sum("total"), none)).first())


def postings(texts: list[bytes], n_docs: int, n_terms: int) -> tuple[np.ndarray, ...]:
    """(terms in order, start of each one's postings and their end, documents, impacts) of a shard."""
    t = terms_of(texts)
    terms, place = np.unique(t.hashes, return_inverse=True)
    key, tf = np.unique(place.astype(np.int64) * len(texts) + t.doc, return_counts=True)
    docs = key % max(1, len(texts))
    m = 100 - B + (B * np.bincount(t.doc, minlength=len(texts)) * n_docs) // max(1, n_terms)
    impacts = (SCALE * tf) // (1000 * tf + K1 * m[docs])
    starts = np.searchsorted(key, np.arange(len(terms) + 1) * len(texts))
    return terms, starts, docs.astype(np.int32), impacts.astype(np.int32)


def build(df: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> ImpactIndex:
    """The index of all rows, written once into the shared folder. Null text has no terms and is never found; rows of one key
    are documents of their own; a null key is ranked last among ties; texts may have any length below 2 GiB, one beyond
    `shard` bytes is a shard of its own; an empty table makes an empty index. Other columns are not read."""
    rows = df.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    n_docs, n_terms = corpus_sums(rows)
    kind = df.schema[key].dataType.simpleString()

    def pack(batches):
        keys: list[pa.Array] = []
        texts: list[bytes] = []
        size = 0

        def row():
            terms, starts, docs, impacts = postings(texts, n_docs, n_terms)
            ids = pa.concat_arrays(keys)
            made = [pa.array([len(texts)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            return pa.RecordBatch.from_arrays([*made, *[pa.array([x.tobytes()], pa.binary()) for x in (terms, starts.astype(np.int64), docs, impacts)]], ["n", "keys", "terms", "starts", "docs", "impacts"])

        for batch in batches:
            some = [x.as_py().encode() for x in batch.column(1)]
            for lo, hi in slices(some, shard):
                keys.append(batch.column(0).slice(lo, hi - lo))
                texts += some[lo:hi]
                size += sum(map(len, some[lo:hi]))
                if size >= shard:
                    yield row()
                    keys, texts, size = [], [], 0
        if texts:
            yield row()

    # a row is megabytes: the writer is to look at its size after each one
    options = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}
    made = rows.mapInArrow(pack, f"n int, keys array<{kind}>, terms binary, starts binary, docs binary, impacts binary")
    return ImpactIndex(staged(made, "impact-index", options=options), kind, n_docs, n_terms)


def query_blocks(queries: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[object, Counter]]]:
    """(item, terms) of the query set, a bounded block after the other."""
    held, total = [], 0
    for item, words in queries.select(key, text_or_empty(text)).toLocalIterator():
        data = words.encode()
        held.append((item, Counter(terms_of([data]).hashes.tolist())))
        total += len(data) + 1
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def frequencies(index: ImpactIndex, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each of the wanted terms stands: sums over the shards' term columns."""

    def count(batches):
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for terms, starts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                terms, sizes = np.frombuffer(terms, dtype=np.uint64), np.diff(np.frombuffer(starts, dtype=np.int64))
                _, mine, theirs = np.intersect1d(wanted, terms, assume_unique=True, return_indices=True)
                total[mine] += sizes[theirs]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["i", "df"])

    out = np.zeros(len(wanted), dtype=np.int64)
    for i, df in index.shards.select("terms", "starts").mapInArrow(count, "i int, df long").groupBy("i").agg(F.sum("df")).toLocalIterator():
        out[i] = df
    return out


def highest(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0 and of all that tie with the last of them."""
    if len(scores) > k:
        least = max(1, int(scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]))
        return np.flatnonzero(scores >= least)
    return np.flatnonzero(scores > 0)


def _search_block(index: ImpactIndex, block: list[tuple[object, Counter]], k: int) -> DataFrame:
    """q (place in the block), key, score, rank."""
    wanted = np.array(sorted({t for _, terms in block for t in terms}), dtype=np.uint64)
    found = frequencies(index, wanted)
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) if n else 0 for n in found.tolist()], dtype=np.int64)
    asked = []
    for _, terms in block:
        at = np.searchsorted(wanted, np.array(sorted(terms), dtype=np.uint64))
        times = np.array([terms[t] for t in sorted(terms)], dtype=np.int64)
        asked.append((at, times * weight[at]) if len(at) else (np.zeros(0, dtype=np.int64), times))
    shared = index.shards.sparkSession.sparkContext.broadcast((wanted, asked))  # of one block: bounded by BLOCK

    def score(batches):
        wanted, asked = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                n, keys = batch.column(0)[i].as_py(), batch.column(1)[i].values
                terms, starts, docs, impacts = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=d) for c, d in ((2, np.uint64), (3, np.int64), (4, np.int32), (5, np.int32)))
                at = np.searchsorted(terms, wanted)
                held = at < len(terms)
                held[held] = terms[at[held]] == wanted[held]
                out = []
                for q, (mine, factor) in enumerate(asked):
                    scores = np.zeros(n, dtype=np.int64)
                    for w, f in zip(mine.tolist(), factor.tolist(), strict=True):
                        if held[w]:
                            lo, hi = starts[at[w]], starts[at[w] + 1]
                            scores[docs[lo:hi]] += f * impacts[lo:hi].astype(np.int64)
                    best = highest(scores, k)
                    if len(best) > k:  # of equal scores the first ids
                        order = pc.sort_indices(pa.table({"s": scores[best], "k": keys.take(pa.array(best))}), sort_keys=[("s", "descending"), ("k", "ascending")]).to_numpy()
                        best = best[order[:k]]
                    out.append((np.full(len(best), q), best, scores[best]))
                q, best, s = (np.concatenate([o[i] for o in out]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), keys.take(pa.array(best, pa.int64())), pa.array(s, pa.int64())], ["q", "key", "score"])

    lists = index.shards.mapInArrow(score, f"q int, key {index.key}, score long")
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    # the k best of each task's lists meet, item by item
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)


def search(index: ImpactIndex, queries: DataFrame, query_key: str = "item_id", query_text: str = "text", k: int = TOP, block: int = BLOCK) -> DataFrame:
    """item, rank, key, score: the k best documents with a score above 0 of each row of queries, equal scores by key.

    Rows of one item are searched each on its own. An item without terms, or none that a document has, gives no row."""
    spark = index.shards.sparkSession
    kind = queries.schema[query_key].dataType.simpleString()
    out = spark.createDataFrame([], f"item {kind}, rank int, key {index.key}, score long")
    for items in query_blocks(queries, query_key, query_text, block):
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], f"q int, item {kind}")
        out = out.unionByName(_search_block(index, items, k).join(F.broadcast(names), "q").select("item", "rank", "key", "score"))
    return out


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(documents(spark, sf_dir).select("doc_id", "text"))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * g.n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, g.n_docs),
q AS (SELECT qid, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS t FROM benchmark)),
s AS (SELECT qid, item_id, p.rid, d.doc_id, sum(w.w * (({SCALE} * p.tf) // (1000 * p.tf + {K1} * (100 - {B} + ({B} * len(d.t) * g.n_docs) // g.n_terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.rid = p.rid CROSS JOIN g GROUP BY qid, item_id, p.rid, d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {TOP}"""
