"""Duplicate paragraphs and passages, TF-IDF search, fingerprint tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.functions.hashing import combined_similarity, hamming, hash32, jaccard, minhash, minhash_fast, minhash_similarity, simhash, simhash_similarity
from proofloom.functions.offsets import ngrams, strip
from proofloom.operators.alike import alike_classes, fingerprint_of, grams_of, scores_of
from proofloom.operators.parse import TEXT, char_ngrams, paragraph_array, tokens
from proofloom.rules import LATIN, Pack
from proofloom.schema import entries, issue
from proofloom.sources.tables import written

MIN_CHARS = 40
BANDS, ROWS = 32, 4


def shingle_hashes(toks, k: int = 3):
    """Distinct 32-bit hashes of the k-token shingles."""
    return F.array_distinct(F.transform(ngrams(toks, k, " "), hash32))


def fingerprints(pieces: DataFrame, key: str, n: int = BANDS * ROWS, family: str = "lcg") -> DataFrame:
    """key, text, tokens, simhash, minhash, grams of each text (P11). Write it as a table: every mode below reads it.

    family lcg gives the signatures of the linear congruential coefficients, xxhash64 those of seeded hashes.
    """
    rows = pieces.select(key, "text", tokens(F.col("text")).alias("tokens"))
    exploded = rows.select(key, F.explode("tokens").alias("token"))
    sims = simhash(exploded, key, "token")
    signed = rows.withColumn("minhash", minhash(shingle_hashes(F.col("tokens")), n) if family == "lcg" else minhash_fast(shingle_hashes(F.col("tokens")), n)).withColumn("grams", F.array_distinct(char_ngrams(F.col("text"), 3)))
    return signed.join(sims, key, "left").withColumn("simhash", F.coalesce("simhash", F.lit(0).cast("bigint")))


BROADCAST_ROWS = 1 << 20


def small(rows: DataFrame) -> DataFrame:
    """rows, marked to be broadcast if a count shows that they are at most BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def nearest(prints: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """key, other, bits: the nearest other row of (key, simhash), the first on a tie; all are compared, in blocks of `block`
    rows that are broadcast one after the other (P03)."""
    n = max(1, -(-prints.count() // block))
    mine, others = prints.select(F.col(key).alias("key"), F.col("simhash").alias("own")), prints.select(F.col(key).alias("other"), "simhash", F.pmod(F.xxhash64(key), F.lit(n)).alias("block"))
    best = [mine.join(F.broadcast(others.filter(F.col("block") == i)), F.col("key") != F.col("other")).groupBy("key").agg(F.min(F.struct(hamming(F.col("own"), F.col("simhash")).alias("bits"), "other")).alias("m")) for i in range(n)]
    return reduce(DataFrame.unionByName, best).groupBy("key").agg(F.min("m").alias("m")).select(F.col("key").alias(key), "m.other", "m.bits")


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs of fingerprints (a_*, b_*) with sim, mins, grams and combined."""
    out = pairs.withColumn("sim", simhash_similarity(F.col("a_simhash"), F.col("b_simhash"))).withColumn("mins", minhash_similarity(F.col("a_minhash"), F.col("b_minhash"))).withColumn("gram", jaccard(F.col("a_grams"), F.col("b_grams")))
    return out.withColumn("combined", combined_similarity(F.col("sim"), F.col("mins"), F.col("gram")))


def _sided(fp: DataFrame, side: str) -> DataFrame:
    return fp.select(*[F.col(c).alias(f"{side}_{c}") for c in fp.columns])


def body_paragraphs(paras: Column) -> Column:
    """Paragraphs with their index as i, without headings, references and those under MIN_CHARS characters."""
    return F.filter(F.transform(paras, lambda p, i: p.withField("i", i)), lambda p: ~p["is_heading"] & ~p["in_ref"] & (F.length(strip(p["text"])) >= MIN_CHARS))


def in_python(rows: DataFrame, out: str, function, value: Column) -> DataFrame:
    """rows with `out`, a Python function of a value. It is marked as not deterministic, which it is: else the optimizer would
    move it into expressions over arrays, where it cannot run."""
    return rows.withColumn(f"{out}given", value).withColumn(out, function.asNondeterministic()(F.col(f"{out}given"))).drop(f"{out}given")


def with_repeats(rows: DataFrame, out: str = "repeats", sim: float = 0.85, least: float = 0.9) -> DataFrame:
    """rows (paras) with an array of (class, first, second, start, end, score): paragraphs of one document that repeat an
    earlier one, the first such, and the first paragraph of all that such links join (A13). One entry a paragraph."""

    links = pa.list_(pa.struct([("c", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<c:int,i:int,j:int,score:double>>")
    def classes(rows: pa.Array) -> pa.Array:  # one document's paragraphs at a time are held as strings
        return pa.array([[{"c": c, "i": i, "j": j, "score": s} for c, i, j, s in alike_classes(texts.as_py(), sim, least)] for texts in rows], links)

    rows = rows.withColumn("own_", body_paragraphs(F.col("paras")))
    several = F.when(F.size("own_") > 1, F.transform("own_", lambda p: p["text"])).otherwise(F.array().cast("array<string>"))
    place = lambda n: F.get("own_", n)
    told = F.transform("pairs_", lambda x: F.struct(place(x["c"])["i"].alias("class"), place(x["i"])["i"].alias("first"), place(x["j"])["i"].alias("second"), place(x["j"])["start"].alias("start"), (place(x["j"])["start"] + F.length(place(x["j"])["text"])).alias("end"), x["score"].alias("score")))
    return in_python(rows, "pairs_", classes, several).withColumn(out, told).drop("own_", "pairs_")


def intra_duplicates(docs: DataFrame, pack: Pack = LATIN, sim: float = 0.85, least: float = 0.9) -> DataFrame:
    """doc_id, class, first, second, start, end, score of repeated paragraphs within documents."""
    return entries(with_repeats(docs.select("doc_id", paragraph_array(TEXT(), pack).alias("paras")), "repeats", sim, least), F.col("repeats"))


def _banded(a: DataFrame, b: DataFrame, also: list) -> DataFrame:
    def bands(side: str):
        slots = F.col(f"{side}_minhash")
        mins = [F.xxhash64(F.lit(i), F.slice(slots, i * ROWS + 1, ROWS)) for i in range(BANDS)]
        sims = [F.xxhash64(F.lit(100 + i), F.shiftright(f"{side}_simhash", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
        return F.array_distinct(F.array(*mins, *sims))

    x, y = a.withColumn("band", F.explode(bands("a"))), b.withColumn("band", F.explode(bands("b")))
    on = F.col("x.band") == F.col("y.band")
    for c in also:
        on = on & c
    keys = [c for c in a.columns + b.columns]
    joined = x.alias("x").join(y.alias("y"), on)
    first = [c for c in keys if c.endswith(("_id", "_idx", "_pid"))]
    return joined.drop("band").dropDuplicates(first)


def cross_duplicates(fp: DataFrame, corpus: DataFrame, key: str, corpus_key: str, mode: str = "exact", block: int = 2048) -> DataFrame:
    """Best match in the corpus of each text, if near enough; the first on a tie; MAJOR from 0.85.

    mode exact compares all texts with the whole corpus, in blocks of `block` corpus rows that are sent to the texts one after
    the other; mode lsh joins on bands and may lose pairs below 0.85 (at 0.45 of equal MinHash slots one in four).
    """
    a, b = _sided(fp, "a"), _sided(corpus, "b")
    keep = ("sim >= 0.5 AND NOT (mins < 0.45 AND gram < 0.45) AND combined >= 0.72",)
    if mode == "exact":
        n = max(1, -(-corpus.count() // block))
        dealt = b.withColumn("block", F.pmod(F.xxhash64(f"b_{corpus_key}"), F.lit(n)))
        apart = hamming(F.col("a_simhash"), F.col("b_simhash")) <= 32
        near = reduce(DataFrame.unionByName, [compare(a.join(F.broadcast(dealt.filter(F.col("block") == i).drop("block")), apart)).filter(*keep) for i in range(n)])
    else:
        near = compare(_banded(a, b, [])).filter(*keep)
    best = near.groupBy(f"a_{key}").agg(F.max(F.struct("combined", (-F.col(f"b_{corpus_key}") if dict(corpus.dtypes)[corpus_key] in ("int", "bigint") else F.lit(0)).alias("o"), "sim", "mins", "gram", f"b_{corpus_key}")).alias("x"))
    return best.select(F.col(f"a_{key}").alias(key), F.col(f"x.b_{corpus_key}").alias(corpus_key), "x.sim", "x.mins", "x.gram", "x.combined", F.when(F.col("x.combined") >= 0.85, "MAJOR").otherwise("MINOR").alias("severity"))


def with_published(rows: DataFrame, corpus: list[tuple[str, str]], out: str = "published", least: float = 0.72) -> DataFrame:
    """rows (paras) with an array of (start, end, source, score): paragraphs of one document with the corpus text (source,
    text) that they are most like, if near enough, the first on a tie (A14). The corpus comes with the plan; for one that is
    a table use `cross_duplicates`."""
    made = [(name, fingerprint_of(text)) for name, text in corpus]
    sizes = np.array([len(f.grams) for _, f in made])
    places: dict[str, list[int]] = {}
    for i, (_, f) in enumerate(made):
        for g in f.grams:
            places.setdefault(g, []).append(i)
    held = {g: np.array(x, dtype=np.int32) for g, x in places.items()}
    need = (least - 0.6) / 0.4  # of common 3-grams, without which the mean stays below

    @F.pandas_udf("array<struct<i:int,source:string,score:double>>")
    def best(rows: pd.Series) -> pd.Series:
        out = []
        for texts in rows:
            found = []
            for i, text in enumerate(texts):
                grams = grams_of(text)
                met = [held[g] for g in grams if g in held]
                if not met:
                    continue
                shared = np.bincount(np.concatenate(met), minlength=len(made))
                close = np.flatnonzero((shared > 0) & (shared >= need * (sizes + len(grams) - shared) - 1e-9)).tolist()
                f, top = fingerprint_of(text) if close else None, None
                for c in close:
                    s = scores_of(f, made[c][1])
                    if s[0] >= 0.5 and not (s[1] < 0.45 and s[2] < 0.45) and s[3] >= least and (top is None or s[3] > top[1]):
                        top = (c, s[3])
                if top:
                    found.append({"i": i, "source": made[top[0]][0], "score": top[1]})
            out.append(found)
        return pd.Series(out)

    own = F.transform(body_paragraphs(F.col("paras")), lambda p: strip(p["text"]))
    return located(in_python(rows, "best_", best, own), "best_", out)


def located(rows: DataFrame, found: str, out: str) -> DataFrame:
    """rows (paras, an array `found` of i, source, score with i among the body paragraphs) with out: start, end, source, score."""
    rows = rows.withColumn("own_", body_paragraphs(F.col("paras")))
    place = lambda x: F.get("own_", x["i"])
    told = F.transform(found, lambda x: F.struct(place(x)["start"].alias("start"), (place(x)["start"] + F.length(place(x)["text"])).alias("end"), x["source"].alias("source"), x["score"].alias("score")))
    return rows.withColumn(out, told).drop("own_", found)


def with_duplicates(rows: DataFrame, corpus: list[tuple[str, str]] = (), found: str = "") -> DataFrame:
    """rows (paras) with duplicates: issues of one document's paragraphs that repeat an earlier one or a text of the corpus,
    which comes with the plan, or by the array `found` that `corpus.published` made of a table (A13, A14)."""
    rows = with_repeats(rows, "repeats_")
    inner = F.transform("repeats_", lambda x: issue("dup-internal", x["start"], x["end"], "duplicate", "MAJOR", F.format_string("paragraph %d is repeated", x["first"] + 1), confidence=F.round(x["score"], 3)))
    if not corpus and not found:
        return rows.withColumn("duplicates", inner).drop("repeats_")
    rows = with_published(rows, list(corpus), "published_") if corpus else located(rows, found, "published_")
    outer = F.transform("published_", lambda x: issue("dup-cross", x["start"], x["end"], "duplicate", F.when(x["score"] >= 0.85, "MAJOR").otherwise("MINOR"), F.concat(F.lit("published before: "), x["source"]), source=x["source"], confidence=F.round(x["score"], 3)))
    return rows.withColumn("duplicates", F.concat(inner, outer)).drop("repeats_", "published_")


def shingle_overlap(left: DataFrame, right: DataFrame, lkey: str, rkey: str, k: int = 3, least: float = 0.45) -> DataFrame:
    """lkey, rkey, shared, overlap: pairs that share `least` of the right text's distinct k-token shingles (second tier of A14).

    An inverted-index join on shingles; counts are exact. While the right side's shingles are few they are sent to the left
    texts, so that of these only hits are shuffled.
    """
    l = left.select(lkey, F.explode(shingle_hashes(tokens(F.col("text")), k)).alias("h"))  # noqa: E741
    r = right.select(rkey, shingle_hashes(tokens(F.col("text")), k).alias("hs")).withColumn("n", F.size("hs"))
    r = small(r.select(rkey, "n", F.explode("hs").alias("h")))
    pairs = l.join(r, "h").groupBy(lkey, rkey, "n").agg(F.count("*").alias("shared"))
    return pairs.withColumn("overlap", F.col("shared") / F.col("n")).filter(F.col("overlap") >= least).drop("n")


HEAD = 1 << 18  # terms, the most common ones, whose frequencies are sent to the documents
TASK = 8 << 20  # bytes of text for each task
SHARDS = 64  # at least, over which the documents are dealt by their keys


def text_sums(docs: DataFrame) -> tuple[int, int]:
    """(rows, tasks that the bytes of their texts ask for)."""
    r = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    return r["n"], max(docs.sparkSession.sparkContext.defaultParallelism, -(-r["size"] // TASK))


def counted(docs: DataFrame, key: str, tasks: int) -> DataFrame:
    """shard, doc, tfs (count by token) of each document of docs (key, text) with a token. Texts are dealt out by shards of
    their keys, so no (document, token) pair is shuffled."""
    doc = F.col(key)
    shard = F.pmod(F.xxhash64(doc), F.lit(max(SHARDS, tasks))).cast("int")
    texts = docs.select(shard.alias("shard"), doc.alias("doc"), TEXT().alias("text")).repartition(tasks, "shard")
    rows = texts.select("shard", "doc", tokens(F.col("text")).alias("t")).select("shard", "doc", F.explode_outer("t").alias("token")).filter("token IS NOT NULL")
    pairs = rows.groupBy("shard", "doc", "token").agg(F.count("*").alias("tf"))
    return pairs.groupBy("shard", "doc").agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("tf").cast("int")))).alias("tfs"))


def term_table(counts: DataFrame, n: int) -> DataFrame:
    """token, df, idf of counted documents, of which there are n with those that hold no token."""
    df = counts.select(F.explode(F.map_keys("tfs")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.select("token", "df", (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1).alias("idf"))


def common_from(terms: DataFrame) -> int:
    """The least power of two such that at most HEAD terms are found in as many documents or more."""
    held, cut = 0, 1 << 62
    for r in sorted(terms.groupBy(F.length(F.bin("df")).alias("bits")).count().collect(), reverse=True):
        held += r["count"]
        if held > HEAD:
            break
        cut = 1 << (r["bits"] - 1)
    return cut


def norms(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """shard, doc, norm of counted documents: the length of the vector of (1 + ln tf) idf. Frequencies of common terms are sent to
    the documents; only pairs of a document and a rare term are shuffled, and sums of documents."""
    cut = common_from(terms)
    common, rare = F.broadcast(terms.filter(F.col("df") >= cut).select("token", "idf")), terms.filter(F.col("df") < cut).select("token", "idf")
    pairs = counts.select("shard", "doc", F.explode("tfs").alias("token", "tf"))
    squares = lambda rows: rows.withColumn("w", (1 + F.log("tf")) * F.col("idf")).groupBy("shard", "doc").agg(F.sum(F.col("w") * F.col("w")).alias("sq"))
    parts = squares(pairs.join(common, "token")).unionByName(squares(pairs.join(common, "token", "left_anti").join(rare, "token")))
    return parts.groupBy("shard", "doc").agg(F.sqrt(F.sum("sq")).alias("norm"))


def normed(counts: DataFrame, lengths: DataFrame, tasks: int) -> DataFrame:
    """shard, doc, norm, token, tf of counted documents, dealt out by shard. Norms come to their documents as rows beside theirs,
    in the one exchange that deals both out; a document's tokens, which hold no blank, go through it as one string."""
    none = F.lit(None)
    mine = counts.select("shard", "doc", F.array_join(F.map_keys("tfs"), " ").alias("words"), F.map_values("tfs").alias("tf"), none.cast("double").alias("norm"))
    both = mine.unionByName(lengths.select("shard", "doc", none.cast("string").alias("words"), none.cast("array<int>").alias("tf"), "norm"))
    whole = both.repartition(tasks, "shard").groupBy("shard", "doc").agg(F.first("words", ignorenulls=True).alias("words"), F.first("tf", ignorenulls=True).alias("tf"), F.max("norm").alias("norm"))
    pairs = F.arrays_zip(F.split("words", " ").alias("token"), F.col("tf"))
    return whole.select("shard", "doc", "norm", pairs.alias("pairs")).select("shard", "doc", "norm", F.explode_outer("pairs").alias("x")).select("shard", "doc", "norm", "x.token", "x.tf")


def tfidf_topk(queries: DataFrame, docs: DataFrame, qkey: str, dkey: str, k: int = 3) -> DataFrame:
    """qkey, dkey, score, rank: cosine of (1 + ln tf) (ln((1 + N) / (1 + df)) + 1) weights, the k best a query (P10).

    Query weights use the corpus's document frequencies; terms of a query that the corpus lacks count in its norm only.
    Documents are tokenised once; their products with all queries are added up where their shard lies, and each task hands on the k
    best of a query.
    """
    n, tasks = text_sums(docs)
    counts = written(counted(docs, dkey, tasks), "counts", compression="zstd")
    terms = written(term_table(counts, n), "terms")
    q_tf = queries.select(qkey, F.explode(tokens(F.col("text"))).alias("token")).groupBy(qkey, "token").agg(F.count("*").alias("tf"))
    qw = q_tf.join(terms, "token", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.log(1 + F.lit(float(n))) + 1))
    qn = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(qkey)))
    asked = small(written(qw.withColumn("qn", qn).filter(F.col("df").isNotNull() & F.col(qkey).isNotNull()).select(F.col(qkey).alias("q"), "token", "idf", F.col("w").alias("qw"), "qn"), "asked"))
    met = normed(counts, written(norms(counts, terms), "norms"), tasks).filter("doc IS NOT NULL").join(asked, "token")
    dots = met.groupBy("shard", "doc", "q").agg(F.sum((1 + F.log("tf")) * F.col("idf") * F.col("qw")).alias("dot"), F.first("norm").alias("dn"), F.first("qn").alias("qn"))
    scored = dots.select(F.col("q").alias(qkey), F.col("doc").alias(dkey), F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 9).alias("score"))
    w = Window.partitionBy(qkey).orderBy(F.desc("score"), dkey)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(qkey, dkey, "score", "rank")
