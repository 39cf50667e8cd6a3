"""Language-model scoring by context-tree weighting over bytes.

The model. The next byte (or 0xFF, the end of a text) is decomposed into eight binary decisions; each of the 255 nodes
of that decomposition has its own context tree over the previous 1 to DEPTH bytes. A tree node with counts (n0, n1) has
the Krichevsky-Trofimov estimate Pe(n0, n1); its weighted probability is Pw = Pe at full depth and
Pw = Pe / 2 + (product of its children's Pw) / 2 above. With training counts fixed, a bit's probability mixes the KT
estimates of all depths along its context: p_d = w_d * KT_d + (1 - w_d) * p_(d+1), w_d = Pe / (2 Pw).

The plan. Every count comes from the whole corpus and the model grows with it; nothing of it is broadcast but the
depths 0 and 1, which have at most 65,536 rows. Documents are scored where they were read: a chunk (a file split, or a
part of it) sends its distinct byte n-grams and words with their training counts, counts are summed by key, trees are
computed for all contexts that share their last two bytes at once, and each chunk gets back one number per distinct key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.common import documents, staged, text_or_empty
from proofloom.llm.textnum import Lookup, Tokens, distinct_counts, distinct_sums, slices

DEPTH = 5  # bytes of context; a key holds them and the next byte in 48 bits
CHUNK_BYTES = 32 << 20  # of a file split that make one chunk; half of the text bytes that make one request
SLICE = 1 << 19  # text bytes handled at once
END = 0xFF  # never a byte of UTF-8
WORD = np.uint64(1 << 63)  # set in the keys of words
END_WORD = np.uint64((1 << 64) - 1)
TREE_ROWS = 1 << 18
MERGE_ROWS = 1 << 20
HALF = math.log(0.5)


def gram_keys(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Key and text number of every byte and end: last byte before it uppermost, then the ones before, itself lowest."""
    pad = bytes(depth)
    joined = np.frombuffer(pad + bytes([END]).join([pad + t for t in texts])[depth:] + bytes([END]), dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.cumsum(sizes + depth) - sizes - depth
    real = np.ones(len(joined), dtype=bool)
    real[(first[:, None] + np.arange(depth)).ravel()] = False
    keys = joined[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        keys |= joined[depth - j : len(joined) - j].astype(np.uint64) << np.uint64(8 * (depth + 1 - j))
    return keys[real[depth:]], np.repeat(np.arange(len(texts)), sizes)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key and text number of every word, then of every text's end."""
    t = Tokens(texts)
    return np.r_[t.hashes | WORD, np.full(len(texts), END_WORD)], np.r_[t.doc, np.arange(len(texts))]


def chunk_requests(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the texts and how often each stands in those to learn from."""
    found = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]

    def merge() -> None:
        found[:] = [distinct_sums(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))]

    for learn in (True, False):
        own = [t for t, x in zip(texts, train, strict=True) if x == learn]
        for lo, hi in slices(own, SLICE):
            for keys in (gram_keys(own[lo:hi])[0], word_keys(own[lo:hi])[0]):
                keys, counts = distinct_counts(keys)
                found.append((keys, counts * learn))
            if sum(len(k) for k, _ in found[1:]) > MERGE_ROWS:
                merge()
    merge()
    return found[0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series after shifting x above 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log Pe(n0, n1) of the Krichevsky-Trofimov estimator."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _node_of(keys: np.ndarray, bit: int) -> np.ndarray:
    """Number 1 to 255 of the decomposition's node that decides `bit` of the key's byte."""
    x = (keys & np.uint64(255)).astype(np.int64)
    return (1 << (7 - bit)) | (x >> (bit + 1))


def deep_trees(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct keys that hold complete two-byte contexts: the probability of a one at each of the eight
    decisions, mixed over depths 2 to `depth`; and per (last byte, node) the sum of log Pw over depth 2."""
    levels = []
    for d in range(2, depth + 1):
        cut = np.uint64(8 * (depth - d + 1))
        k = ((keys >> cut) << np.uint64(8)) | (keys & np.uint64(255))
        u, inverse = np.unique(k, return_inverse=True)
        levels.append((d, u, inverse, np.bincount(inverse, weights=counts, minlength=len(u))))
    mixed = np.empty((len(keys), 8), dtype=np.float32)
    top = np.zeros(65536)
    for bit in range(7, -1, -1):
        below = None  # nodes and log Pw one depth deeper
        held = {}
        for d, u, inverse, n in reversed(levels):
            node = u >> np.uint64(bit + 1)
            starts = np.r_[True, node[1:] != node[:-1]]
            index = np.cumsum(starts) - 1
            nodes = node[starts]
            ones = (u >> np.uint64(bit)) & np.uint64(1)
            total = np.bincount(index, weights=n)
            n1 = np.bincount(index, weights=n * ones)
            log_pe = log_kt(total - n1, n1)
            kt = (n1 + 0.5) / (total + 1.0)
            if below is None:
                log_pw, weight = log_pe, None
            else:
                low = np.uint64(7 - bit)
                kids, kid_pw = below
                parent = ((kids >> (low + np.uint64(8))) << low) | (kids & np.uint64((1 << (7 - bit)) - 1))
                product = np.bincount(np.searchsorted(nodes, parent), weights=kid_pw, minlength=len(nodes))
                log_pw = HALF + np.logaddexp(log_pe, product)
                weight = np.exp(HALF + log_pe - log_pw)
            held[d] = (index[inverse], kt, weight)
            below = (nodes, log_pw)
        at, kt, _ = held[depth]
        p = kt[at]
        for d in range(depth - 1, 1, -1):
            at, kt, weight = held[d]
            p = weight[at] * kt[at] + (1 - weight[at]) * p
        mixed[:, bit] = p
        nodes, log_pw = below
        low = np.uint64(7 - bit)
        last = (nodes >> (low + np.uint64(8))).astype(np.int64)
        number = (1 << (7 - bit)) | (nodes & np.uint64((1 << (7 - bit)) - 1)).astype(np.int64)
        top += np.bincount(last * 256 + number, weights=log_pw, minlength=65536)
    return mixed, top


class Shallow:
    """Depths 0 and 1. counts: [last byte, byte]; deeper: [last byte, node], sums of log Pw over depth 2."""

    def __init__(self, counts: np.ndarray, deeper: np.ndarray):
        n0, n1 = np.zeros((256, 256)), np.zeros((256, 256))
        x = np.arange(256)
        for bit in range(8):
            node = (1 << (7 - bit)) | (x >> (bit + 1))
            one = (x >> bit) & 1
            np.add.at(n1.T, node, (counts * one).T)
            np.add.at(n0.T, node, (counts * (1 - one)).T)
        pe = log_kt(n0, n1)
        pw = HALF + np.logaddexp(pe, deeper)
        self.kt1, self.w1 = (n1 + 0.5) / (n0 + n1 + 1), np.exp(HALF + pe - pw)
        m0, m1 = n0.sum(axis=0), n1.sum(axis=0)
        pe0 = log_kt(m0, m1)
        pw0 = HALF + np.logaddexp(pe0, pw.sum(axis=0))
        self.kt0, self.w0 = (m1 + 0.5) / (m0 + m1 + 1), np.exp(HALF + pe0 - pw0)

    def log10_probability(self, keys: np.ndarray, mixed: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        last = (keys >> np.uint64(8 * depth)).astype(np.int64)
        out = np.zeros(len(keys))
        for bit in range(8):
            node = _node_of(keys, bit)
            p = self.w1[last, node] * self.kt1[last, node] + (1 - self.w1[last, node]) * mixed[:, bit]
            p = self.w0[node] * self.kt0[node] + (1 - self.w0[node]) * p
            one = (keys >> np.uint64(bit)) & np.uint64(1) == 1
            out += np.log10(np.where(one, p, 1 - p))
        return out


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n), sorted; contexts with equal last two bytes stand together. Tag 0: key and mixed probabilities;
    1: counts of (last byte, byte); 2: sums of log Pw of (last byte, node)."""

    def emit(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        mixed, top = deep_trees(keys, n)
        empty = np.zeros(len(keys))
        names = ["tag", "key", "p", "v"]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), dtype=np.int32)), pa.array(keys.view(np.int64)), _binary(mixed), pa.array(empty)], names)
        pair = ((keys >> np.uint64(8 * DEPTH)) * np.uint64(256) + (keys & np.uint64(255))).astype(np.int64)
        for tag, sums in ((1, np.bincount(pair, weights=n, minlength=65536)), (2, top)):
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tag, dtype=np.int32)), pa.array(at), pa.nulls(len(at), pa.binary()), pa.array(sums[at])], names)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)))
        size += batch.num_rows
        if size >= TREE_ROWS:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            group = keys >> np.uint64(8 * (DEPTH - 1))
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from emit(keys[:cut], n[:cut])
            held, size = [(keys[cut:], n[cut:])], len(keys) - cut
    if size:
        yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


def score_texts(df: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of df.

    train: boolean column, which rows to learn from. Null texts are empty: one token, the end. Repeated rows are
    learned from and scored each time. If nothing is learned every bit has probability 1/2. An empty table gives an
    empty one; other columns are not looked at.
    """
    spark = df.sparkSession
    picked = df.select(F.col(key).alias("k"), text_or_empty(text).alias("text"), train.alias("train"))
    if not picked.inputFiles() or "Exchange" in picked._jdf.queryExecution().toString():
        picked = staged(picked, "texts")  # chunks are named by file split
    parts = max(1, -(-spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() // CHUNK_BYTES))
    chunk = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("k"), F.lit(parts)))
    picked = picked.withColumn("chunk", chunk)

    def requests(batches):
        texts: dict[int, list[bytes]] = {}
        learn: dict[int, list[bool]] = {}
        sizes: dict[int, int] = {}

        def flush(c):
            keys, n = chunk_requests(texts.pop(c), np.array(learn.pop(c)))
            sizes.pop(c)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c)), pa.array(keys.view(np.int64)), pa.array(n)], ["chunk", "key", "n"])

        for batch in batches:
            for c, t, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = t.as_py().encode()
                texts.setdefault(c, []).append(data)
                learn.setdefault(c, []).append(bool(x))
                sizes[c] = sizes.get(c, 0) + len(data)
                if sizes[c] > 2 * CHUNK_BYTES:  # a chunk may ask twice; its answers are made distinct when it is scored
                    yield flush(c)
        for c in list(texts):
            yield flush(c)

    asked = staged(picked.select("chunk", "text", "train").mapInArrow(requests, "chunk long, key long, n long"), "requests")
    totals = staged(asked.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    n_words, v_words = totals.filter("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    grams = totals.filter("key >= 0").repartition(F.shiftrightunsigned("key", 8 * (DEPTH - 1))).sortWithinPartitions("key")
    trees = staged(grams.select("key", "n").mapInArrow(_tree_batches, "tag int, key long, p binary, v double"), "trees")
    tables = {1: np.zeros(65536), 2: np.zeros(65536)}
    for row in trees.filter("tag > 0").groupBy("tag", "key").agg(F.sum("v").alias("v")).collect():  # 131,072 rows at most
        tables[row["tag"]][row["key"]] = row["v"]
    shallow = Shallow(tables[1].reshape(256, 256), tables[2].reshape(256, 256))

    def probabilities(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            mixed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shallow.log10_probability(keys, mixed).astype(np.float32))], ["key", "v"])

    known = trees.filter("tag = 0").select("key", "p").mapInArrow(probabilities, "key long, v float")
    words = totals.filter("key < 0").select("key", F.log10((F.col("n") + 0.5) / F.lit(n_words + 0.5 * (v_words + 1))).cast("float").alias("v"))
    answers = asked.select("chunk", "key").join(known.unionByName(words), "key").select("chunk", "key", "v")
    unseen = float(np.float32(math.log10(0.5 / (n_words + 0.5 * (v_words + 1))))) if n_words else 0.0
    kind = picked.schema["k"].dataType.simpleString()

    def pack(batches):
        """Documents as compressed blobs of SLICE bytes of text: a third of the bytes to shuffle."""
        for batch in batches:
            for c in np.unique(batch.column(3).to_numpy(zero_copy_only=False)):
                own = batch.filter(pc.equal(batch.column(3), pa.scalar(int(c)))).select(["k", "text", "train"])
                sizes = pc.binary_length(own.column(1)).to_numpy(zero_copy_only=False)
                cut = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
                for lo, hi in zip([0, *cut], [*cut, len(sizes)], strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema) as out:
                        out.write_batch(own[lo:hi])
                    raw = sink.getvalue()
                    blob = len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([int(c)]), pa.array([blob], pa.binary())], ["chunk", "blob"])

    def score(blobs: pa.Table, given: pa.Table) -> pa.Table:
        keys = given.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, values = keys[order], given.column("v").to_numpy()[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, dtype=bool)
        keys, values = keys[first], values[first]
        is_word = keys >= WORD
        grams, words_of = Lookup(keys[~is_word], values[~is_word]), Lookup(keys[is_word], values[is_word])
        out = []
        for blob in blobs.column("blob"):
            data = blob.as_py()
            docs = pa.ipc.open_stream(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")).read_all()
            texts = [t.as_py().encode() for t in docs.column("text")]
            n = len(texts)
            k, doc = gram_keys(texts)
            log_p = np.bincount(doc, weights=grams.get(k), minlength=n)
            k, doc = word_keys(texts)
            each = words_of.get(k)
            known = np.bincount(doc, weights=each > unseen + 1e-3, minlength=n).astype(np.int64)  # one occurrence is 0.47 more
            held = np.array([not x for x in docs.column("train").to_pylist()], dtype=bool)
            arrays = [docs.column("k").combine_chunks(), pa.array(held), pa.array(np.bincount(doc, minlength=n)), pa.array(known), pa.array(np.full(n, n_words, dtype=np.int64)), pa.array(np.bincount(doc, weights=each, minlength=n)), pa.array(log_p)]
            out.append(pa.Table.from_arrays(arrays, names=names))
        return pa.concat_tables(out)

    names = ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    packed = picked.select("k", "text", "train", "chunk").mapInArrow(pack, "chunk long, blob binary")
    scored = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)
    return scored.withColumnRenamed("k", key)


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score_texts(documents(spark, sf_dir).select("doc_id", "text"), F.coalesce(~held_out, F.lit(True)))
