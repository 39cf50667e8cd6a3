"""Substring dedup over words by relative Lempel-Ziv parsing: words covered by a window of `WINDOW` words that also starts in
a document with a smaller id.

Reference blocks. A window's anchor is the least hash among its runs of GRAM words, so equal windows have equal anchors. A
document is cut into pieces, longest stretches of windows with one anchor (MOST windows at most), and a piece is dealt to the
block of its anchor: no other block can hold any of its windows, so parsing it against that block parses it against all.
Pieces with equal words collapse before they are fetched; only anchors that stand in several documents with unequal pieces
make a block.

A block is indexed by a suffix array over its words in order of documents. Each piece is factored greedily: at a place the
longest run of words that also starts in a piece of a smaller document is the next factor; factors under WINDOW words are
passed over. A window across a factor's end may stand in the reference although the factor is at its longest, so parsing
goes on from the first place before that end where a factor of WINDOW words or more starts and reaches beyond it.

Hot groups. An anchor with many rows is salted in the join that follows it; a block of over BLOCK words is dealt anew, window
by window, by the window's own hash, where the least document is told before anything is joined; pieces with very many
copies, few by their share of all rows, are joined by a broadcast table of at most HOT rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.common import documents, drop_staged, filled_bitmap, key_bitmap, staged, temporary, text_or_empty, wrapped
from proofloom.llm.suffix import merged, sliding_min
from proofloom.llm.textnum import Tokens, mix, powers, slices

WINDOW = 13
GRAM = 4
MOST = 32  # windows of a piece
BLOCK = 1 << 18  # words of an anchor beyond which its block is dealt anew; blocks are indexed together up to this size
HOT = 4096  # keys that may hold more than a 4096th of all rows
SALTS = 32
BITS = 25  # of the bitmaps that spare shuffles: 4 MB each
SLICE = 1 << 19
BLANKS = " \t\n\x0b\x0c\r"
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)


def pieces(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first word, number of windows, anchor, hash of the words) of all pieces."""
    t = Tokens(texts, lower=False)
    n = len(t.hashes) - window + 1
    if n <= 0:
        return (*(np.zeros(0, dtype=np.int64),) * 3, *(np.zeros(0, dtype=np.uint64),) * 2)
    prefix = np.zeros(len(t.hashes) + 1, dtype=np.uint64)
    np.cumsum(t.hashes * powers(_BASE, len(t.hashes)), dtype=np.uint64, out=prefix[1:])
    back = powers(_BACK, len(t.hashes))
    least = sliding_min(mix((prefix[gram:] - prefix[:-gram]) * back[: len(prefix) - gram]), window - gram + 1)
    inside = t.doc[:n] == t.doc[window - 1 :]
    fresh = np.r_[True, (least[1:] != least[:-1]) | (t.doc[1:n] != t.doc[: n - 1])]
    at = np.flatnonzero(fresh & inside)
    edges = np.append(np.flatnonzero(fresh | ~inside), n)
    size = edges[np.searchsorted(edges, at, side="right")] - at
    parts = -(-size // MOST)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at, size = np.repeat(at, parts) + step * MOST, np.minimum(np.repeat(size, parts) - step * MOST, MOST)
    first = np.searchsorted(t.doc, np.arange(t.n_docs))
    content = mix((prefix[at + size + window - 1] - prefix[at]) * back[at]) ^ mix(size.astype(np.uint64))
    return t.doc[at], at - first[t.doc[at]], size, least[at], content


def suffix_order(seq: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by doubling; no two agree in `longest` places or more."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    size = 1
    while True:
        second = np.zeros(len(seq), dtype=np.int64)
        second[:-size or None] = rank[size:] + 1
        key = rank * (len(seq) + 2) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(seq), dtype=np.int64)
        rank[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        size *= 2
        if size >= longest or size >= len(seq) or rank[order[-1]] == len(seq) - 1:
            return order


def longest_factors(seq: np.ndarray, owner: np.ndarray, longest: int, window: int) -> np.ndarray:
    """At each place of seq the longest factor of `window` words or more that also starts at a place of a smaller owner, or 0."""
    order = suffix_order(seq, longest)
    common = np.zeros(len(seq), dtype=np.int64)  # with the suffix before in order
    left = np.arange(1, len(seq))
    for k in range(longest):
        a, b = order[left] + k, order[left - 1] + k
        inside = (a < len(seq)) & (b < len(seq))
        left, a, b = left[inside], a[inside], b[inside]
        left = left[seq[a] == seq[b]]
        if not len(left):
            break
        common[left] = k + 1
    out = np.zeros(len(seq), dtype=np.int64)
    for size in range(window, longest + 1):
        starts = np.flatnonzero(common < size)
        if len(starts) == len(order):
            break
        least = np.minimum.reduceat(owner[order], starts)
        counts = np.diff(np.append(starts, len(order)))
        has = np.repeat(least, counts) < owner[order]
        if not has.any():
            break
        out[order[has]] = size
        stay = np.repeat(np.logical_or.reduceat(has, starts), counts)  # runs of which some place has a factor
        order, common = order[stay], common[stay]
    return out


def factor_spans(parts: list[bytes], owners: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each piece of a block (its words, its document's place in order) the spans of words that its factors cover."""
    t = Tokens(parts, lower=False)
    sizes = np.bincount(t.doc, minlength=len(parts))
    ends = np.cumsum(sizes + 1)
    seq = np.empty(ends[-1], dtype=np.int64)
    words = np.unique(t.hashes, return_inverse=True)[1]
    seq[np.arange(len(words)) + t.doc] = words
    seq[ends - 1] = len(words) + np.arange(len(parts))  # a mark of its own after each piece
    lengths = longest_factors(seq, np.repeat(owners, sizes + 1), int(sizes.max()) + 1, window)
    ahead = np.where(lengths > 0, np.arange(len(seq)), len(seq))
    ahead = np.append(np.minimum.accumulate(ahead[::-1])[::-1], len(seq))
    spans: list[list[tuple[int, int]]] = [[] for _ in parts]
    piece, at = np.arange(len(parts)), ends - sizes - 1
    while len(piece):
        at = ahead[at]
        going = at < ends[piece]
        piece, at = piece[going], at[going]
        stop = at + lengths[at]
        base = ends[piece] - sizes[piece] - 1
        for p, lo, hi in zip(piece.tolist(), (at - base).tolist(), (stop - base).tolist(), strict=True):
            spans[p].append((lo, hi))
        at = np.maximum(at + 1, stop - window + 1)
    return [merged(s) for s in spans]


SPANS = "array<struct<lo: int, hi: int>>"
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _span(lo, hi):
    return F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))


def _cut(named: DataFrame, kind: str, window: int, gram: int, shared=None, hot: np.ndarray | None = None) -> DataFrame:
    """Anchors with their document; with a bitmap of shared anchors all about the pieces that they may have."""

    def run(batches):
        for batch in batches:
            texts = [x.as_py().encode() for x in batch.column(2)]
            for lo, hi in slices(texts, SLICE):
                doc, start, size, anchor, content = pieces(texts[lo:hi], window, gram)
                h = anchor.view(np.int64)
                if shared is None:
                    yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(lo + doc))], ["h", "doc"])
                    continue
                place = (anchor >> np.uint64(64 - BITS)).astype(np.int64)
                may = np.flatnonzero((shared.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1)
                doc, start, size, h, content = doc[may] + lo, start[may], size[may], h[may], content[may]
                salt = np.where(np.isin(h, hot), (mix(content ^ mix(start.astype(np.uint64) + doc.astype(np.uint64))) % np.uint64(SALTS)).astype(np.int64), 0)
                arrays = [pa.array(h), pa.array(salt, pa.int32()), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(start, pa.int32()), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "salt", "c", "doc", "t", "start", "n"])

    columns = f"h long, doc {kind}" if shared is None else f"h long, salt int, c long, doc {kind}, t long, start int, n int"
    return named.select("doc", "t", "text").mapInArrow(run, columns)


def _fetch(fetched: DataFrame, kind: str, window: int) -> DataFrame:
    """The wanted pieces of texts: their words; for those in large blocks a row for each window instead, with its hash and place."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, (data, want) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                words = data.as_py().encode().split()
                for w in want:
                    part = words[w["start"] : w["start"] + w["n"] + window - 1]
                    if not w["large"]:
                        rows.append((i, w["h"], w["c"], b" ".join(part), None, 0))
                        continue
                    digests = b"".join(xxhash.xxh3_64_digest(b" ".join(part[k : k + window])) for k in range(w["n"]))
                    rows += [(i, w["h"], w["c"], None, x, k) for k, x in enumerate(np.frombuffer(digests, dtype=np.int64).tolist())]
            doc = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = [("h", pa.int64()), ("c", pa.int64()), ("words", pa.binary()), ("w", pa.int64()), ("k", pa.int32())]
            yield pa.RecordBatch.from_arrays([doc, *[pa.array([r[n] for r in rows], t) for n, (_, t) in enumerate(kinds, 1)]], ["doc", *[n for n, _ in kinds]])

    return fetched.select("doc", "text", "want").mapInArrow(run, f"doc {kind}, h long, c long, words binary, w long, k int")


def _factored(parts: DataFrame, window: int, block: int) -> DataFrame:
    """h, c, spans of pieces (h, c, doc, words): blocks of consecutive anchors are indexed and their pieces factored."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            rank = np.cumsum([0, *(a[0] == b[0] and a[2] != b[2] for a, b in zip(held, held[1:], strict=False))])  # in order within an anchor
            found = [(h, c, s) for (h, c, _, _), s in zip(held, factor_spans([r[3] for r in held], rank, window), strict=True) if s]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array([[{"lo": lo, "hi": hi} for lo, hi in r[2]] for r in found], _SPANS)], ["h", "c", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != last and size >= block:
                    yield flush()
                    held.clear()
                    size = 0
                held.append(row)
                size += row[3].count(b" ") + 1
                last = row[0]
        if held:
            yield flush()

    return parts.repartition("h").sortWithinPartitions("h", "doc", "c").mapInArrow(run, f"h long, c long, spans {SPANS}")


def duplicate_spans(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc, t, spans: for each row that loses words (named by its key and xxhash64 of its text) spans of words, which may overlap."""
    kind = df.schema[key].dataType.simpleString()
    named = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), text_or_empty(text).alias("text")).filter(F.octet_length("text") >= 2 * window - 1).withColumn("t", F.xxhash64("text"))
    anchors = _cut(named, kind, window, gram).groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("rows"))
    shared = staged(anchors.filter("a < b").select("h", "rows"), "shared-anchors")
    limit = int(shared.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]) / HOT
    hot = np.array([r[0] for r in shared.filter(F.col("rows") > limit).select("h").collect()], dtype=np.int64)  # under HOT values
    salts = F.when(F.col("rows") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    bitmap = df.sparkSession.sparkContext.broadcast(filled_bitmap(shared, "h", BITS))
    cuts = _cut(named, kind, window, gram, bitmap, hot)
    places = staged(cuts.join(shared.select("h", F.explode(salts).alias("salt")), ["h", "salt"]).drop("salt"), "places")
    drop_staged(shared)

    at = F.min(F.struct("doc", "t", "start")).alias("at")
    kinds = staged(places.groupBy("h", "c").agg(F.max("doc").alias("last"), F.count("*").alias("rows"), F.first("n").alias("n"), at), "kinds").withColumn("first", F.col("at.doc"))
    total = F.sum(F.col("n").cast("long") + F.lit(window - 1))
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("first").alias("a"), F.max("last").alias("b"), (total > block).alias("large")).filter("kinds > 1 AND a < b").select("h", "large")
    asked = kinds.join(several, "h").select("h", "large", "c", "n", "at.*")
    wanted = staged(asked.groupBy("doc", "t").agg(F.collect_list(F.struct("h", "large", "c", "start", "n")).alias("want")), "wanted")
    fetched = named.filter(key_bitmap(wanted, "t", BITS)("t")).join(wanted, ["doc", "t"])

    # rows of one id and text answer more than once; one answer of each piece stays
    parts = staged(_fetch(fetched, kind, window).dropDuplicates(["h", "c", "k"]), "parts")
    windows = parts.filter("words IS NULL")
    told = [_factored(parts.filter("words IS NOT NULL").select("h", "c", "doc", "words"), window, block)]
    if not windows.isEmpty():
        least = windows.groupBy("h", "w").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("h", "w", "a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        again = windows.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).join(least, ["h", "w", "salt"]).filter("doc > a")
        told.append(again.groupBy("h", "c").agg(F.collect_list(F.struct(F.col("k").alias("lo"), (F.col("k") + F.lit(window)).cast("int").alias("hi"))).alias("spans")))
    found = told[0] if len(told) == 1 else told[0].unionByName(told[1])

    verdicts = staged(kinds.join(found, ["h", "c"], "left").filter("first < last OR spans IS NOT NULL").select("h", "c", "first", "rows", "spans"), "verdicts")
    limit = int(verdicts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]) / HOT
    often, rest = F.broadcast(verdicts.filter(F.col("rows") > limit)), verdicts.filter(F.col("rows") <= limit)  # under HOT rows
    joined = places.join(often, ["h", "c"]).unionByName(places.join(F.broadcast(verdicts.filter(F.col("rows") > limit).select("h", "c")), ["h", "c"], "left_anti").join(rest, ["h", "c"]))
    whole = _span(F.col("start"), F.col("start") + F.col("n") + F.lit(window - 1))
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi")))
    per_place = joined.select("doc", "t", F.when(F.col("doc") > F.col("first"), whole).otherwise(moved).alias("spans")).filter("spans IS NOT NULL")
    return per_place.groupBy("doc", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_copied_words(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """df with n_words, n_removed, spans (of removed words, maximal) and kept (the other words, joined by one space), which
    replace columns so named.

    Words are what stands between blanks, unchanged. Null text has no words. A row with a null key neither loses words nor
    takes any; rows of one key take none from each other, equal texts lose all but in the rows of the smallest key, if they
    have a window. Texts may have any length below 2 GiB. Other columns are kept. An empty table gives an empty one.
    """
    df = df.drop("n_words", "n_removed", "spans", "kept")
    with temporary():
        found = staged(duplicate_spans(df, key, text, window, gram, block), "spans", keep=True)
    rows = wrapped(df, doc=F.col(key), text=text_or_empty(text)).withColumn("t", F.xxhash64("text")).withColumn("hit", key_bitmap(found, "t", BITS)("t"))

    @F.pandas_udf(f"n_words long, n_removed long, spans {SPANS}, kept string")
    def remove(texts: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        out = []
        for x, given in zip(texts, all_spans, strict=True):
            words = x.encode().split()
            spans = merged([(s["lo"], s["hi"]) for s in given]) if given is not None else []
            at, kept = 0, []
            for lo, hi in spans:
                kept += words[at:lo]
                at = hi
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), [{"lo": lo, "hi": hi} for lo, hi in spans], b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "spans", "kept"])

    hit = rows.filter("hit").join(found.select(F.col("doc").alias("d"), F.col("t").alias("s"), "spans"), (F.col("doc") == F.col("d")) & (F.col("t") == F.col("s")), "left").withColumn("out", remove("text", "spans")).select("row.*", "out.*")
    plain = F.regexp_replace(F.btrim("text", F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")
    count = F.when(F.col("plain") == "", F.lit(0)).otherwise(F.length("plain") - F.length(F.translate("plain", " ", "")) + 1).cast("long")
    rest = rows.filter("NOT hit").withColumn("plain", plain).select("row.*", count.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(SPANS.replace(": ", ":")).alias("spans"), F.col("plain").alias("kept"))
    return hit.unionByName(rest)


def op11_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_copied_words(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW}),
s AS (SELECT rid, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS run FROM p),
least AS (SELECT run, min(doc_id) AS first FROM s GROUP BY run),
hit AS (SELECT DISTINCT rid, i FROM s JOIN least USING (run) WHERE doc_id > first),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
f AS (SELECT x.rid, x.word, x.j, max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY x.rid ORDER BY x.j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN hit ON x.rid = hit.rid AND x.j = hit.i),
g AS (SELECT rid, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM f GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.rid = g.rid"""
