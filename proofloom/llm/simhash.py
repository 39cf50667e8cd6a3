"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints (64 bits) within TAU = 3 bits are linked. The bits are grouped into m partitions, correlated bits
together; partition i gets a threshold t_i >= -1 with sum(t_i) = TAU - m + 1, so two linked fingerprints must differ
by at most t_i bits in some partition. Thresholds come from a dynamic program over estimated cost: probes (every
value within t_i of a partition's own) plus candidates (pairs within t_i there). The estimate uses a sample of
fingerprints of fixed size and steers cost only: any allocation finds every link.

Equal fingerprints collapse first. Rows (partition, value, fingerprint) are sorted by value and streamed; within a
value, fingerprints are compared by arithmetic on whole arrays. A large group is searched breadth-first, each found
one leaving the rest, so it yields a spanning forest and never all its pairs.

`near_duplicates` links fingerprints; `similar_documents` takes fingerprints within WIDE_TAU bits as candidates and links
texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Pairs of that similarity whose fingerprints
lie further apart are found by a prefix filter: in any common order of the shingles, both texts have one of the first
(1 - similarity) of their shingles, and one more, in common. The order puts shingles that a sample shows to be common last.

Candidates of both ways must also be within BOTH_TAU of the 128 bits of two fingerprints, of three-word and of five-word
shingles: of these, pairs of that similarity differ in 19 bits on average with a standard deviation of 4, others in 64 with
one of 6. So clusters of candidates hold little else than similar texts, and no text is fetched for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.llm.common import documents, key_bitmap, staged, temporary, text_or_empty, wrapped
from proofloom.llm.components import connected_components
from proofloom.llm.textnum import Tokens, mix, slices

TAU = 3
SHINGLE = 3
SEED = 42
SHINGLES = 5  # words of a shingle that similarity is measured on
SIMILARITY = 0.8
WIDE_TAU = 11  # bits within which texts are candidates for that similarity
PREFIX_TAU = 26  # bits within which texts that share a rare shingle are candidates
BOTH_TAU = 42  # bits of two fingerprints together within which any texts are candidates
ORDER_SAMPLE = 4096  # texts that show which shingles are common; they steer cost only, as any order finds every pair
COMMON = 3  # of them that hold a common shingle
COMMON_LIMIT = 1 << 19
BLOCK_SHINGLES = 1 << 20  # shingles of the texts of a cluster that are verified against each other at once
LEADERS = 16  # texts of a large cluster that all its blocks are verified against first
SLICE = 1 << 19
SAMPLE = 4096  # fingerprints that steer the allocation
PROBE_COST = 40.0  # of a probe row, in comparisons of two fingerprints
SMALL_GROUP = 256
LINK_ROWS = 1 << 17
_CHUNK = 1 << 15


def words_fingerprint(words: list[bytes], shingle: int = SHINGLE, distinct: bool = False) -> bytes:
    """Eight bytes, most significant first, of the shingles of words (with repeats unless distinct). No words: zero."""
    if not words:
        return bytes(8)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, dtype=np.int64), 0
    seen: set[bytes] = set()
    for lo in range(0, len(words) - k + 1, _CHUNK):
        part = words[lo : lo + _CHUNK + k - 1]
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*[part[i:] for i in range(k)], strict=False))]
        if distinct:
            new = set(hashes) - seen
            seen |= new
            hashes = list(new)
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), dtype=np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
        n += len(hashes)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    return words_fingerprint((text or "").encode().lower().split(), shingle)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (bigint with the fingerprint's bits): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = b"".join(fingerprint(t.as_py(), shingle) for t in batch.column(1))
            fp = np.frombuffer(prints, dtype=">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["k", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), text_or_empty(text)).mapInArrow(run, f"k {kind}, fp long")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size: each starts at a free bit and takes the free bits most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = 1.0
    near = np.abs((centred.T @ centred) / spread[:, None] / spread[None, :])
    free, groups = list(range(64)), []
    for i in range(m):
        size = len(free) // (m - i)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (near[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a partition, packed into one number."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for place, bit in enumerate(group):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and least cost; costs[i][t + 1] is the cost of t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                option = (cost + row[t + 1], [*chosen, t])
                if have + t not in after or option < after[have + t]:
                    after[have + t] = option
        best = after
    return best[total]


def plan_partitions(sample: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, for n fingerprints of which sample is a part."""
    plans = []
    for m in range(2, tau + 2):
        groups = bit_groups(sample, m)
        costs = []
        for group in groups:
            values = part_values(sample, group)
            counts = np.zeros(tau + 1)
            for lo in range(0, len(values), 256):
                far = np.bitwise_count(values[lo : lo + 256, None] ^ values[None, :])
                counts += [(far <= t).sum() for t in range(tau + 1)]
            # a pair counts with a floor of one in 2**bits, which a small sample cannot show
            share = np.maximum((counts - len(values)) / max(1, len(values) * (len(values) - 1)), 0.5 ** len(group))
            row = [0.0]
            for t in range(tau - m + 2):
                probes = sum(comb(len(group), r) for r in range((t + 1) // 2 + 1))
                row.append(n * probes * PROBE_COST + n * n / 2 * share[t])
            costs.append(row)
        cost, thresholds = allocate(costs, tau - m + 1)
        plans.append((cost, m, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[:2])[2]


def _roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows is connected to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], least)
        np.minimum.at(new, root[right], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links_of(value: np.ndarray, probe: np.ndarray, fp: np.ndarray, size: np.ndarray, second: np.ndarray, tau: int, ratio: float, both: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among complete groups of equal value; rows are sorted by value, probes last."""

    def linked(a, b):
        far = np.bitwise_count(fp[a] ^ fp[b])
        near = far <= tau
        if ratio:
            near &= (far + np.bitwise_count(second[a] ^ second[b]) <= both) & (np.minimum(size[a], size[b]) >= ratio * np.maximum(size[a], size[b]))
        return near

    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    sizes = np.diff(np.r_[starts, len(value)])
    left, right = [], []
    run_of = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    own = np.flatnonzero(small & ~probe)
    ends = (starts + sizes)[run_of]
    step = 1
    while len(own):
        own = own[own + step < ends[own]]
        a, b = own, own + step
        close = linked(a, b)
        left.append(a[close])
        right.append(b[close])
        step += 1
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        rest = np.arange(starts[g], starts[g] + sizes[g])
        if probe[rest].all():
            continue
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                close = linked(rest, at)
                if close.any():
                    found, rest = rest[close], rest[~close]
                    left.append(np.full(len(found), at))
                    right.append(found)
                    queue.extend(found.tolist())
    if not left:
        return fp[:0], fp[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    rows, index = np.unique(np.r_[i, j], return_inverse=True)
    root = _roots(index[: len(i)], index[len(i) :], len(rows))
    a, b = fp[rows[root]], fp[rows]
    different = a != b
    return a[different], b[different]


ROWS = "v long, probe boolean, fp long, size int, second long"


def linked_rows(rows: DataFrame, tau: int, ratio: float, both: int = BOTH_TAU) -> DataFrame:
    """a, b: links that connect the fingerprints within tau bits among rows (v, probe, fp, size, second) of equal v; with a
    ratio, both fingerprints must also be within `both` bits together and the sizes fit."""

    def link(batches):
        held: list[list[np.ndarray]] = []
        count = 0

        def emit(rows):
            a, b = _links_of(*rows, tau, ratio, both)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            v, probe, fp, size, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            held.append([v, probe, fp.view(np.uint64), size, second.view(np.uint64)])
            count += len(v)
            if count >= LINK_ROWS:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                held, count = [[c[cut:] for c in cols]], count - cut
                if cut:
                    yield emit([c[:cut] for c in cols])
        if count:
            yield emit([np.concatenate(x) for x in zip(*held, strict=True)])

    return rows.repartition("v").sortWithinPartitions("v", "probe", "fp").mapInArrow(link, "a long, b long")


def fingerprint_links(prints: DataFrame, tau: int = TAU, ratio: float = 0.0, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """prints: distinct fp, or (fp, size, second). Returns a, b: links that connect whatever is linked at tau bits or fewer.

    With a ratio, rows are linked only if the smaller size is at least that share of the larger and the second fingerprints
    fit too.
    """
    if "size" not in prints.columns:
        prints = prints.select("fp", F.lit(0).alias("size"), F.lit(0).cast("long").alias("second"))
    if plan is None:
        picked = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
        plan = plan_partitions(picked, prints.count(), tau) if len(picked) else []

    def signatures(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (group, t) in enumerate(plan):
                own = part_values(fp, group)
                # values t bits apart meet half-way: at t // 2 flips of each, one of both flips once more if t is odd
                for r in range((t + 1) // 2 + 1):
                    for flips in combinations(range(len(group)), r):
                        mask = np.uint64(sum(1 << f for f in flips))
                        value = (own ^ mask) | np.uint64(number << 58)
                        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.full(len(fp), r > t // 2)), *batch.columns], ["v", "probe", "fp", "size", "second"])

    return linked_rows(prints.select("fp", F.col("size").cast("int"), "second").mapInArrow(signatures, ROWS), tau, ratio)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """key, fp, component_id: one row per row of df; component_id is the smallest key reachable over links.

    Null and empty texts have fingerprint zero and are linked like others; a null key is never the smallest unless
    all keys of a component are null. Repeated rows share their component. An empty table gives an empty one.
    """
    with temporary():
        prints = staged(fingerprints(df, key, text, shingle), "fingerprints", keep=True)
        smallest = staged(prints.groupBy("fp").agg(F.min("k").alias("least")), "distinct-fingerprints")
        roots = connected_components(fingerprint_links(smallest, tau))
        rooted = smallest.join(roots, smallest.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        by_print = staged(rooted.join(firsts, "root").select("fp", "component_id"), "components", keep=True)
    return prints.join(by_print, "fp").select(F.col("k").alias(key), "fp", "component_id")


def shingle_sets(texts: list[bytes], shingle: int = SHINGLES) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words: the whole sequence; no words: one common hash."""
    t = Tokens(texts)
    counts = np.bincount(t.doc, minlength=len(texts))
    ends = np.cumsum(counts)
    hashes = np.zeros(len(t.hashes), dtype=np.uint64)
    for o in range(shingle):  # of the words that follow in the same text
        after = np.minimum(np.arange(len(hashes)) + o, max(0, len(hashes) - 1))
        same = (np.arange(len(hashes)) + o < ends[t.doc]) if len(hashes) else np.zeros(0, dtype=bool)
        hashes = mix(hashes ^ np.where(same, t.hashes[after] if len(hashes) else 0, np.uint64(0)) + np.uint64(o))
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        out.append(np.unique(hashes[end - n : end - n + max(1, n - shingle + 1)]) if n else np.zeros(1, dtype=np.uint64))
    return out


def verified_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is `similarity` or more: breadth-first, by an
    inverted index of the sets that are not yet reached."""
    sizes = np.array([len(x) for x in sets])
    waiting = np.ones(len(sets), dtype=bool)
    links: list[tuple[int, int]] = []

    def index(rows: np.ndarray):
        keys = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(rows, sizes[rows])
        order = np.argsort(keys, kind="stable")
        return keys[order], owner[order], len(rows)

    keys, owner, indexed = index(np.arange(len(sets)))
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            left = int(waiting.sum())
            if not left:
                break
            if left * 2 < indexed:
                keys, owner, indexed = index(np.flatnonzero(waiting))
            lo, hi = np.searchsorted(keys, sets[at]), np.searchsorted(keys, sets[at], side="right")
            n = hi - lo
            place = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            shared = np.bincount(owner[place], minlength=len(sets))
            close = np.flatnonzero(waiting & (shared > 0) & (shared >= similarity * (sizes + sizes[at] - shared) - 1e-9))
            waiting[close] = False
            links += [(at, int(c)) for c in close]
            queue += close.tolist()
    return links


def rare_prefixes(sets: list[np.ndarray], common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number of its set) of the first shingles of each set, by their counts (sorted common; others: 0) and
    then by hash. Two sets whose Jaccard similarity is `similarity` or more share at least one of them."""
    sizes = np.array([len(x) for x in sets])
    keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    seen = np.zeros(len(keys), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        seen = np.where(common[at] == keys, counts[at], 0)
    order = np.lexsort((keys, seen, owner))
    nth = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    taken = np.array([n - ceil(similarity * n - 1e-9) + 1 for n in sizes.tolist()])
    order = order[nth < taken[owner]]
    return keys[order], owner[order]


def set_print(hashes: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes: each bit that over half of them have."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[lo : lo + _CHUNK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def common_shingles(picked: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of shingles that several of about ORDER_SAMPLE texts of rows (k, text) hold, COMMON_LIMIT of
    them at most."""

    def sampled(batches):
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(0)]
            for lo, hi in slices(texts, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts[lo:hi], shingle)).view(np.int64))], ["h"])

    some = picked.filter(F.pmod(F.xxhash64("k"), F.lit(-(-n // ORDER_SAMPLE) or 1)) == 0).select("text")
    often = some.mapInArrow(sampled, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    often = often.orderBy(F.desc("n"), "h").limit(COMMON_LIMIT).toPandas()
    common, counts = often["h"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(common)
    return common[order], counts[order]


def described(picked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """k, fp, second, size, s1, s2, rare for rows (k, text): two fingerprints, number of distinct shingles, a digest of the
    words, and the shingles of the rare prefix."""
    shared = picked.sparkSession.sparkContext.broadcast(common_shingles(picked, picked.count(), shingle))

    def describe(batches):
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(1)]
            for lo, hi in slices(texts, SLICE):
                words = [t.lower().split() for t in texts[lo:hi]]
                fp = np.frombuffer(b"".join(words_fingerprint(w, SHINGLE, True) for w in words), dtype=">u8").astype(np.uint64).view(np.int64)
                same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), dtype=np.int64).reshape(-1, 2)
                sets = shingle_sets(texts[lo:hi], shingle)
                second = np.array([set_print(x) for x in sets], dtype=np.uint64).view(np.int64)
                v, owner = rare_prefixes(sets, *shared.value, similarity)
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sets)))].astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(v.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(fp), pa.array(second), pa.array([len(x) for x in sets], pa.int32()), pa.array(same[:, 0]), pa.array(same[:, 1]), rare], ["k", "fp", "second", "size", "s1", "s2", "rare"])

    return picked.mapInArrow(describe, f"k {picked.schema['k'].dataType.simpleString()}, fp long, second long, size int, s1 long, s2 long, rare array<long>")


def verified_work(picked: DataFrame, work: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: links (of s1) within each group of work (k, s1, s2, cluster, i, j), by the texts of picked that work names."""
    asked = work.withColumnRenamed("k", "sought")
    named = picked.filter(key_bitmap(asked.select(F.xxhash64("sought").alias("h")), "h")(F.xxhash64("k")))
    rows = named.join(asked, F.col("k").eqNullSafe(F.col("sought"))).select("cluster", "i", "j", "s1", "s2", "text")
    dealt = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "s1", "s2")

    def verify(batches):
        group, names, held = None, [], []

        def flush():
            found = verified_links(held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([names[x[end]] for x in found], pa.int64()) for end in (0, 1)], ["a", "b"])

        for batch in batches:
            for c, i, j, s1, s2, t in zip(*(batch.column(x).to_pylist() for x in range(5)), batch.column(5), strict=True):
                if (c, i, j) != group:
                    if len(held) > 1:
                        yield flush()
                    group, names, held = (c, i, j), [], []
                data = t.as_py().encode()
                own = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(data.lower().split())), dtype=np.int64)
                if (own[0], own[1]) == (s1, s2) and (not names or names[-1] != s1):
                    names.append(s1)  # rows of the same key with another text don't belong here
                    held += shingle_sets([data], shingle)
        if len(held) > 1:
            yield flush()

    return dealt.mapInArrow(verify, "a long, b long")


def cluster_links(picked: DataFrame, clustered: DataFrame, shingle: int, similarity: float, block_size: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: links that connect all similar texts of each cluster. clustered: least, s1, s2, size, cluster; picked: k, text.

    A cluster above block_size shingles is cut into blocks. Each block is verified by itself together with LEADERS texts of
    the cluster; that joins what belongs to one family of copies, whatever its size. Only where a cluster then still falls
    apart, the texts outside its largest part are verified against all others, in pairs of blocks.
    """
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("total")).filter("n > 1")
    blocks = lambda total: F.ceil(total / F.lit(block_size)).cast("int")
    asked = staged(clustered.join(sizes, "cluster").withColumn("blocks", blocks(F.col("total"))).select(F.col("least").alias("k"), "s1", "s2", "size", "cluster", "blocks", F.pmod("s1", F.col("blocks")).cast("int").alias("block")), "clusters")
    work = asked.select("k", "s1", "s2", "cluster", F.col("block").alias("i"), F.lit(0).alias("j"))
    large = asked.filter("blocks > 1")
    if large.isEmpty():
        return verified_work(picked, work, shingle, similarity)
    heads = large.filter(F.col("block") < LEADERS).groupBy("cluster", "block").agg(F.min(F.struct("s1", "s2", "k")).alias("head"), F.first("blocks").alias("blocks"))
    heads = heads.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("i != block").select("head.k", "head.s1", "head.s2", "cluster", "i", F.lit(0).alias("j"))
    first = staged(verified_work(picked, work.unionByName(heads), shingle, similarity), "cluster-links")
    roots = connected_components(first)
    parts = staged(large.join(roots, large.s1 == roots.node, "left").withColumn("root", F.coalesce("root", "s1")).drop("node"), "cluster-parts")
    each = parts.groupBy("cluster", "root").agg(F.sum(F.col("size").cast("long")).alias("of_root"))
    main = each.groupBy("cluster").agg(F.max(F.struct("of_root", "root"))["root"].alias("main"), (F.sum("of_root") - F.max("of_root")).alias("rest")).filter("rest > 0").select("cluster", "main", blocks(F.col("rest")).alias("rests"))
    split = parts.join(main, "cluster")
    rest = split.filter("root != main").withColumn("own", F.pmod(F.xxhash64("s1"), F.col("rests")).cast("int"))
    other = lambda n, first: F.explode(F.sequence(F.lit(first), F.col(n) - 1 + first))
    columns = ("k", "s1", "s2", "cluster", "i", "j")
    among = rest.withColumn("other", other("rests", 0)).withColumn("i", F.least("own", "other") + 1).withColumn("j", -F.greatest("own", "other") - 1)
    with_main = rest.withColumn("i", F.col("own") + 1).withColumn("j", other("blocks", 0))
    of_main = split.filter("root = main").withColumn("i", other("rests", 1)).withColumn("j", F.col("block"))
    second = among.select(*columns).unionByName(with_main.select(*columns)).unionByName(of_main.select(*columns))
    return first.unionByName(verified_work(picked, second, shingle, similarity))


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLES, similarity: float = SIMILARITY, tau: int = WIDE_TAU, block_size: int = BLOCK_SHINGLES) -> DataFrame:
    """key, component_id for the rows of df that have a near duplicate: linked if the Jaccard similarity of their sets
    of `shingle` words is `similarity` or more; component_id is the smallest key reachable over links.

    Candidates are texts whose fingerprints are within tau bits, or within PREFIX_TAU bits if they share a shingle of
    their rare prefixes, and whose second fingerprints and sizes fit; connected candidates form a cluster, whose texts are
    verified whole. Texts equal but for case and blanks collapse first. Null and empty texts are one group. Rows of equal
    key are one document with several texts. Texts may have any length. An empty table gives an empty one.
    """
    picked = df.select(F.col(key).alias("k"), text_or_empty(text).alias("text"))
    rows = staged(described(picked, shingle, similarity), "descriptions")
    of_text = F.first(F.struct("fp", "second", "size", "rare"))
    texts = staged(rows.groupBy("s1", "s2").agg(F.min("k").alias("least"), of_text.alias("t"), F.count("*").alias("copies")).select("s1", "s2", "least", "t.*", "copies"), "distinct-texts")
    links = fingerprint_links(texts.select("fp", "size", "second").distinct(), tau, similarity)
    by_prefix = texts.select(F.explode("rare").alias("v"), F.lit(False).alias("probe"), "fp", "size", "second")
    links = links.unionByName(linked_rows(by_prefix, PREFIX_TAU, similarity)).distinct()
    clusters = connected_components(links)
    clustered = texts.join(clusters, texts.fp == clusters.node, "left").select("s1", "s2", "least", "size", F.coalesce("root", "fp").alias("cluster"))
    roots = connected_components(cluster_links(picked, clustered, shingle, similarity, block_size))
    rooted = texts.join(roots, texts.s1 == roots.node, "left").withColumn("root", F.coalesce("root", "s1"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1")
    found = rooted.join(firsts, "root").select("s1", "s2", "component_id")
    return rows.select("k", "s1", "s2").join(found, ["s1", "s2"]).select(F.col("k").alias(key), "component_id")


def drop_similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLES, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df without a near duplicate, and of each group the row with the smallest key; of equal keys one."""
    with temporary():
        found = staged(similar_documents(df, key, text, shingle, similarity), "groups", keep=True)
    goes = found.filter(~F.col("component_id").eqNullSafe(F.col(key))).select(F.col(key).alias("gone")).distinct()
    stays = wrapped(df, k=F.col(key)).join(goes, F.col("k").eqNullSafe(F.col("gone")), "left_anti")
    grouped = found.select(F.col(key).alias("member")).distinct()
    marked = stays.join(grouped, F.col("k").eqNullSafe(F.col("member")), "left")
    one = Window.partitionBy("k").orderBy(F.xxhash64("row"))
    several = marked.filter("member IS NOT NULL").withColumn("nth", F.row_number().over(one)).filter("nth = 1")
    return marked.filter("member IS NULL").select("row.*").unionByName(several.select("row.*"))


def op4_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
