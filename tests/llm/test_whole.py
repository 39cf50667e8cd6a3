"""The whole job: cases that a shorter way would lose."""

import hashlib
import itertools
import math
import random

from pyspark.sql import functions as F

from proofloom.llm import ctw, decontam, lines, mixing, simhash


def fresh(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


# pipeline


def test_copies_with_an_added_passage_are_similar(docs):
    rng = random.Random(21)
    texts = []
    for n in (40, 100, 400):
        for _ in range(40):
            base = fresh(rng, n)
            texts += [" ".join(base), " ".join(base + fresh(rng, (n - 4) // 4))]
    far = [(a, b) for a, b in zip(texts[0::2], texts[1::2], strict=True) if (int.from_bytes(simhash.words_fingerprint(a.encode().split(), 3, True)) ^ int.from_bytes(simhash.words_fingerprint(b.encode().split(), 3, True))).bit_count() > simhash.WIDE_TAU]
    assert len(far) > 10
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(*texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_prefixes_of_similar_sets_meet():
    import numpy as np

    rng = np.random.default_rng(22)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.r_[rng.permutation(a)[: max(1, -(-len(a) * 9 // 10))], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)])
        common = np.sort(rng.permutation(a)[: n // 2])
        v, owner = simhash.rare_prefixes([a, b], common, rng.integers(3, 9, len(common)), 0.8)
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert set(v[owner == 0].tolist()) & set(v[owner == 1].tolist())


# 1


def test_the_fifth_byte_back_decides(docs):
    rng = random.Random(24)
    texts = ["".join(rng.choice(["A1234x", "B1234y"]) for _ in range(50)) for _ in range(40)]
    row = ctw.score_texts(docs(*texts), F.col("doc_id") > 0).filter("held_out").first()
    assert row["score"] > -50 * math.log10(2) - 5


# 5


def test_masks_lose_no_admitted_replacement():
    for places in itertools.combinations(range(decontam.RUN), 2):
        fits = [{o + i for i, c in enumerate(m) if c == "1"} for m in decontam.MASKS for o in range(decontam.RUN - len(m) + 1)]
        assert any(look.isdisjoint(places) for look in fits), places
    for n in range(decontam.MIN_WORDS, decontam.RUN):
        for places in itertools.combinations(range(n), n - -(-n * 4 // 5)):
            assert any(set(look.tolist()).isdisjoint(places) for look in decontam.short_masks(n)), (n, places)


def test_changed_short_items_and_all_items_are_found(docs, spark):
    rng = random.Random(23)
    items = [fresh(rng, n) for n in range(5, 14)]
    twins = fresh(rng, 60)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(20, " ".join(twins + ["one"])), (21, " ".join(twins + ["two"]))], "item_id bigint, text string")
    texts = []
    for w in items:
        w = list(w)
        for p in [0, 1][: len(w) - -(-len(w) * 4 // 5)]:
            w[p] = "other"
        texts.append(" ".join(fresh(rng, 20) + w + fresh(rng, 20)))
    texts.append(" ".join(fresh(rng, 20) + twins[:40]))
    got = {r["doc"]: (r["n_items"], r["first_item"]) for r in decontam.contaminated(docs(*texts), bench).collect()}
    assert got == {i: (1, i) for i in range(len(items))} | {len(items): (2, 20)}


# 6


def test_filters_grow_with_the_third_batch(docs, spark):
    sizes = (20, 300, 3000)
    batches = [docs(*["\n".join(f"line {i} {j}" for j in range(n))] * 2).withColumn("doc_id", F.col("doc_id") + 10 * i) for i, n in enumerate(sizes)]
    index = lines.LineIndex(spark, 2, 2)
    keys = [index.insert(b) for b in batches]
    for k, n in zip(keys, sizes, strict=True):
        assert index.hot_keys(k).count() == 2 * n
    index.delete(batches[1])
    assert [index.hot_keys(k).count() for k in keys] == [40, 0, 6000]
    index.insert(batches[1])
    assert [index.hot_keys(k).count() for k in keys] == [2 * n for n in sizes]


# 7


def test_a_small_source_is_repeated_at_any_rate(spark):
    rows = [(i, "big", 4_000_000) for i in range(40)] + [(100, None, 10), (101, "few", 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = {r["doc_id"]: r["n"] for r in mixing.mix_sources(df, size=F.col("size")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    sizes = {"big": 160_000_000, "": 10, "few": 500}
    total, roots = sum(sizes.values()), sum(math.sqrt(x) for x in sizes.values())
    for i, source in ((100, ""), (101, "few")):
        rate = total / roots / math.sqrt(sizes[source])
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, cdf = -1, 0.0
        while True:
            k += 1
            cdf += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            if cdf > u:
                break
        assert rate > 64 and got[i] == k


def test_contamination_of_all_documents_against_all_alignments(spark):
    import numpy as np

    from tests.conftest import SF

    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    number = {}
    ids = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in (t or "").encode().lower().split()], dtype=np.int64)
    items = {r["item_id"]: ids(r["text"]) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        words = np.r_[np.full(12, -1), ids(r["text"]), np.full(12, -1)]
        for item, own in items.items():
            if len(own) < decontam.MIN_WORDS or not np.intersect1d(words, own).size:
                continue
            padded = np.r_[np.full(12, -2), own, np.full(12, -2)]
            equal = words[:, None] == padded[None, :]
            need = 11 if len(own) >= decontam.RUN else math.ceil(0.8 * len(own))
            for k in range(-len(words) + 1, len(padded)):
                line = equal.diagonal(k).astype(np.int64)
                if line.sum() < need:
                    continue
                runs = np.convolve(line, np.ones(decontam.RUN, dtype=np.int64)) if len(own) >= decontam.RUN else line.sum()
                if np.max(runs) >= need:
                    want.setdefault(r["doc_id"], set()).add(item)
                    break
    got = {r["doc"]: (r["n_items"], r["first_item"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {d: (len(x), min(x)) for d, x in want.items()} and got
