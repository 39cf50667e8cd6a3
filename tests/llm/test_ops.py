"""Each operator against a plain version of itself, and on nulls, empty and repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import blocksort, ctw, decontam, html_text, induced, lines, mixing, ogg, quality, sharding, simhash, suffix, textnum
from proofloom.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    def build(*texts, ids=None):
        ids = ids or range(len(texts))
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)

    return build


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# 1


def test_ctw_against_direct_counts(make, empty):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(0, 30), 12) for _ in range(14)] + [None, "", "ÄÖ é\n日本"]
    df = make(*texts)
    held = [i % 4 == 1 for i in range(len(texts))]
    rows = {r["doc_id"]: r for r in ctw.score_texts(df, F.col("doc_id") % 4 != 1).collect()}
    train = [t or "" for t, h in zip(texts, held, strict=True) if not h]
    tok = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(x for t in train for x in tok(t))
    total, v = sum(c.values()), len(c)
    grams = defaultdict(Counter)
    for t in train:
        data = bytes(ctw.DEPTH) + t.encode() + b"\xff"
        for i in range(ctw.DEPTH, len(data)):
            for d in range(ctw.DEPTH + 1):
                grams[d, data[i - d : i]][data[i]] += 1

    def bits(ctx, prefix, bit):
        n = [0, 0]
        for x, k in grams[len(ctx), ctx].items():
            if x >> (bit + 1) == prefix:
                n[x >> bit & 1] += k
        return n

    def log_pe(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    memo = {}

    def log_pw(ctx, prefix, bit):
        key = (ctx, prefix, bit)
        if key not in memo:
            pe = log_pe(bits(ctx, prefix, bit))
            if len(ctx) == ctw.DEPTH:
                memo[key] = pe
            else:
                kids = sum(log_pw(bytes([b]) + ctx, prefix, bit) for b in range(256) if grams.get((len(ctx) + 1, bytes([b]) + ctx)))
                memo[key] = float(np.logaddexp(pe, kids)) + math.log(0.5)
        return memo[key]

    def p_one(context, prefix, bit):
        p = None
        for d in range(ctw.DEPTH, -1, -1):
            ctx = context[len(context) - d :]
            n = bits(ctx, prefix, bit)
            kt = (n[1] + 0.5) / (sum(n) + 1)
            if p is None:
                p = kt
            else:
                w = math.exp(math.log(0.5) + log_pe(n) - log_pw(ctx, prefix, bit))
                p = w * kt + (1 - w) * p
        return p

    for i, t in enumerate(texts):
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in tok(t))
        data, score = bytes(ctw.DEPTH) + (t or "").encode() + b"\xff", 0.0
        for k in range(ctw.DEPTH, len(data)):
            for bit in range(7, -1, -1):
                p = p_one(data[k - ctw.DEPTH : k], data[k] >> (bit + 1), bit)
                score += math.log10(p if data[k] >> bit & 1 else 1 - p)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tok(t)), sum(c[x] > 0 for x in tok(t)), total)
        assert r["base_score"] == pytest.approx(base, abs=1e-3) and r["score"] == pytest.approx(score, abs=1e-3)
    assert ctw.score_texts(empty, F.lit(True)).count() == 0


# 2


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1)
        index = sharding.hilbert_index(list(cells), bits)
        assert sorted(index) == list(range(1 << (dims * bits)))
        path = cells[:, np.argsort(index)]
        assert (np.abs(np.diff(path)).sum(axis=0) == 1).all()


def test_shards_are_even_and_gapless(make, empty):
    df = make(*["x" * (i % 7) for i in range(53)], None, ids=[*range(50), 3, 3, None, 7]).withColumn("shard", F.lit("clash"))
    rows = sharding.hilbert_shards(df, ["source", "lang", "n_chars"], "doc_id", 5).collect()
    assert len(rows) == 54
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append((r["slot"], r["hilbert"]))
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    for part in per.values():
        assert [s for s, _ in sorted(part)] == list(range(len(part))) and [h for _, h in sorted(part)] == sorted(h for _, h in part)
    assert sharding.hilbert_shards(empty, ["source"], "doc_id").count() == 0
    assert {r["shard"] for r in sharding.hilbert_shards(make("a", "b"), ["source"], "doc_id").collect()} == {0, 8}


def test_equal_keys_have_one_order_and_clashing_names_go(spark):
    rows = [(None if i % 3 else 7, "s", i % 4, "old", "old", "old") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, source string, n int, hilbert string, shard string, slot string")
    one, two = ({(r["shard"], r["slot"]): (r["doc_id"], r["n"]) for r in sharding.hilbert_shards(x, ["source"], "doc_id", 4).collect()} for x in (df, df.repartition(3)))
    assert one == two and len(one) == 60
    wide = sharding.hilbert_shards(df, ["source", "n"], "doc_id", 4, bits=8).select("hilbert")  # beyond the looked-up table
    assert wide.distinct().count() == 4


def test_written_shards_prune_files(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.xxhash64("id") % 8).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000).alias("b"))
    out = sharding.hilbert_shards(df.withColumn("a", F.pow(F.lit(2.0), F.abs("a") * 4)).withColumn("b", F.pow(F.lit(2.0), F.abs("b") % 8 * 4)), ["a", "b"], "doc_id", 16)
    sharding.write_shards(out, f"{tmp_path}/h")
    back = spark.read.parquet(f"{tmp_path}/h")
    assert back.count() == 4000 and back.select("shard").distinct().count() == 16
    bounds = []
    for shard in range(16):
        t = pq.read_table(f"{tmp_path}/h/shard={shard}").to_pandas()
        assert t["slot"].tolist() == list(range(250))
        bounds.append({c: (t[c].min(), t[c].max()) for c in ("a", "b")})
    values = [2.0 ** (4 * i) for i in range(8)]
    for c in ("a", "b"):  # shards that a filter on one value must read, of 16; dealt at random it is all of them
        assert sum(sum(x[c][0] <= v <= x[c][1] for x in bounds) for v in values) / 8 <= 8


# 3


def plain_common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_suffix_orders(block):
    rng = random.Random(block)
    for k in range(250):
        t = bytes(rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))) * rng.choice([1, 1, 3])
        order = sorted(range(len(t)), key=lambda i: t[i:])
        want = [(i, plain_common(t[order[r - 1] :], t[i:]) if r else 0) for r, i in enumerate(order)]
        assert list(induced.suffix_array(t, block)) == want
        down = [(int(p), int(c)) for ps, cs in blocksort.neighbours(t, rng.choice([0, 1000]), rng.choice([0, 1000])) for p, c in zip(ps, cs, strict=True)]
        assert [p for p, _ in down] == order[::-1] and [c for _, c in down] == ([0] + [c for _, c in want[1:]][::-1] if t else [])


def plain_passages(texts, n=suffix.WORDS):
    seen = Counter()
    runs = []
    for t in texts:
        w = (t or "").encode().lower().split()
        runs.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
        seen.update(runs[-1])
    return [any(seen[r] > 1 for r in own) for own in runs]


def test_halves_hold_each_window_once():
    rng = random.Random(5)
    for _ in range(300):
        length = rng.randint(1, 30)
        core = rng.randint(1, length)
        lo = rng.randint(0, length - core)
        windows = rng.randint(1, lo + 1)
        lo = max(lo, windows - 1)
        data = bytes(rng.randrange(256) for _ in range(windows + length - 1))
        if lo + core > length:
            continue
        left = [(0, data, lo, lo + core)]
        for _ in range(12):
            for at, part, a, b in left:
                assert data[at : at + len(part)] == part and all(w <= a and b <= w + length for w in range(len(part) - length + 1))
            assert sorted(at + w for at, part, _, _ in left for w in range(len(part) - length + 1)) == list(range(windows))
            left = [(at + more, x, a2, b2) for at, part, a, b in left for more, x, a2, b2 in suffix.halves(part, a, b, length)]
        assert all(b - a == length == len(part) for _, part, a, b in left)


def test_a_line_of_many_documents_is_split(make):
    rng = random.Random(15)
    line = words(rng, 60, 90)[:230]
    long_line = words(rng, 200, 90)[:390]
    texts = []
    for i in range(60):
        tail = words(rng, 12, 3) if i % 5 == 0 else words(rng, 60)
        texts.append(words(rng, 60) + " " + (line if i % 2 else long_line) + " " + tail)
    texts += [texts[0], "again " + texts[1][20:], ("xy" * 300) + line + ("xy" * 300), ("xy" * 300) + line + ("xy" * 301), line * 4]
    length, data = suffix.LENGTH, [t.encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    passages = plain_passages(texts)
    for shard in (1500, 1 << 19):
        rows = suffix.without_repeats(make(*texts), shard=shard).collect()
        assert len(rows) == len(texts)
        for r in rows:
            d = data[r["doc_id"]]
            gone = bytearray(len(d))
            for i in range(len(d) - length + 1):
                if seen[d[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            assert bytes(r["kept"]) == bytes(b for b, g in zip(d, gone, strict=True) if not g), (shard, r["doc_id"])
            assert r["shares_passage"] == passages[r["doc_id"]], r["doc_id"]


def test_repeated_substrings(make, empty):
    rng = random.Random(4)
    shared = [words(rng, 120) for _ in range(3)]
    texts = [words(rng, 40) + " " + rng.choice(shared)[rng.randint(0, 90) :] + " " + words(rng, 30) for _ in range(16)]
    texts += ["ab " * 300, texts[0], texts[0], None, "", "é" * 250, "x" + "é" * 250, "short"]
    df = make(*texts).withColumn("kept", F.lit(1))
    length, data = suffix.LENGTH, [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    passages = plain_passages(texts)
    for r in suffix.without_repeats(df).collect():
        assert r["shares_passage"] == passages[r["doc_id"]]
        d = data[r["doc_id"]]
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        assert bytes(r["kept"]) == bytes(b for b, g in zip(d, gone, strict=True) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(d), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()))
    assert suffix.without_repeats(empty).count() == 0


# 4


def near(sets, least):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if least(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_simhash_components(make, empty):
    rng = random.Random(6)
    base = [words(rng, 150) for _ in range(6)]
    texts = []
    for _ in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 6])):
            w[rng.randrange(len(w))] = "Other"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "one", "ONE", "one two"]
    prints = [int.from_bytes(simhash.fingerprint(t), "big") for t in texts]
    want = near(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(make(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(prints, want, strict=True))
    assert prints[-6] == 0 and simhash.near_duplicates(empty).count() == 0


def test_similar_documents(make, empty, monkeypatch):
    rng = random.Random(8)
    base = [words(rng, 120) for _ in range(5)]
    texts = []
    for _ in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [None, "", texts[0].upper(), "lone text"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    want = near(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    alone = {i for i, n in Counter(want).items() if n == 1}
    for block in (1 << 20, 150):  # one block, and pairs of blocks
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(make(*texts), block_size=block).collect()}
        assert got == {i: r for i, r in enumerate(want) if r not in alone}
    kept = {r["doc_id"] for r in simhash.drop_similar_documents(make(*texts)).collect()}
    assert kept == set(want)
    assert simhash.drop_similar_documents(empty).count() == 0
    assert simhash.drop_similar_documents(make("a b", "a b", "c", ids=[1, 1, None])).count() == 2


def test_large_groups_yield_forests():
    rng = np.random.default_rng(1)
    fp = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 40, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 900).astype(np.uint64)))
    a, b = simhash._links_of(np.zeros(len(fp), dtype=np.int64), np.zeros(len(fp), dtype=bool), fp, np.zeros(len(fp), dtype=np.int32), fp, 3, 0.0, 64)
    assert len(a) < len(fp) and len(set(a) | set(b)) == len(fp)


def test_partition_plans_cover_tau():
    rng = np.random.default_rng(2)
    for n in (10, 10**5, 10**8):
        sample = rng.integers(0, 1 << 63, 256).astype(np.uint64)
        plan = simhash.plan_partitions(sample, n)
        assert sum(t + 1 for _, t in plan) == 4 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 5


def test_contamination(make, empty, spark):
    rng = random.Random(9)
    items = [words(rng, 30, 5000) for _ in range(4)] + ["five words that are short", "x y"]
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id bigint, text string")
    swapped = items[1].split()
    swapped[7] = swapped[20] = "other"
    apart = items[2].split()
    apart[::3] = ["no"] * len(apart[::3])
    texts = [words(rng, 50, 5000) + " " + items[0].upper() + " tail", "head " + " ".join(swapped), " ".join(apart), words(rng, 200, 5000), None, "", "say five words that are short now", "x y", " ".join(items[3].split()[:14])]
    got = {r["doc_id"]: (r["contaminated"], r["first_item"]) for r in decontam.flag_contaminated(make(*texts).withColumn("n_items", F.lit(0)), bench).collect()}
    assert {i for i, (c, _) in got.items() if c} == {0, 1, 6, 8} and got[0][1] == 0 and got[1][1] == 1 and got[6][1] == 4
    assert {r["doc_id"] for r in decontam.drop_contaminated(make(*texts), bench).collect()} == {2, 3, 4, 5, 7}
    assert decontam.drop_contaminated(empty, bench).count() == 0 and decontam.drop_contaminated(make("a"), bench.limit(0)).count() == 1


# 6


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 5000).astype(np.uint64)
    f = lines.CuckooFilter.build(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(1, 1 << 62, 20000).astype(np.uint64)).mean() < 0.01
    assert all(f.delete(k) for k in keys[:2500])
    back = lines.CuckooFilter.from_bytes(f.to_bytes())
    assert back.contains(keys[2500:]).all() and back.contains(keys[:2500]).mean() < 0.02 and back.size == 2500


def plain_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(lines.UPPER, lines.LOWER))
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < least) for t in texts]


def test_line_dedup_and_its_undoing(make, empty, spark):
    rng = random.Random(11)
    pool = ["Common line", " common LINE\t", "é Ä", "", "  ", "rare", "other"] + [f"l{i}" for i in range(30)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(40)] + [None, "", "\n"]
    df = make(*texts)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, min_docs=5).collect()}
    assert [got[i] for i in range(len(texts))] == plain_lines(texts, 5)
    index = lines.LineIndex(spark, 4, 5)
    first, second = df.filter("doc_id < 25"), df.filter("doc_id >= 25")
    keys = index.insert(first)
    before = {tuple(r) for r in index.counts.collect()}, {tuple(r) for r in index.hot_keys(keys).collect()}
    index.insert(second)
    index.delete(second)
    assert ({tuple(r) for r in index.counts.collect()}, {tuple(r) for r in index.hot_keys(keys).collect()}) == before
    assert lines.dedup_lines(empty).count() == 0
    assert lines.dedup_lines(make(*["a"] * 3, ids=[1, 1, None]), min_docs=2).filter("text = ''").count() == 3


# 7


def test_poisson_mixing(make, empty):
    df = make(*["x" * 10] * 400)
    out = mixing.mix_sources(df, targets={"s0": 3.0, "s1": 1.0})
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["s0"] - 300) < 70 and abs(n["s1"] - 100) < 40
    again = mixing.mix_sources(df.repartition(7), targets={"s0": 3.0, "s1": 1.0})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    counts = Counter(r["doc_id"] for r in out.collect())
    for i in range(0, 400, 2):
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-1.5), math.exp(-1.5)
        while c <= u:
            k += 1
            p *= 1.5 / k
            c += p
        assert counts[i] == k
    assert mixing.mix_sources(empty).count() == 0
    mixing.mix_sources(make(None, "", "a", ids=[None, 1, 1])).count()
    with pytest.raises(Exception, match="copies"):
        mixing.mix_sources(make("a", "b" * 400), targets={"s0": 1.0}).count()


# 8


def test_ranker_on_held_out_rows():
    rng = random.Random(12)
    good = [words(rng, 60, 900) + "." for _ in range(300)]
    bad = [" ".join(w + "###" for w in words(rng, 60, 900).split()) if i % 2 else words(rng, 60, 900).upper() + "!!" for i in range(60)]
    import pandas as pd

    x, grams = quality.features_of(good + bad)
    frame = pd.DataFrame({"features": list(x), "grams": [g.tobytes() for g in grams], "quality": [1] * 300 + [0] * 60})
    ranker = quality.fit(frame.iloc[::2])
    score = ranker.score(x[1::2], grams[1::2])
    assert ((score >= 0.3) == (frame["quality"].iloc[1::2] == 1)).mean() > 0.97
    assert quality.fit(frame[frame["quality"] == 1]) is None and len(quality.text_features("")) == len(quality.NAMES)


def test_a_topic_decides_where_shapes_are_equal():
    rng = random.Random(14)
    text = lambda topic: " ".join(rng.choice(topic) + rng.choice("abcdefgh") for _ in range(60))
    sides = [["rab", "tol", "mek", "sud"], ["bar", "lot", "kem", "dus"]]
    texts = [text(sides[i % 2]) for i in range(400)]
    import pandas as pd

    x, grams = quality.features_of(texts)
    frame = pd.DataFrame({"features": list(x), "grams": [g.tobytes() for g in grams], "quality": [i % 2 for i in range(400)]})
    score = quality.fit(frame.iloc[:200]).score(x[200:], grams[200:])
    assert ((score >= 0.3) == (np.arange(200, 400) % 2 == 1)).mean() > 0.97
    assert (quality.gram_features([b"", b"a", b"ab cd"] * 3)[3:6] == quality.gram_features([b"", b"a", b"ab cd"])).all()


def test_pair_gradient_is_that_of_differences():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4)).astype(np.float32)
    better, worse = rng.integers(0, 30, 200), rng.integers(0, 30, 200)
    w, diff = np.zeros(4), x[better] - x[worse]
    for _ in range(20000):
        w += 0.5 * (diff.T @ (1 / (1 + np.exp(diff @ w))) / len(diff) - quality.RIDGE * w)
    assert np.allclose(quality.fit_pairs(x, better, worse, 3000), w, atol=1e-3)


def test_scores_of_odd_rows(make, empty, spark):
    df = make(None, "", "a" * 5000, "\n\n").withColumn("score", F.lit("clash"))
    out = quality.score_documents(df, None)
    assert [r["score"] for r in out.collect()] == [0.5] * 4 and quality.score_documents(empty, None).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id bigint, quality int")
    assert len(quality.training_rows(make("a", "b", "c"), labels)) == (zlib.crc32(b"1") % 5 != 0)


# 9


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy now please</div><aside>side</aside>
<article><header><h1>The  head</h1></header><p>First &amp; <b>bold</b><br>text.<p>Second&nbsp;one.<div class="share">share me</div><form><input><p>mail</p></form><p>Third.</p></article>
<section id="comments"><p>reader says</p></section><footer>&copy; me</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "The head\nFirst & bold text.\nSecond one.\nThird."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("<article><p>a &lt; b<p>unclosed &am") == "a < b\nunclosed &am"


def test_pages_without_an_article():
    body = "".join(f"<p>{'long text of the story ' * 5}{i}.</p>" for i in range(4))
    page = f"<body><div><a href=1>One</a></div><div><a href=2>Two</a></div><p>x</p><div>{body}</div><div><a href=3>Three</a></div></body>"
    text = html_text.main_text(page)
    assert text.count("story") == 20 and "One" not in text and "Three" not in text


def test_surges_and_dives_decide():
    page = "<article><h1>T</h1><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li><li><a>q</a></li></ul><p>Body</p><p><a>link</a></p><p>End</p></article>"
    assert html_text.main_text(page) == "T\nBody\nlink\nEnd"
    assert html_text.between_surges([0, 5, 0, 0, 0, 90, 3, 0, 7, 0]) == [False] * 5 + [True] * 4 + [False]
    assert html_text.between_surges([]) == [] and html_text.between_surges([4]) == [True]


def test_only_whole_marks_drop_text():
    for page, text in (
        ('<article><p>a</p><p class="social-history">b</p></article>', "a\nb"),
        ('<p data-x="hidden">kept</p>', "kept"),
        ("<p title='The hidden valley' style='overflow:hidden'>kept</p>", "kept"),
        ('<p class="notice-of-war">x y</p>', "x y"),
        ("<nav><a href=x>m</a><article><p>text here</p></article>", "text here"),
        ("<p>Short.</p>", "Short."),
        ('<div class="layout sidebar-right"><article><p>Art</p></article></div><div class="sidebar-right">no</div>', "Art"),
        ("<body><div><nav>left open <a>l</a></div><p>Real text.</p>", "Real text."),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
    ):
        assert html_text.main_text(page) == text, page


def plain_article(page):
    """Of pages with one article and no links in it: cut out, split at block tags, stripped of the others."""
    import html
    import re

    body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page or "", re.S)
    blocks = "|".join(sorted(html_text.BLOCKS, key=len, reverse=True))
    parts = re.split(rf"</?(?:{blocks})(?:\s[^>]*)?>", re.sub(r"<br\s*/?>", " ", body[1]) if body else "")
    return "\n".join(x for p in parts if (x := re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", p))).strip()))


def test_all_pages_against_a_plain_reading(spark):
    from tests.conftest import SF

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    assert got == want and all(want.values())


def test_very_long_and_unclosed_pages():
    inner = "".join(f"<p>Paragraph {i} of <i>many <b>more." for i in range(20_000))
    for page in (f"<nav><a>x</a><div>{inner}", f"<article>{inner}", "<div>" * 5000 + inner):
        assert html_text.main_text(page).count("\n") == 19_999


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", None, "old")], "page_id int, url string, html string, text string")
    assert [r["text"] == "" for r in html_text.extract_pages(df).collect()] == [False, True] and html_text.extract_pages(df.limit(0)).count() == 0


# 10


def plain_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_round_trips():
    assert ogg.ogg_crc(b"OggS and more") == plain_crc(b"OggS and more")
    rng = random.Random(13)
    for n in (0, 1, 191, 192, 193, 1920, 1921, 48_960, 100_000, 500_001):
        size, payload = ogg.padded("é" * (n // 2) + "x" * (n % 2))
        assert size == n // 2 * 2 + n % 2 and len(payload) % 192 == 0 and payload
        media = ogg.mux(payload)
        assert ogg.demux(media)[0] == payload and ogg.mux(payload) == media
        spot = rng.randrange(len(media))
        with pytest.raises(ogg.OggError):
            ogg.demux(media[:spot] + bytes([media[spot] ^ 1]) + media[spot + 1 :])
    pages = list(ogg.read_pages(media))
    at = len(media) // 2
    with pytest.raises(ogg.OggError):
        ogg.demux(media[:at])
    assert {p[2] for p in pages} == {pages[0][2], pages[0][2] + 1}


def test_ogg_rows(make, empty):
    rows = ogg.ogg_column(make(None, "", "abc", ids=[None, 1, 1]), keep_media=True).collect()
    assert [r["n_bytes"] for r in rows] == [0, 0, 3] and rows[0]["media_sha256"] == rows[1]["media_sha256"]
    assert all(ogg.demux(bytes(r["media"]))[0].startswith(b"abc" if r["n_bytes"] else b" ") for r in rows) and ogg.ogg_column(empty).count() == 0


# shared


def test_tokens_and_lookup():
    texts = [b"One  two\nthree", b"", b" two ", b"\x0bONE"]
    t = textnum.Tokens(texts)
    assert t.doc.tolist() == [0, 0, 0, 2, 3] and t.hashes[0] == t.hashes[4] and t.hashes[1] == t.hashes[3] and len(set(t.hashes.tolist())) == 3
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    table = textnum.Lookup(keys, np.arange(len(keys)))
    assert (table.get(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    with pytest.raises(KeyError):
        table.get(np.array([5], dtype=np.uint64))
