"""Relative Lempel-Ziv parsing, importance resampling and impact search against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from proofloom.llm import impact_index, lempel_ziv, resampling

SCHEMA = "doc_id bigint, text string, kept string, score string, rank string, t string, n_words string, key string"


@pytest.fixture
def make(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], SCHEMA)

    return build


def prose(rng, n, pool=60):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# 11


def plain_removed(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                run = tuple(w[k : k + window])
                first[run] = min(first.get(run, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def shared_rows(rng, window):
    passages = [prose(rng, rng.randint(window - 2, 4 * window)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30), 4000) for _ in range(3)] + rng.choices(passages, k=rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i, rng.choice(["\n", " ", "\t\x0b "]).join(parts)))
    rows += [(7, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[5][1]), (61, None), (62, ""), (63, "a " * 700), (64, "a " * 900), (65, " \n "), (-3, rows[20][1]), (66, "É é " + passages[0].upper())]
    rows.append((67, " ".join(prose(rng, 40, 5000) for _ in range(150)) + " " + passages[1]))
    return rows


@pytest.mark.parametrize("window,gram,block", [(13, 4, 1 << 18), (13, 4, 20), (6, 2, 300), (5, 5, 1)])
def test_copied_words_against_every_window(make, window, gram, block):
    rows = shared_rows(random.Random(window), window)
    out = lempel_ziv.without_copied_words(make(rows), window=window, gram=gram, block=block)
    assert out.columns == ["doc_id", "text", "score", "rank", "t", "key", "n_words", "n_removed", "spans", "kept"]
    got = out.collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], key=repr) == plain_removed(rows, window)
    assert all(sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_removed"] and r["score"] == "b" for r in got)


def test_copied_words_of_an_empty_table(make):
    assert lempel_ziv.without_copied_words(make([])).count() == 0


def test_factors_are_greedy_and_go_on_before_their_end():
    seq = np.array([1, 2, 3, 4, 90, 3, 4, 5, 91, 1, 2, 3, 4, 5, 92])
    owner = np.array([0] * 5 + [1] * 4 + [2] * 6)
    assert lempel_ziv.longest_factors(seq, owner, 6, 3).tolist() == [0] * 9 + [4, 3, 3, 0, 0, 0]
    spans = lempel_ziv.factor_spans([b"a b c d", b"c d e", b"a b c d e"], np.array([0, 1, 2]), 3)
    assert spans == [[], [], [(0, 5)]]


# 12


def plain_features(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


@pytest.mark.parametrize("n,size", [(1, 1 << 16), (2, 40), (3, 17), (1, 5)])
def test_draws_against_a_plain_version(spark, make, n, size):
    rng = random.Random(n)
    rows = [(i, prose(rng, rng.randint(0, 60), 80).replace(" ", rng.choice([" ", "-", "\n", ", "]))) for i in range(90)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (91, None), (92, ""), (93, "?!"), (94, "Ünïcode 日本語 ÀB " * 30), (95, "x" * 300 + " y" * 40), (96, " ".join(["Same"] * 5000))]
    target = [(0, prose(rng, 200, 20)), (1, None)]
    out = resampling.draws(make(rows), make(target), n=n, buckets=50, least_words=10, percent=30, size=size)
    assert out.columns == ["doc_id", "t", "n_features", "n_words", "weight", "score", "rank"]
    bucket = lambda f: zlib.crc32(f.encode()) % 50
    features = [(i, *plain_features(t, n)) for i, t in rows]
    s, t = (Counter(bucket(f) for x in sets for f in x) for sets in ([f for _, _, f in features], [plain_features(x, n)[1] for _, x in target]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)}
    want = []
    for i, words, f in features:
        w = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), words, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    got = out.collect()
    assert sorted([tuple(r[c] for c in ("doc_id", "n_features", "n_words", "weight", "score")) for r in got], key=repr) == sorted(want, key=repr)
    fit = sorted((w for w in want if w[2] >= 10), key=lambda w: (-w[4], w[0] is None, w[0]))
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(fit) * 30 // 100 + 1))
    assert [(r["doc_id"], r["score"]) for r in drawn] == [(w[0], w[4]) for w in fit[: len(drawn)]]


def test_chunks_own_each_word_once():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab é-1 日") for _ in range(rng.randint(0, 60))).encode()
        starts, ends = resampling.word_edges(np.frombuffer(text + b" ", dtype=np.uint8))
        words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
        size, carry = rng.randint(1, 20), rng.randint(0, 3)
        seen = []
        for lo, hi, own in resampling.cut_text(text, size, carry):
            a, b = resampling.word_edges(np.frombuffer(text[lo:hi] + b" ", dtype=np.uint8))
            part = [text[lo:hi][x:y] for x, y in zip(a, b, strict=True)]
            assert own > 0 and part == words[len(seen) : len(seen) + own + carry]
            seen += part[:own]
        assert seen == words


def test_resampled_rows_stay_as_they_are(make):
    rng = random.Random(8)
    rows = [(i, prose(rng, 30)) for i in range(40)]
    out = resampling.resampled(make(rows), make(rows[:3]), percent=25)
    assert out.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert out.count() == 10 and {(r["doc_id"], r["text"]) for r in out.collect()} <= set(rows)
    assert resampling.draws(make([]), make([])).count() == 0


# 13


def plain_search(rows, queries, k):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(term(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(x for _, c in docs for x in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c in docs:
            s = 0
            for x in term(text):
                if c[x]:
                    m = 25 + (75 * c.total() * n_docs) // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,block,k", [(1 << 22, 1 << 22, 10), (300, 60, 3), (1, 1, 2)])
def test_search_against_all_documents(spark, make, shard, block, k):
    rng = random.Random(k)
    rows = [(i, prose(rng, rng.randint(0, 50), 40).replace(" ", rng.choice([" ", ";", "\n"]))) for i in range(70)]
    rows += [(100 + i, rows[9][1]) for i in range(15)] + [(3, rows[9][1]), (None, "W1 w2 W3 w1"), (200, None), (201, ""), (202, "É日本 W1 [w2]"), (203, prose(rng, 4000, 40))]
    queries = [(i, prose(rng, rng.randint(1, 12), 45)) for i in range(12)] + [(5, rows[9][1]), (20, None), (21, "?"), (22, "nowhere"), (None, "w1 w1 É日本")]
    index = impact_index.build(make(rows), shard=shard)
    out = impact_index.search(index, make(queries), "doc_id", "text", k, block)
    assert sorted([tuple(r) for r in out.select("item", "rank", "key", "score").collect()], key=repr) == plain_search(rows, queries, k)
    assert index.shards.count() > (10 if shard < 1000 else 0)


def test_search_of_empty_tables(make):
    index = impact_index.build(make([]))
    assert impact_index.search(index, make([(1, "a")]), "doc_id").count() == 0
    assert impact_index.search(impact_index.build(make([(1, "a")])), make([]), "doc_id").count() == 0


def test_ties_at_the_last_place_are_all_kept():
    scores = np.array([5, 7, 5, 0, 5, 9, 5])
    assert impact_index.highest(scores, 3).tolist() == [0, 1, 2, 4, 5, 6] and impact_index.highest(np.zeros(9, dtype=np.int64), 3).tolist() == []
