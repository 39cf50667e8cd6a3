"""TF-IDF search and nearest numbers by their indexes against all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofloom.operators import indexes
from proofloom.operators.alike import tokens_of


def plain_topk(docs, queries, k):
    n = len(docs)
    counts = {d: Counter(tokens_of(t or "")) for d, t in docs}
    df = Counter(t for c in counts.values() for t in c)
    weigh = lambda c: {t: (1 + math.log(f)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, f in c.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    held = {d: weigh(c) for d, c in counts.items()}
    out = set()
    for q, t in queries:
        w = weigh(Counter(tokens_of(t)))
        scores = [(-round(s, 9), d) for d, v in held.items() if v and w and (s := sum(w[x] * v[x] for x in w.keys() & v.keys()) / (norm(w) * norm(v))) > 0]
        out |= {(q, d, r, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("block,k", [(512, 3), (4, 2), (1, 5)])
def test_search_equals_all_scores(spark, tmp_path, monkeypatch, block, k):
    monkeypatch.setattr(indexes, "BLOCK", block)
    rng = random.Random(block)
    word = lambda: f"w{min(rng.randrange(60), rng.randrange(60))}x"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(150)] + [(900, None), (901, ""), (902, "w1x " * 300)]
    docs += [(1000 + i, docs[7][1]) for i in range(9)]  # ties
    table = lambda rows: spark.createDataFrame(rows, "i bigint, text string")
    built = indexes.TfidfIndex.build(table(docs), "i", str(tmp_path / "index"))
    index = indexes.TfidfIndex(spark, built.path)
    assert index.blocks.filter(F.size("postings") > block).count() == 0
    for some in range(2):  # two searches on one build
        queries = [(i, " ".join(word() for _ in range(rng.randint(1, 8)))) for i in range(20 * some, 20 * some + 20)] + [(77, "nowhere"), (78, docs[7][1])]
        got = {(r["q"], r["i"], r["rank"], round(r["score"], 8)) for r in index.search(table(queries).withColumnRenamed("i", "q"), "q", "i", k).collect()}
        assert got == {(q, d, r, round(s, 8)) for q, d, r, s in plain_topk(docs, queries, k)}
    assert index.search(table([]).withColumnRenamed("i", "q"), "q", "i").count() == 0


def test_index_of_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "i bigint, text string")
    index = indexes.TfidfIndex.build(empty, "i", str(tmp_path / "none"))
    assert index.search(spark.createDataFrame([(1, "a")], "q int, text string"), "q", "i").count() == 0


@pytest.mark.parametrize("width", [None, 5, 16])
def test_nearest_equals_all_pairs(spark, width):
    rng = random.Random(width or 1)
    numbers = [rng.getrandbits(64) - (1 << 63) for _ in range(30)]
    for _ in range(40):
        x = rng.choice(numbers)
        for b in rng.sample(range(63), rng.randint(0, 9)):
            x ^= 1 << b
        numbers.append(x)
    numbers += [numbers[0]] * 3 + [0, 0]
    rows = list(enumerate(numbers))
    want = {(i, *min(((x ^ y) & (2**64 - 1)).bit_count() * 1000 + j for j, y in rows if j != i).__divmod__(1000)) for i, x in rows}
    got = {(r["k"], r["bits"], r["other"]) for r in indexes.nearest(spark.createDataFrame(rows, "k int, simhash bigint"), "k", width).collect()}
    assert got == want
    alone = spark.createDataFrame([(1, 5)], "k int, simhash bigint")
    assert indexes.nearest(alone, "k").count() == 0 == indexes.nearest(alone.limit(0), "k").count()
