"""The fingerprint store, and audits against a corpus that is a table."""

import random

from pyspark.sql import functions as F

from proofloom.operators import alike, corpus
from proofloom.plans import audit


def prose(rng, n, pool):
    return " ".join(f"word{rng.randrange(pool)}" for _ in range(n))


def changed(rng, text, n, pool):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"word{rng.randrange(pool)}"
    return " ".join(w)


def plain_closest(texts, held):
    prints = [(s, alike.fingerprint_of(t)) for s, t in held]
    out = {}
    for t in set(texts):
        f, best = alike.fingerprint_of(t), None
        for source, c in prints:
            sim, mins, gram, mean = alike.scores_of(f, c)
            if sim >= 0.5 and (mins >= 0.45 or gram >= 0.45) and mean >= 0.72:
                best = min(best or (0.0, ""), (-round(mean, 9), source))
        if best:
            out[t] = (best[1], -best[0])
    return out


def test_closest_with_shared_boilerplate(spark, monkeypatch):
    """Most texts share a third of their words, so that most elements are frequent; few are kept as such."""
    monkeypatch.setattr(corpus, "FREQUENT", 40)
    rng = random.Random(3)
    boiler = prose(rng, 25, 50)
    held = [(f"s{i:03d}", f"{boiler} {prose(rng, 45, 300)}") for i in range(60)]
    held += [(f"t{i}", held[i][1]) for i in range(5)] + [("u", ""), ("v", "one"), ("w", "?? !!")]
    texts = [changed(rng, rng.choice(held[:60])[1], rng.choice([0, 1, 4, 8, 12, 20]), 300) for _ in range(90)] + ["", "one", "?? !!", prose(rng, 50, 300)]
    want = plain_closest(texts, held)
    store = corpus.FingerprintStore.of(spark.createDataFrame(held, "source string, text string"))
    asked = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = corpus.closest(asked, store).join(corpus.named(asked.distinct()), ["t", "u"]).collect()
    assert {r["text"]: (r["source"], round(r["score"], 9)) for r in got} == want and 30 < len(want) < len(set(texts))
    assert corpus.closest(asked.limit(0), store).count() == 0


def test_store_grows_by_what_it_lacks(spark):
    rng = random.Random(4)
    first = [(f"a{i}", prose(rng, 40, 200)) for i in range(12)]
    later = [("b0", first[3][1]), ("b1", prose(rng, 40, 200)), ("b2", None), (None, "lost")]
    table = lambda rows: spark.createDataFrame(rows, "source string, text string")
    store = corpus.FingerprintStore.open(spark, "held")
    assert store.add(table(first)) == 12 and store.add(table(first)) == 0
    assert corpus.FingerprintStore.open(spark, "held").add(table(later)) == 1
    store = corpus.FingerprintStore.open(spark, "held")
    assert store.prints.count() == 13 and store.keys.count() == 13 * alike.SLOTS
    assert store.prints.filter(F.col("text") == first[3][1]).first()["source"] == "a3"
    whole = corpus.FingerprintStore.of(table([*first, *later]))
    asked = table([(None, changed(rng, t, 3, 200)) for _, t in [*first, later[1]]])
    rows = lambda s: {tuple(r) for r in corpus.closest(asked, s).collect()}
    assert rows(store) == rows(whole) and len(rows(store)) > 8
    joined = store.prints.select("t", "u").join(store.prints.groupBy("t").count(), "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in joined  # bucketed by text
    counted = store.keys.groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in counted  # bucketed by element


def test_audit_against_a_table(spark, docs):
    rng = random.Random(5)
    old = [(f"old{i}", prose(rng, 30, 400)) for i in range(4)]
    texts = [f"Title 1\n{old[1][1]}\n{prose(rng, 30, 400)} 5", f"{changed(rng, old[2][1], 2, 400)} 7", "calm 3", None]
    d = docs(*texts, texts[0])
    table = spark.createDataFrame(old, "source string, text string")
    found = lambda c: sorted((r["doc_id"], r["start"], r["source"], r["severity"], r["confidence"]) for r in audit.audit(d, engines=("academic",), checks={"academic": ("duplicates",)}, corpus=c, keep=False).issues.collect() if r["rule_id"] == "dup-cross")
    assert found(table) == found(old) and [x[:3] for x in found(old)] == [(0, 8, "old1"), (1, 0, "old2"), (4, 8, "old1")]
    twins = docs("x", "y").withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(f"{old[0][1]} 1"))
    rows = audit.audit(twins, engines=("academic",), corpus=table, keep=False)
    assert rows.issues.filter("rule_id = 'dup-cross'").count() == 2 and rows.scores.count() == 2
