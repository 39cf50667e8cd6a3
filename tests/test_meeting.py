"""Texts that share no shingle with a corpus are not fingerprinted."""

from proofloom.operators.corpus import FingerprintStore, closest, meeting


def test_what_shares_no_shingle_is_left_out(spark):
    corpus = spark.createDataFrame([("a", "the quick brown fox jumps over the lazy dog"), ("b", "一二三四五六七八")], "source string, text string")
    given = ["quick brown fox and others", "quick fox brown", "no word of it", "三四五六", "!!! ???", "", "fox"]
    texts = spark.createDataFrame([(t,) for t in given], "text string")
    assert {r[0] for r in meeting(texts, corpus).collect()} == {"quick brown fox and others", "三四五六"}
    blank = spark.createDataFrame([("c", "... ---")], "source string, text string")
    assert {r[0] for r in meeting(texts, blank).collect()} == {"!!! ???", ""}


def test_hits_stay(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank on a cold day"
    corpus = spark.createDataFrame([("a", text), ("b", "... !!! ---")], "source string, text string")
    texts = spark.createDataFrame([(text,), (text + " again",), ("something else that nobody has ever written in this place",)], "text string")
    got = closest(texts, FingerprintStore.of(corpus)).select("source", "score").collect()
    assert [r["source"] for r in got] == ["a", "a"] and max(r["score"] for r in got) == 1.0
