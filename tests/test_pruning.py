"""What can be like nothing is not fingerprinted; places of fuzzy matches are told apart in one sort."""

import random

from proofloom.operators import alike, terms
from pyspark.sql import functions as F


def test_texts_like_no_other_are_not_fingerprinted(monkeypatch):
    draw = random.Random(7)
    parts = ("ra", "tio", "en", "the", "ing", "ba", "ko", "de", "lu", "so", "mi", "pu")
    words = [a + b + c for a in parts for b in parts for c in parts]
    texts = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(60)]
    texts += [texts[3] + " end", "ab", "", "--"]
    made = []
    own = alike.signature_of
    monkeypatch.setattr(alike, "signature_of", lambda t, *rest: made.append(t) or own(t, *rest))
    found = alike.alike_classes(texts)
    assert [x[:3] for x in found] == [(3, 3, 60)]
    assert made == [texts[3], texts[60]]


def test_no_pair_above_the_share_is_left_out():
    draw = random.Random(11)
    base = ["".join(draw.choice("abcd 一") for _ in range(n)) for n in (0, 1, 2, 3, 5, 30, 60)]
    texts = [b[:k] + "x" + b[k:] for b in base for k in range(0, len(b) + 1, 7)] + base
    grams = [alike.grams_of(t) for t in texts]
    for need in (0.3, 0.5, 0.75):
        like = {i for i, a in enumerate(grams) for j, b in enumerate(grams) if i != j and a and len(a & b) >= need * len(a | b)}
        assert like <= set(alike.meeting(texts, need))


def test_votes_come_once(docs):
    rows = docs("xx theraXion therXtion theration " * 40)
    votes = rows.select(F.explode(terms.fuzzy_votes(F.col("text"))).alias("v")).select("v.*").collect()
    assert len(votes) == len(set(votes)) > 80
