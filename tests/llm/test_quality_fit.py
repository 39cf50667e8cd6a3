"""The quality model learns from every labelled row, in blocks."""

import zlib

import numpy as np
import pandas as pd

from proofloom.llm import quality


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 40)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 40)) + ("!!! $$$ buy" * 3 if i % 10 == 0 else ".") for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(600)], "doc_id bigint, quality int")
    given = quality.training_rows(docs, labels)
    assert len(given) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(600)) > 40
    ranker = quality.fit_blocks(given, 40)
    got = pd.DataFrame(quality.score_documents(docs, ranker).orderBy("doc_id").collect(), columns=["doc_id", "text", "score", "predicted"])
    assert (got["predicted"] == (got["doc_id"] % 10 > 0)).mean() > 0.97
    again = quality.fit_blocks(quality.training_rows(docs.repartition(7), labels), 40)
    assert np.array_equal(again.weights, ranker.weights) and again.cut == ranker.cut  # however the rows lie
    assert quality.fit(quality.training_rows(docs, labels.filter("quality = 1"))) is None


def test_each_row_of_a_block_stands_in_a_pair(monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_pairs", lambda x, better, worse: seen.append((set(better), set(worse))))
    y = np.arange(40_000) % 40 > 0
    quality.block_weights(np.zeros((len(y), 1)), y.astype(int))
    assert seen == [(set(np.flatnonzero(y)), set(np.flatnonzero(~y)))]
