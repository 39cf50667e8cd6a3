"""Rows that TF-IDF searches send between tasks: of documents and terms, not of their pairs."""

import random

import pytest

from proofloom.operators import indexes, similarity
from tests.test_indexes import plain_topk

rng = random.Random(3)
WORDS = [f"{a}{b}x" for a in "abcdefgh" for b in "ijklmnop"]
DOCS = [(i, " ".join(rng.sample(WORDS, 48))) for i in range(500)]
QUERIES = [(i, " ".join(rng.sample(WORDS, 4))) for i in range(5)]
PAIRS = 48 * len(DOCS)


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.fixture
def counted_rows(spark):
    before = shuffled(spark)
    return lambda: sum(n for stage, n in shuffled(spark).items() if stage not in before)


def tables(spark):
    return spark.createDataFrame(DOCS, "i bigint, text string"), spark.createDataFrame(QUERIES, "q bigint, text string")


def test_index_is_built_without_shuffling_pairs(spark, tmp_path, counted_rows):
    indexes.TfidfIndex.build(tables(spark)[0], "i", str(tmp_path / "index"))
    assert 0 < counted_rows() < PAIRS / 4


def test_products_are_added_up_where_documents_lie(spark, counted_rows):
    docs, queries = tables(spark)
    got = {(r["q"], r["i"], r["rank"], round(r["score"], 8)) for r in similarity.tfidf_topk(queries, docs, "q", "i").collect()}
    assert got == {(q, d, r, round(s, 8)) for q, d, r, s in plain_topk(DOCS, QUERIES, 3)}
    assert 0 < counted_rows() < PAIRS / 4


def test_topk_takes_rows_of_one_key_as_one_text_and_rare_terms_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HEAD", 8, raising=False)
    parts = [(i, " ".join(t.split()[j::2])) for i, t in DOCS[:60] for j in range(2)]
    docs = spark.createDataFrame([*parts, (None, "aix bix"), (None, None), (70, None)], "i bigint, text string")
    queries = spark.createDataFrame([*QUERIES, (None, "aix"), (9, None)], "q bigint, text string")
    got = sorted((r["q"], r["rank"], r["i"]) for r in similarity.tfidf_topk(queries, docs, "q", "i").collect())
    # 123 rows, of which those of the null key are one more document of terms; the plain scores take it as number -1
    plain = plain_topk([*DOCS[:60], (-1, "aix bix"), *[(1000 + i, "") for i in range(62)]], QUERIES, 4)
    ranked = {q: [d for _, d in sorted((r, d) for o, d, r, _ in plain if o == q) if d != -1][:3] for q, _ in QUERIES}
    assert got == [(q, r, d) for q, ds in sorted(ranked.items()) for r, d in enumerate(ds, 1)]
