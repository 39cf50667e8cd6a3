import corpus_pipeline
from proofloom.llm import simhash
from tests.conftest import SF


def test_stages_filter_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        docs = corpus_pipeline.staged(after, "test")
        assert 0 < docs.count() <= 2 * n
        if name == "near-dedup":
            assert simhash.similar_documents(docs).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.columns == [*columns, "hilbert", "shard", "slot"] and out.count() == docs.count()


def test_run_on_odd_rows(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b c", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 6
