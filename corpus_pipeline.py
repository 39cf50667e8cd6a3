"""Corpus pipeline over documents: quality classifier, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents;
the last adds shard and slot. Stages are written as Parquet between one another. No stage but the mixing is free of
learned weights, trees or hashes of words that SQL lacks, so the whole has no SQL; each is tested against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import decontam, mixing, quality, sharding, simhash
from proofloom.llm.common import documents, drop_staged, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the pairwise ranker rejects. It learns from the labelled documents of this input."""
    documents(spark, sf_dir)  # for its batch size
    ranker = quality.fit(quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = docs.select(F.struct("*").alias("row"), "text")  # columns named score or predicted keep their values
    return quality.score_documents(rows, ranker).filter("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return simhash.drop_similar_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that share a passage with the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as its source's target asks, in shuffled order."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", size.alias("size"))  # no column of a clashing name goes
    return mixing.mix_sources(rows, size=F.col("size")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order along the Hilbert curve of source, language and length, cut into shards: adds hilbert, shard and slot."""
    return sharding.hilbert_shards(docs, ["source", "lang", "n_chars"], "doc_id")


STAGES = [("quality classifier", keep_quality), ("near-dedup", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"stage-{number}")
            if before is not None:
                drop_staged(before)
            before = docs
    return docs
