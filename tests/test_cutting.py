"""Spans cut from long texts: as substrings, but without walking the text for each of them."""

import time

from pyspark.sql import functions as F

from proofloom.functions.offsets import cutting
from proofloom.operators.norm import rule_array, rule_hits
from proofloom.operators.parse import paragraph_array, spread
from proofloom.operators.resolve import annotate, annotate_array, critic_array, review
from proofloom.rules import LATIN
from proofloom.schema import issue, make_issues


def test_cuts_are_substrings(docs):
    texts = ("", "abc", "añ文😀\n" * 300, "x" * 256, "y" * 257, "文" * 1000)
    spans = [(0, 0), (0, 1), (255, 256), (255, 257), (256, 512), (3, 900), (250, 2000), (1000, 1001), (5, 2), (0, 5000)]
    given = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in spans])
    row = docs(*texts).select("text", cutting(F.col("text"), lambda n, cut: F.struct(n.alias("n"), F.transform(given, lambda s: cut(s["a"], s["b"])).alias("cuts"))).alias("x"))
    for r in row.collect():
        assert r["x"]["n"] == len(r["text"])
        assert r["x"]["cuts"] == [r["text"][a:b] for a, b in spans]


def test_many_issues_of_a_long_text_do_not_walk_it_each(docs):
    n = 30_000
    words = "wört ff. " * n  # two bytes in a letter: no place can be reached but by walking
    found = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: issue("r", i * 9, i * 9 + 4, "language", original="wört", confidence=0.9))
    began = time.monotonic()
    rows = docs(words).withColumn("found", found).withColumn("placed", annotate_array(F.col("found"), F.col("text"), paragraph_array(F.col("text"))))
    assert rows.select(F.size(F.filter("placed", lambda x: x["original"] == "wört"))).first()[0] == n
    assert docs(words).withColumn("found", found).select(F.size(critic_array(F.col("found"), F.col("text")))).first()[0] == n
    assert time.monotonic() - began < 25


def test_rules_are_searched_once(docs):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    text = docs("a  b !!", "of x of y of z")
    once = plan(text.select(rule_array(F.col("text"), LATIN.language).alias("x"))).count("RLIKE")
    hits = make_issues(rule_hits(text, LATIN.language), "norm")
    assert once and plan(rule_hits(text, LATIN.language)).count("RLIKE") == once
    assert plan(review(hits, text)).count("RLIKE") == once
    own = plan(text.select(paragraph_array(F.col("text")).alias("x"))).count("RLIKE")
    assert plan(annotate(hits, text, paragraph_array(F.col("text")))).count("RLIKE") == once + own


def test_no_task_gets_more_than_its_part(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    assert spread(table, 1 << 16).rdd.getNumPartitions() > spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(table, 1 << 16).count() == 20_000
