"""Very long texts, clashing names, null and repeated ids, ties, empty tables: each with the result that the docstring names."""

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from proofloom.llm import ctw, decontam, html_text, lines, mixing, ogg, quality, simhash, suffix
from tests.conftest import SF
from tests.llm.test_ops import plain_lines

#: Names that operators give to columns of their own, here those of the input.
CLASHING = ("doc", "h", "h1", "h2", "k", "n", "u", "row", "grp", "rate", "copy", "size", "words", "around", "near", "hot", "item", "shard", "slot", "n_lines", "n_dropped", "mix_copy", "mix_order", "n_items", "first_item", "contaminated", "score", "fingerprint", "component_id", "n_tokens", "key", "lines", "value")


@pytest.fixture
def clashing(docs):
    """docs(...) with columns of all these names, each holding its own name."""
    return lambda *texts: docs(*texts).withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="module")
def long():
    """60,000 words in 6,000 lines."""
    rng = random.Random(17)
    return "\n".join(" ".join(f"w{rng.randrange(30_000)}" for _ in range(10)) for _ in range(6_000))


def unsettled(rows, own):
    """Rows of clashing columns that an operator that does not own them has changed."""
    return [(c, r[c]) for r in rows for c in CLASHING if c not in own and c in r.asDict() and r[c] != c]


# very long texts


def test_a_long_text_is_scored_whole(docs, long):
    got = {r["doc_id"]: r for r in ctw.score_texts(docs(long, "w1 w2", long), F.col("doc_id") < 2).collect()}
    train = Counter([*long.lower().split(), None, "w1", "w2", None])
    total, v = sum(train.values()), len(train)
    want = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (v + 1))) for w in [*long.split(), None])
    for i in (0, 2):
        assert got[i]["n_tokens"] == got[i]["n_known"] == 60_001 and abs(got[i]["base_score"] - want) < 1e-6 * abs(want)
        assert math.isfinite(got[i]["score"]) and got[i]["score"] < 0
    assert got[0]["score"] == got[2]["score"] and got[1]["train_tokens"] == total


def test_a_long_text_has_the_bits_of_all_its_shingles(docs, long):
    words = long.lower().split()
    votes = [0] * 64
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    want = sum(1 << b for b in range(64) if 2 * votes[b] > len(words) - 2)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(long, "a b c d", long)).collect()}
    assert got[0]["fp"] == got[2]["fp"] and got[0]["fp"] % 2**64 == want and got[2]["component_id"] == 0 and got[1]["component_id"] == 1


def test_a_passage_deep_in_a_long_text_is_found(docs, spark, long):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(5, item), (6, "nothing of this kind is here at all today or ever again")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["contaminated"], r["first_item"]) for r in decontam.flag_contaminated(docs(long + " " + item + " " + long, long), bench).collect()}
    assert got == {0: (True, 5), 1: (False, None)}


def test_lines_of_a_long_text(docs, long):
    texts = [long, "w1\n" + long.split("\n")[4_000], long.split("\n")[4_000].upper() + "\n\nmine"]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(*texts), min_docs=3).collect()}
    assert [got[i] for i in range(3)] == plain_lines(texts, 3) and len(got[0]) < len(long)


def test_copies_of_a_long_text_are_whole(docs, long):
    df = docs(long, "x").withColumn("source", F.lit("s"))
    out = mixing.mix_sources(df, seed="odd-5").collect()
    assert {r["doc_id"] for r in out} <= {0, 1} and all(r["text"] == (long, "x")[r["doc_id"]] for r in out)
    assert all(sum(r["doc_id"] == i for r in out) == next((r["mix_copies"] for r in out if r["doc_id"] == i), 0) for i in (0, 1))


def test_media_of_a_long_text(docs, long):
    padded = long.encode() + b" " * (-len(long.encode()) % 192)
    r = ogg.ogg_column(docs(long)).first()
    assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["payload_bytes"] == len(padded) and r["n_bytes"] == len(long.encode())


# clashing names


def test_columns_of_the_input_keep_their_values(clashing, spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "x")], "item_id bigint, text string, h string")
    texts = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "b\nb", None, "")
    df = clashing(*texts)
    flagged = decontam.flag_contaminated(df, bench).collect()
    assert not unsettled(flagged, ("contaminated", "n_items", "first_item")) and [r["doc_id"] for r in flagged if r["contaminated"]] == [0]
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and not unsettled(kept.collect(), ()) and kept.count() == 3
    out = lines.dedup_lines(df, min_docs=2).collect()
    assert not unsettled(out, ("n_lines", "n_dropped")) and len(out) == 4
    mixed = mixing.mix_sources(df.withColumn("source", F.lit("s")))
    assert not unsettled(mixed.collect(), ("mix_copy", "mix_copies", "mix_order")) and set(df.columns) <= set(mixed.columns)
    near = simhash.drop_similar_documents(df)
    assert near.columns == df.columns and not unsettled(near.collect(), ())
    scored = quality.score_documents(df, None).collect()
    assert not unsettled(scored, ("score", "predicted", "held_out")) and len(scored) == 4


def test_reports_of_rows_with_clashing_names(clashing, docs):
    plain, odd = docs("a b c d", "a b c d", None, ""), clashing("a b c d", "a b c d", None, "")
    both = lambda f: [sorted(map(str, (r.asDict() for r in f(x).select(*f(plain).columns).collect()))) for x in (plain, odd)]
    for f in (simhash.near_duplicates, ogg.ogg_column, lambda x: ctw.score_texts(x, F.col("doc_id") < 2)):
        a, b = both(f)
        assert a == b


# ids


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two three"), (None, "one two"), (1, "one two three"), (1, "four"), (1, "four")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    scored = ctw.score_texts(df, F.coalesce(F.col("doc_id"), F.lit(0)) >= 0).collect()
    assert sorted(r["n_tokens"] for r in scored) == [2, 2, 3, 4, 4] and Counter(r["doc_id"] for r in scored) == {None: 2, 1: 3}
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    hit = decontam.flag_contaminated(df.unionByName(spark.createDataFrame([(None, item)], df.schema)), bench).collect()
    assert len(hit) == 6 and all(r["contaminated"] == (r["doc_id"] is None) for r in hit)
    cut = suffix.without_repeats(spark.createDataFrame([(None, "ab" * 300), (None, "x" + "ab" * 300), (1, "short"), (1, "short")], "doc_id bigint, text string")).collect()
    assert Counter(r["doc_id"] for r in cut) == {None: 2, 1: 2} and all(r["n_removed"] == 0 for r in cut if r["doc_id"] == 1) and all(r["n_removed"] >= 600 for r in cut if r["doc_id"] is None)


def test_pages_without_an_id_or_html(spark):
    df = spark.createDataFrame([(None, "u", "<article><p>Text of it.</p></article>"), (1, None, None), (1, "u", ""), (1, "u", "")], "page_id bigint, url string, html string")
    got = html_text.extract_pages(df).collect()
    assert sorted(((r["page_id"] or 0), r["text"]) for r in got) == [(0, "Text of it."), (1, ""), (1, ""), (1, "")]


def test_rows_of_one_id_share_their_draws(docs, spark):
    df = spark.createDataFrame([(7, f"t{i}", "s") for i in range(6)], "doc_id bigint, text string, source string")
    out = mixing.mix_sources(df, targets={"s": 1.0}, seed="odd-1").collect()
    assert len({r["mix_copies"] for r in out}) <= 1 and len(set(Counter(r["text"] for r in out).values())) <= 1
    assert Counter(r["mix_order"] for r in out) == {r["mix_order"]: 6 for r in out}  # ties, all kept


# the pipeline


def _inputs(spark, folder, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    _inputs(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "hilbert", "shard", "slot"]


def test_pipeline_keeps_columns_of_clashing_names(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, k string, grp string, score string, mix_copy string"
    _inputs(spark, tmp_path, [(i, f"words number {i} and some more of the kind {i * 7} here", "en", "s", 40, "row", "k", "grp", "score", "mix_copy") for i in range(12)], schema)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all((r["row"], r["k"], r["grp"], r["score"], r["mix_copy"]) == ("row", "k", "grp", "score", "mix_copy") for r in out)
    assert sorted(r["slot"] for r in out if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in out)))
