from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofloom.functions.offsets import find_all
from proofloom.operators import parse
from proofloom.rules import LATIN, ZH


def test_sentences_tile_the_text(spark, docs):
    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text("ab.!\n\"'；。 😀", max_size=30), min_size=1, max_size=8))
    def check(texts):
        rows = parse.sentences(docs(*texts)).collect()
        for r in rows:
            assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"]
            assert r["text"].strip()
        for i, t in enumerate(texts):
            own = sorted((r["start"], r["end"]) for r in rows if r["doc_id"] == i)
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
            assert len("".join(t[a:b] for a, b in own).split()) == len(t.split()) or "".join(t.split()) == "".join("".join(t[a:b].split()) for a, b in own)

    check()


def test_find_all_offsets(docs):
    row = docs("aXbX😀Xc").select(find_all(F.col("text"), "X").alias("h")).first()["h"]
    assert [(x["start"], x["end"]) for x in row] == [(1, 2), (3, 4), (5, 6)]


def test_paragraphs_headings_references(docs):
    rows = parse.paragraphs(docs("# Title\n\nbody text.\nReferences\n[1] A. B. [M]."), LATIN).orderBy("para_idx").collect()
    assert [r["line"] for r in rows] == [1, 3, 4, 5]
    assert [r["is_heading"] for r in rows] == [True, False, True, False]
    assert [r["in_ref"] for r in rows] == [False, False, True, True]


def test_quotes_nested_open_and_straight(docs):
    text = '“a “b” c” x “open\n"pair" and "cut\n"'
    spans = docs(text).select(parse.quote_spans(parse.TEXT()).alias("q")).first()["q"]
    assert [text[s["qs"] : s["qe"]] for s in spans] == ["“a “b” c”", "“b”", "“open", '"pair"']


def test_negation_needs_nearness(docs):
    d = docs("this is not term", "not so, term", "a term")
    out = [r["n"] for r in d.select(parse.is_negated(parse.TEXT(), F.instr(parse.TEXT(), F.lit("term")) - 1).alias("n")).collect()]
    assert out == [True, False, False]


def test_references_and_citations(docs):
    d = docs("see [2] and [1], [2]\nReferences\n[1] one\n[2] two\n[2] two again", "no section [1]\n[1] a\n[2] b")
    refs = {(r["doc_id"], r["num"]): r["text"] for r in parse.references(d).collect()}
    assert refs == {(0, 1): "[1] one", (0, 2): "[2] two again", (1, 1): "[1] a", (1, 2): "[2] b"}
    cites = {(r["doc_id"], r["num"]): r["pos"] for r in parse.citations(d).collect()}
    assert cites == {(0, 2): 4, (0, 1): 12, (1, 1): 11}


def test_tokens_of_two_scripts(docs):
    assert docs("Hello 数据集 3.5% 中").select(parse.tokens(parse.TEXT()).alias("t")).first()["t"] == ["hello", "数据", "据集", "3.5%", "中"]
    assert docs("", "a", "ab c").select(parse.char_ngrams(parse.TEXT(), 3).alias("t")).collect() == [([],), (["a"],), (["abc"],)]


def test_chinese_pack(docs):
    rows = parse.sentences(docs("第一句。第二句！“引用。”尾"), ZH).collect()
    assert [r["text"] for r in rows] == ["第一句。", "第二句！", "“引用。”", "尾"]


def test_null_and_empty_texts(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert parse.paragraphs(d).count() == 0 and parse.sentences(d).count() == 0
    assert [r["char_count"] for r in parse.doc_meta(d).collect()] == [0, 0]


def test_html_strip(docs):
    assert docs("<p>a&nbsp;b<script>x<y</script></p>").select(parse.html_strip(F.col("text")).alias("t")).first()["t"].strip() == "a b"
