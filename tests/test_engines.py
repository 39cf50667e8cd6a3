import random

import pytest
from pyspark.sql import functions as F

from proofloom.functions import hashing, offsets
from proofloom.operators import academic, alike, lifecycle, logic, norm, resolve, revise, score, similarity, style, terms
from proofloom.operators import corpus as corpora
from proofloom.operators.parse import paragraph_array
from proofloom.operators.parse import sentence_windows as sentences
from proofloom.plans import audit
from proofloom.rules import EN, LATIN, ZH, Pack, Rule, Term, term_rows
from proofloom.schema import entries, make_issues


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_exact_hits_overlap_and_both_ways(spark, docs, monkeypatch):
    patterns = spark.createDataFrame([("aba",), ("ba",), ("a",)], "pattern string")
    want = {(0, 0, "aba"), (0, 2, "aba"), (0, 1, "ba"), (0, 3, "ba"), (0, 0, "a"), (0, 2, "a"), (0, 4, "a")}
    got = lambda: {(r["doc_id"], r["start"], r["pattern"]) for r in terms.exact_hits(docs("ababa", "xyz", None), patterns).collect()}
    assert got() == want
    monkeypatch.setattr(terms, "SEARCHED_PATTERNS", 1)
    assert got() == want


def test_fuzzy_hits_against_brute_force(spark, docs):
    rng = random.Random(3)
    surface = "abcdefghijklmnop"
    texts = ["".join(rng.choice("xyz") for _ in range(5)) + "".join(c if rng.random() > 0.07 else "q" for c in surface) + "zz" for _ in range(12)]
    patterns = spark.createDataFrame([(surface, "standard", "t")], "pattern string, role string, term_id string")
    got = {(r["doc_id"], r["start"], r["distance"]) for r in terms.fuzzy_hits(docs(*texts), patterns, terms.exact_hits(docs(*texts), patterns)).collect()}
    want = set()
    for i, t in enumerate(texts):
        for s in range(len(t) - len(surface) + 1):
            w = t[s : s + len(surface)]
            d = levenshtein(w, surface)
            shares = any(w[k : k + 2] == surface[k : k + 2] for k in range(len(surface) - 1))
            if w != surface and d <= 2 and 1 - d / len(surface) >= 0.86 and shares:
                want.add((i, s, d))
    assert got == want


def test_ordering_and_rebuild(docs):
    pack = Pack("t", ".", "", "x", "x", (), terms=(Term("o", "order", type="ordering", order=("red", "green", "blue"), segment=r"[a-z]+(?:, [a-z]+)+"),))
    rows = {r["doc_id"]: r for r in terms.ordering_issues(docs("green, red, blue", "red, green, blue", "red, blue"), pack).collect()}
    assert rows[0]["kind"] == "order" and rows[0]["suggestion"] == "red, green, blue" and rows[0]["first_wrong"] == 0
    assert 1 not in rows and rows[2]["kind"] == "incomplete"


def test_suppression_quartet(docs, spark):
    pack = Pack("t", ".", "", "x", r"^References$", ("not",), terms=(Term("t", "right", ("wrong",)),))
    d = docs("a wrong one", "not wrong", 'he said "wrong" then', 'he said "a long quotation with wrong inside" then', "References\nwrong")
    found = terms.suppress(terms.exact_issues(terms.exact_hits(d, term_rows(spark, pack))), d, pack)
    assert {r["doc_id"]: r["suppressed"] for r in found.collect()} == {0: None, 1: "negated", 2: None, 3: "long-quote", 4: "reference"}


def test_best_span(spark):
    d = spark.createDataFrame([("the quick brown fox", "a quick brow"), ("nothing", "xyz")], "s string, seed string")
    out = [r["b"] for r in d.select(terms.best_span(F.col("s"), F.col("seed")).alias("b")).collect()]
    assert (out[0]["start"], out[0]["end"]) == (3, 14) and (out[1]["start"], out[1]["end"]) == (0, 6)


def test_norm_pairs(docs):
    d = docs("1,234,567 wait!! the the end...", "fine text", "数据,集成 (中文)", '他说"中文"了', "abc中文 数据API中")
    rules = {(r["doc_id"], r["rule_id"], r["suggestion"]) for r in norm.punctuation_issues(d).collect()}
    assert (0, "thousands", "1234567") in rules and (0, "repeated-mark", "!") in rules and (0, "doubled-word", "the") in rules and (0, "ellipsis", "…") in rules
    assert not any(r[1] == "cjk-latin-space" and r[0] == 4 and "API" in str(r) for r in rules)
    assert (2, "half-width", "，") in rules and (2, "full-parens", "（中文）") in rules and (3, "cjk-quotes", "“中文”") in rules
    assert any(r[0] == 4 and r[1] == "cjk-latin-space" for r in rules) and not any(r[0] == 1 for r in rules)
    assert {r["pair"] for r in norm.pair_balance(docs("(a", "[]")).collect()} == {"()"}
    assert norm.percent_precision(docs("1% and 2.345%", "1% and 2.3%")).count() == 1


def test_banned_context(docs):
    pack = Pack("t", ".", "", "x", "x", (), banned=(Rule("b", "bad", "MAJOR", allow_context=("not so",)),))
    out = {r["doc_id"]: r["severity"] for r in norm.banned_issues(docs("bad", "not so bad"), pack, True).collect()}
    assert out == {0: "MAJOR", 1: "INFO"}


def test_logic_positive_and_negative(docs):
    sents = sentences(docs("样本来自本市。说明全国都好。", "样本来自各地。说明全国都好。"), ZH)
    assert {r["doc_id"] for r in logic.overgeneralisation(sents, ZH).collect()} == {0}
    sents = sentences(docs("这是必然的。", "可能必然如此。"), ZH)
    assert {r["doc_id"]: r["severity"] for r in logic.absolute_claims(sents, ZH).collect()} == {0: "MAJOR", 1: "MAJOR"}
    rows = logic.absolute_claims(sentences(docs("必然一定如此。", "一定如此。", "一定有3项。", "一定，如此。", "我们必然有3项，必然。"), ZH), ZH).collect()
    assert {r["doc_id"]: (r["severity"], r["terms"], r["start"], r["end"]) for r in rows} == {0: ("MAJOR", "必然", 0, 2), 1: ("INFO", "一定", 0, 2), 4: ("MINOR", "必然", 2, 4)}
    sents = sentences(docs("一二三四五六七八九十。因此如此。", "一二三。因此如此。", "一二三四五六七八九十。我们看，因此如此。", "一二三四五六七八九十3。因此如此。", "一二三四五。六七八九十。因此如此。"), ZH)
    assert {r["doc_id"] for r in logic.causal_leaps(sents, ZH).collect()} == {0, 4}
    sents = sentences(docs("这是必然的。", "可能必然如此。"), ZH)
    assert {r["doc_id"] for r in logic.intensity_conflicts(sents, ZH).collect()} == {1}
    sents = sentences(docs("部门已定。这些要做。", "已经定了。这些要做。"), ZH)
    assert {r["doc_id"] for r in logic.vague_references(sents, ZH).collect()} == {1}


def test_sums_and_shares(docs):
    d = docs("parts 240 units, 150 units and 50 units, total 430 units.", "parts 240 units, 150 units and 50 units, total 440 units.", "a share 108% here, 3 units, 4 units")
    paras = academic.numeric_paragraphs(d)
    rows = {r["doc_id"]: r for r in academic.sum_consistency(paras).collect()}
    assert set(rows) == {0} and rows[0]["computed"] == 440 and rows[0]["stated"] == 430 and rows[0]["severity"] == "MAJOR"
    assert {r["doc_id"] for r in academic.share_range(paras).collect()} == {2}
    facts = docs("1,200 units and 300 units, a total of 1,500 units, in 1998").select(academic.number_facts(F.col("text")).alias("f")).first()["f"]
    assert [(f["value"], f["unit"], f["label"]) for f in facts] == [(1200.0, "units", ""), (300.0, "units", ""), (1500.0, "units", "")]
    zh = docs("甲为312万条，乙为268万条，丙为196万条，三项合计776万条，占归集总量的95.8%。", "共820万条，其中甲312万条，乙268万条，丙196万条，合计776万条，占比80.5%。")
    paras = academic.numeric_paragraphs(zh, ZH)
    assert academic.sum_consistency(paras).count() == 0
    row = academic.share_consistency(paras).collect()
    assert [r["doc_id"] for r in row] == [1] and abs(row[0]["computed"] - 776 / 8.2) < 1e-9 and row[0]["stated"] == 80.5


def test_numbering_figures_references(docs, spark):
    d = docs("1. A\n2. B\n4. C\n5. D", "一、甲\n三、乙", "see figure 3\nFigure 2: x")
    assert {(r["doc_id"], r["num"], r["expected"]) for r in academic.numbering_jumps(d).collect()} == {(0, 4, 3), (1, 3, 2)}
    levels = docs("1. A\n1.1 a\n1.3 b\n2. B\n2.1 c\n2.2 d\n3. C\n3.2 e", "一、甲\n（一）子\n（二）丑\n二、乙\n（二）寅")
    assert {(r["doc_id"], r["level"], r["num"], r["expected"]) for r in academic.numbering_jumps(levels).collect()} == {(0, 2, 3, 2), (0, 2, 2, 1), (1, 2, 2, 1)}
    missing, orphan = academic.missing_and_orphans(*academic.figures(d), on=["doc_id", "num"])
    assert [tuple(r) for r in missing.collect()] == [(2, "3")] and [tuple(r) for r in orphan.collect()] == [(2, "2")]
    refs = spark.createDataFrame([(0, 1, "[1] A, B, C, D. T[Q]. P: X, 2050: 1–3. doi:11.x"), (0, 2, "[2] A. T[EB/OL]. 2020. doi:10.1234/abc")], "doc_id int, num int, text string")
    assert {(r["num"], r["check"]) for r in academic.reference_issues(refs, 2030).collect()} == {(1, c) for c in ("type-code", "year", "pages", "authors", "doi")}
    cites = spark.createDataFrame([(0, 2, 1), (0, 1, 5), (1, 1, 1), (1, 2, 5)], "doc_id int, num int, pos int")
    assert [r["doc_id"] for r in academic.citation_order(cites).collect()] == [0]


def greedy(items):
    kept = []
    for i in sorted(items, key=lambda x: (-x[0], x[1] - x[2], x[3], x[1])):
        if not any((a == i[1]) if (a == b or i[1] == i[2]) else (i[1] < b and a < i[2]) for _, a, b, _ in kept):
            kept.append(i)
    return kept


def test_overlaps_against_greedy(spark):
    rng, rows, want = random.Random(5), [], set()
    weight = {"FATAL": 100, "MAJOR": 20, "MINOR": 5, "INFO": 1}
    for doc in range(30):
        items = []
        for k in range(rng.randint(0, 8)):
            a = rng.randint(0, 12)
            b, s = a + rng.randint(0, 5), rng.choice(list(weight))
            rows.append((doc, a, b, s, f"r{k}"))
            items.append((weight[s], a, b, f"r{k}"))
        want |= {(doc, a, b, r) for _, a, b, r in greedy(items)}
    issues = make_issues(spark.createDataFrame(rows, "doc_id bigint, start int, end int, severity string, rule_id string"), "norm")
    assert {(r["doc_id"], r["start"], r["end"], r["rule_id"]) for r in resolve.resolve_overlaps(issues).collect()} == want


def test_edits_skip_what_changed(spark, docs):
    edits = spark.createDataFrame([(0, 0, 3, "abc", "X"), (0, 4, 7, "zzz", "Y"), (0, 8, 11, "ghi", "Z")], "doc_id bigint, start int, end int, before string, after string")
    row = revise.apply_edits(docs("abc def ghi", "same"), edits).orderBy("doc_id").collect()
    assert (row[0]["revised"], row[0]["n_applied"], row[0]["n_skipped"]) == ("X def Z", 2, 1) and row[1]["revised"] == "same"


def test_highlight_skips_inner_spans(spark, docs):
    issues = make_issues(spark.createDataFrame([(0, 0, 4, "a"), (0, 2, 6, "b"), (0, 5, 6, "c")], "doc_id bigint, start int, end int, rule_id string"), "norm")
    html = revise.highlight(docs("ab<defgh"), issues).first()["html"]
    assert html == '<mark class="minor">ab&lt;d</mark>e<mark class="minor">f</mark>gh'


def test_versions_and_candidates(spark):
    o = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["x"], 1)], "id string, variants array<string>, n int")
    n = spark.createDataFrame([("a", ["y", "x"], 1), ("c", ["x"], 1)], "id string, variants array<string>, n int")
    assert {(r["id"], r["change"]) for r in lifecycle.diff_versions(o, n, "id", ["variants", "n"]).collect()} == {("b", "removed"), ("c", "added")}
    t = spark.createDataFrame([("abc",), ("abcd",), ("xyz",)], "term string")
    assert {r["term"] for r in lifecycle.drop_contained(t).collect()} == {"abcd", "xyz"}
    s = spark.createDataFrame([("thethedata",), ("them",)], "t string")
    assert [r["o"] for r in s.select(lifecycle.strip_lead(F.col("t"), ["the"]).alias("o")).collect()] == ["data", "them"]
    j = spark.createDataFrame([("x ```{\"a\": 1}``` y",), ("none",)], "t string").select(lifecycle.unchecked_json(F.col("t"), "a int").alias("j"))
    assert [r["j"]["a"] if r["j"] else None for r in j.collect()] == [1, None]


def test_fingerprints_agree_with_the_columns(spark):
    texts = ["the quick brown fox jumps", "Zwei 数据集成 words 3.5% and more, 中 x", "", "a", "same same same same"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in similarity.fingerprints(df, "k", 16).collect():
        f = alike.fingerprint_of(texts[r["k"]], 16)
        assert f.simhash == r["simhash"] & (2**64 - 1) and f.minhash.tolist() == r["minhash"] and f.grams == set(r["grams"]), texts[r["k"]]


def plain_classes(texts, sim=0.85, least=0.9):
    """(class, first, second) by all pairs."""
    prints = [alike.fingerprint_of(t) for t in texts]
    scored = {(i, j): alike.scores_of(prints[i], prints[j]) for j in range(len(texts)) for i in range(j)}
    links = [k for k, s in scored.items() if s[0] >= sim and s[3] >= least]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return {(root[j], min(a for a, b in links if b == j), j) for _, j in links}


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice(changes)):
            t[rng.randrange(len(t))] = "z"
        out.append("".join(t))
    return out


@pytest.mark.parametrize("sim,least", [(0.85, 0.9), (0.7, 0.75), (0.5, 0.55)])
def test_repeated_paragraphs_against_all_pairs(sim, least):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 200))) for _ in range(5)] + ["!?!? ....", "数据集成平台的建设与数据集成平台的管理"]
    texts = variants(rng, base, 70, [0, 0, 1, 2, 3, 5])
    want = plain_classes(texts, sim, least)
    got = alike.alike_classes(texts, sim, least)
    assert {x[:3] for x in got} == want and len(got) == len(want) > 15
    assert alike.alike_classes([]) == alike.alike_classes(["one"]) == []


def test_many_alike_paragraphs_take_linear_output():
    template = " ".join(f"w{i}" for i in range(60))
    found = alike.alike_classes([f"{template} number {i}" for i in range(3000)])
    assert len(found) == 2999 and {c for c, *_ in found} == {0} and all(i < j for _, i, j, _ in found)


def test_repeats_name_their_paragraphs(docs):
    rng = random.Random(4)
    texts = [t.strip() for t in variants(rng, ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(2)], 7, [0, 1])]
    paras = ["Short.", *texts, texts[0]]
    rows = similarity.intra_duplicates(docs("\n".join(paras), "x", None)).collect()
    own = [(i, t) for i, t in enumerate(paras) if len(t) >= similarity.MIN_CHARS]
    want = {(0, *(own[x][0] for x in c)) for c in plain_classes([t for _, t in own])}
    assert {(r["doc_id"], r["class"], r["first"], r["second"]) for r in rows} == want and want
    assert all("\n".join(paras)[r["start"] : r["end"]] == paras[r["second"]] for r in rows)


def test_corpus_against_all_pairs(docs, spark):
    rng = random.Random(10)
    corpus = [("c%d" % i, " ".join(rng.choice("alpha beta gamma delta rho tau phi chi".split()) for _ in range(40))) for i in range(6)]
    texts = []
    for _ in range(30):
        w = rng.choice(corpus)[1].split()
        for _ in range(rng.choice([0, 2, 6, 15])):
            w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    want = {}
    for i, t in enumerate(texts):
        f = alike.fingerprint_of(t)
        best = None
        for name, c in corpus:
            s = alike.scores_of(f, alike.fingerprint_of(c))
            if s[0] >= 0.5 and not (s[1] < 0.45 and s[2] < 0.45) and s[3] >= 0.72 and (best is None or s[3] > best[1]):
                best = (name, s[3])
        if best:
            want[i] = best
    rows = entries(similarity.with_published(docs(*texts).withColumn("paras", paragraph_array(F.col("text"))), corpus), F.col("published")).collect()
    assert {r["doc_id"]: (r["source"], r["score"]) for r in rows} == want and 5 < len(want) < 30
    table = spark.createDataFrame([(n, c) for n, c in corpus] + [("x", None), ("z", corpus[0][1])], "source string, text string")
    rows = corpora.closest(docs(*texts, None), corpora.FingerprintStore.of(table)).join(corpora.named(docs(*texts)), ["t", "u"]).collect()
    assert {r["doc_id"]: (r["source"], round(r["score"], 9)) for r in rows} == {k: (n, round(x, 9)) for k, (n, x) in want.items()}
    fp = similarity.fingerprints(docs(*texts), "doc_id")
    cp = similarity.fingerprints(spark.createDataFrame(corpus, "c string, text string"), "c")
    rows = similarity.cross_duplicates(fp, cp, "doc_id", "c", block=2).collect()
    assert {r["doc_id"]: (r["c"], round(r["combined"], 9)) for r in rows} == {k: (n, round(x, 9)) for k, (n, x) in want.items()}


def test_style_and_gate(spark, docs):
    d = docs("One short. Two short.\n" + "x" * 50)
    p = style.profile(d).first()
    assert p["n_sentences"] == 3 and p["lead_ratio"] == 0.0
    assert style.profile(docs("")).first()["lead_ratio"] == 1.0
    g = spark.createDataFrame([(1, 0, 90.0), (0, 6, 90.0), (0, 0, 74.9), (0, 5, 75.0)], "f int, m int, o double").select(score.gate(F.col("f"), F.col("m"), F.col("o")).alias("g"))
    assert [r["g"] for r in g.collect()] == ["BLOCK", "REVIEW", "REVIEW", "PASS"]


def test_prefix_sums_and_ranks(spark):
    rng = random.Random(11)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 191, 192, 193, 1000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, a array<int>")
    out = {r["k"]: (r["s"], r["m"]) for r in df.select("k", offsets.prefix_sums(F.col("a")).alias("s"), offsets.scan(F.col("a"), -1, F.greatest).alias("m")).collect()}
    for i, r in enumerate(rows):
        assert out[i] == ([sum(r[:j]) for j in range(len(r))], [max([-1, *r[:j]]) for j in range(len(r))])
    df = spark.createDataFrame([([5, 0, 9, 5], [0, 5, 7]), ([], [1]), ([3], [])], "p array<int>, s array<int>")
    assert [r["r"] for r in df.select(offsets.ranks(F.col("p"), F.col("s")).alias("r")).collect()] == [[2, 1, 3, 2], [], [0]]


def test_in_row_terms_equal_the_tables(docs, spark, monkeypatch):
    rng = random.Random(12)
    pack = Pack("t", ".", "", "x", "x", ("not",), terms=(Term("a", "abcdefghij klmnop", ("abcdef ghij",), confidence=0.9), Term("b", "qrstuvwxyz", ("qrstu", "tuv"))))
    surfaces = ["abcdefghij klmnop", "abcdef ghij", "qrstuvwxyz", "qrstu", "tuv"]
    texts = []
    for _ in range(25):
        t = []
        for _ in range(4):
            t += ["".join(c if rng.random() > 0.06 else rng.choice("mnz") for c in rng.choice(surfaces)), "".join(rng.choice("xyz ") for _ in range(5))]
        texts.append("".join(t))
    table, d = term_rows(spark, pack), docs(*texts)
    want = {(r["doc_id"], r["start"], r["pattern"]) for r in terms.exact_hits(d, table).collect()}
    got = lambda: {(r["doc_id"], r["x"]["start"], r["x"]["pattern"]) for r in terms.with_hits(d, pack).select("doc_id", F.explode_outer("hits").alias("x")).filter("x IS NOT NULL").collect()}
    assert got() == want and len(want) > 30
    near = {(r["doc_id"], r["start"], r["end"], r["surface"], r["distance"]) for r in terms.fuzzy_hits(d, table, terms.exact_hits(d, table)).collect()}
    rows = d.withColumn("h", terms.exact_array(F.col("text"), pack)).withColumn("v", terms.fuzzy_votes(F.col("text"), pack))
    rows = rows.select("doc_id", F.explode(terms.fuzzy_array(F.col("text"), F.col("v"), F.col("h"), pack)).alias("x")).select("doc_id", "x.*").collect()
    assert {(r["doc_id"], r["start"], r["end"], r["surface"], r["distance"]) for r in rows} == near and len(near) > 5
    monkeypatch.setattr(terms, "SEARCHED_PATTERNS", 1)
    assert got() == want


def test_semantic_level(docs):
    pack = Pack("t", ".", "", "x", r"^References$", ("not",), terms=(Term("s", "right words", type="semantic", seeds=("the wrong words of old", "quite other things")),))
    texts = ["Here the wrong words of old stand. A calm sentence is here.", "References\nthe wrong words of old.", "wrong"]
    found = {(r["doc_id"], r["rule_id"], r["start"], r["end"], r["suggestion"]) for r in terms.term_issues(docs(*texts), pack).collect()}
    best = max(float(hashing.hashed_vector("Here the wrong words of old stand.") @ hashing.hashed_vector(seed)) for seed in pack.terms[0].seeds)
    assert best >= 0.82 and found == {(0, "semantic-s", 5, 27, "right words")}
    assert docs("ab", "").select(hashing.hashed_embedding(F.col("text"), 8).alias("e")).collect()[1]["e"] == [0.0] * 8


def test_annotation_and_review(docs, spark):
    d = docs("one two\n\nthree four")
    rows = [(0, 9, 14, "a", "three"), (0, 0, 3, "b", "the whole sentence"), (0, 0, 0, "c", ""), (0, 4, 99, "d", "x")]
    issues = make_issues(spark.createDataFrame(rows, "doc_id bigint, start int, end int, rule_id string, original string"), "norm")
    out = {r["rule_id"]: r for r in resolve.annotate(issues, d, paragraph_array(F.col("text"))).collect()}
    assert (out["a"]["line"], out["a"]["paragraph"], out["a"]["original"], out["a"]["sentence"]) == (3, 1, "three", "")
    assert (out["b"]["line"], out["b"]["original"], out["b"]["sentence"]) == (1, "one", "the whole sentence")
    why = {r["rule_id"]: r["rejected"] for r in resolve.review(issues, d).collect()}
    assert why == {"a": None, "b": "drift", "c": "empty-span", "d": "out-of-range"}


def test_verdicts_reach_only_what_was_asked(spark):
    rows = [(0, i, i + 1, f"r{i}", "MAJOR", 0.9) for i in range(14)] + [(0, 50, 51, "fuzzy-a", "MINOR", 0.8), (0, 60, 61, "fuzzy-b", "MINOR", 0.95)]
    issues = make_issues(spark.createDataFrame(rows, "doc_id bigint, start int, end int, rule_id string, severity string, confidence double"), "term")
    assert resolve.verdict_targets(issues).count() == 13
    verdicts = issues.select("doc_id", "issue_id", F.lit(False).alias("accept"), F.lit("").alias("note"))
    out = resolve.apply_verdicts(issues, verdicts).collect()
    assert len(out) == 16 and sum(r["refused"] for r in out) == 13 and {r["rule_id"] for r in out if r["refused"] and r["rule_id"].startswith("f")} == {"fuzzy-a"}


def test_references_are_exempt_after_overlaps(docs):
    pack = Pack("t", ".", "", "^$x", r"^References$", ("not",), language=(Rule("in", "bb", "MINOR"), Rule("wide", r"a+\n\[1\] bb", "MAJOR")), words=LATIN.words)
    d = docs("aa\n[1] bb\n[2] bb")
    found = {(r["rule_id"], r["start"]) for r in audit.raw_issues(d, pack, ("norm",)).collect()}
    assert found == {("wide", 0)}  # it hides one hit first, and the other lies in the references


def test_audit_end_to_end(docs):
    d = docs('bad!! token = "0123456789abcdef0123" word%%% here.', "A calm text.")
    report = audit.audit(d, LATIN, engines=("term", "norm"))
    gates = {r["doc_id"]: r["gate"] for r in report.scores.collect()}
    assert gates == {0: "BLOCK", 1: "PASS"}
    assert "BLOCK" in audit.render(report, d, "markdown").filter("doc_id = 0").first()["markdown"]
    report.release()
    twice = audit.audit(docs("bad!!", "bad!!", "calm").withColumn("doc_id", F.when(F.col("doc_id") < 2, 7)), LATIN, keep=False)
    assert sorted((r["doc_id"] or 0, r["n_minor"]) for r in twice.scores.collect())[1:] == [(7, 1), (7, 1)] and twice.scores.count() == 3
    assert {t["node"]: t["error"] for t in audit.traced(d, LATIN, ("norm", "logic"))} == {"norm": "", "logic": ""}
    assert audit.audit(d, LATIN, checks={"norm": ()}, engines=("norm",), keep=False).issues.count() == 0
    copied = "the same long paragraph stands here twice, word for word, to be found by the audit of duplicates"
    rules = {r["rule_id"] for r in audit.audit(docs(f"Intro 1.\n{copied}\n{copied}"), LATIN, ("academic",), keep=False, corpus=[("old", copied)]).issues.collect()}
    assert "dup-internal" in rules or "dup-cross" in rules
    assert audit.revise_texts(d, report.issues).filter("doc_id = 0").first()["revised"].startswith("bad! ")


def test_neutral_packs_on_real_phrasing(docs):
    """Each pack finds its faults in prose and nothing in prose without any."""
    bad = docs("We could of left.", "The the cat slept.", "Write to me@example.org now.", "We play in summer, spring and winter.", "The result is undoubtedly right, perhaps.", "machine learing works.", "Calm prose stands here, and it is short.")
    found = {(r["doc_id"], r["rule_id"]) for r in audit.raw_issues(bad, EN, ("term", "norm", "logic")).collect()}
    assert {(0, "could-of"), (1, "doubled-word"), (2, "mail"), (3, "order-e4"), (5, "term-e3")} <= found and 6 not in {d for d, _ in found} and 4 in {d for d, _ in found}
    bad = docs("我的的书在桌上。", "数椐集成很重要。", "既使下雨也去。", "秋、春、夏是季节。", "电话13912345678。", "重要会议重要会议开始了。", "他在家里看书。")
    found = {(r["doc_id"], r["rule_id"]) for r in audit.raw_issues(bad, ZH, ("term", "norm")).collect()}
    assert {(0, "z-mark-word"), (1, "term-z1"), (2, "z-spelling"), (3, "order-z2"), (5, "z-same-word")} <= found and 6 not in {d for d, _ in found}
    facts = docs("共3万平方千米，2亿元，5个百分点，7万").select(academic.number_facts(F.col("text"), ZH).alias("f")).first()["f"]
    assert [(f["value"], f["unit"]) for f in facts] == [(3.0, "平方千米"), (2.0, "元"), (5.0, "个百分点"), (7.0, "")]


def _copies(df, mark):
    return df._jdf.queryExecution().optimizedPlan().toString().count(mark)


def test_facts_are_made_once_and_rows_read_once(docs, spark):
    from proofloom.operators.norm import mark_faults
    from proofloom.plans import statement_queries as q
    from tests.conftest import SF

    for query in (q.statement_sums, q.statement_shares, q.statement_share_range, q.statement_numbers):
        assert _copies(query(spark, SF), "vstart, length(") + _copies(query(spark, SF), "regexp_extract_all(") <= 4
    for query in (q.statement_marks, q.statement_figures):
        assert _copies(query(spark, SF), "Relation [") == 1
    d = docs("see figure 3, see figure 3\nFigure 2: x\nFigure 2: y", "see figure 1\nFigure 1: x", None)
    assert {tuple(r) for r in academic.figure_faults(d).collect()} == {(0, "3", "missing"), (0, "2", "unused")}
    found = mark_faults(docs("1.5% and 2.125% (open", "", None)).collect()
    assert [tuple(r) for r in found] == [(0, "percent", ""), (0, "pair", "() 1 0")]


def test_prefix_sums_of_short_and_long_arrays(spark):
    from proofloom.functions.offsets import BLOCK, prefix_sums

    for n in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7):
        got = spark.range(1).select(prefix_sums(F.transform(F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: i < n), lambda i: (i % 5).cast("int"))).alias("s")).first()["s"]
        assert got == [sum(i % 5 for i in range(k)) for k in range(n)]
