"""Queries over the other tables, and over issues: similarity, consistency, versions, resolution, scores, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.hashing import minhash, simhash
from proofloom.operators import academic, corpus, indexes, lifecycle, norm, parse, resolve, revise, score, similarity
from proofloom.plans import audit
from proofloom.plans.sql import LINES, PENALTY, TOKENS, WEIGHT, T, issues, q, strip
from proofloom.rules import LATIN
from proofloom.schema import entries, make_issues

RULES = (*LATIN.language, *LATIN.banned)


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _docs(s, d):
    return parse.spread(_t(s, d, "documents").select("doc_id", "text"))


def _issues(s, d):
    return make_issues(norm.rule_hits(_docs(s, d), RULES), "norm")


# consistency of figures, on the star schema


def sum_consistency(s, d):
    part = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = _t(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = academic.header_line_sums(_t(s, d, "orders"), lines, "o_orderkey", "o_totalprice", part)
    return out.select("o_orderkey", "stated", F.round("computed", 2).alias("computed"), F.round("off", 6).alias("off"))


def share_consistency(s, d):
    """Share of each nation in its region's balance."""
    c = _t(s, d, "customer").join(_t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = c.groupBy("n_regionkey", "n_name").agg(F.sum(F.col("c_acctbal").cast("decimal(18,4)")).alias("part"))
    r = c.groupBy("n_regionkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,4)")).alias("whole"))
    return n.join(r, "n_regionkey").select("n_regionkey", "n_name", F.round(F.col("part").cast("double") / F.col("whole").cast("double") * 100, 6).alias("share"))


def numbering_lines(s, d):
    return academic.numbering_gaps(_t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", "l_linenumber", "l_linenumber").select("l_orderkey", "l_linenumber", "expected")


def numbering_turns(s, d):
    return academic.numbering_gaps(_t(s, d, "conversations"), "conv_id", "turn", "turn").select("conv_id", "turn", "expected")


def labels_unlisted(s, d):
    missing, orphan = academic.missing_and_orphans(_t(s, d, "labels").select("doc_id"), _t(s, d, "documents").select("doc_id"), ["doc_id"])
    return missing.withColumn("kind", F.lit("missing")).unionByName(orphan.withColumn("kind", F.lit("orphan")))


def dup_titles(s, d):
    items = _t(s, d, "part").select(F.lit("part").alias("grp"), "p_partkey", "p_name")
    return academic.duplicate_items(items, "grp", "p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]", ""))).select("p_partkey", "title_key", "first_of")


# similarity


def simhash_items(s, d):
    toks = _t(s, d, "benchmark").select("item_id", F.explode(parse.tokens(parse.TEXT())).alias("token"))
    return simhash(toks, "item_id", "token")


def simhash_nearest(s, d):
    """Nearest other item by SimHash, over the fixed list of items."""
    return indexes.nearest(simhash_items(s, d), "item_id")


def minhash_items(s, d):
    sig = minhash(similarity.shingle_hashes(parse.tokens(parse.TEXT())), 8)
    return _t(s, d, "benchmark").select("item_id", F.posexplode(sig).alias("slot", "value"))


def dup_cross(s, d):
    """Documents that hold much of a benchmark item's shingles."""
    out = similarity.shingle_overlap(_docs(s, d), _t(s, d, "benchmark").select("item_id", "text"), "doc_id", "item_id")
    return out.withColumn("overlap", F.round("overlap", 9))


def tfidf_topk(s, d):
    return similarity.tfidf_topk(_t(s, d, "benchmark"), _t(s, d, "documents").select("doc_id", "text"), "item_id", "doc_id", 3)


def tfidf_search(s, d):
    """The same by an index that is built once, searched by bounds (P10)."""
    return indexes.temporary_index(_t(s, d, "documents").select("doc_id", "text"), "doc_id").search(_t(s, d, "benchmark"), "item_id", "doc_id", 3)


def cross_duplicates(s, d):
    """Paragraphs of documents with the benchmark item that they are most like."""
    store = corpus.FingerprintStore.of(_t(s, d, "benchmark").select(F.col("item_id").cast("string").alias("source"), "text"))
    docs = _docs(s, d)
    rows = docs.select("doc_id", parse.TEXT().alias("text"), parse.paragraph_array(parse.TEXT()).alias("paras"))
    rows = similarity.located(corpus.with_matches(rows, docs, store, "matches"), "matches", "published")
    return entries(rows, F.col("published")).select("doc_id", "start", "end", F.col("source").alias("item_id"), F.round("score", 9).alias("score"))


def intra_duplicates(s, d):
    """Paragraphs of documents that repeat an earlier one."""
    return similarity.intra_duplicates(_docs(s, d)).select("doc_id", "class", "first", "second", F.round("score", 9).alias("score"))


# versions and candidates


def _versions(s, d):
    p = _t(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size")
    new = p.filter("id % 7 != 0").withColumn("p_size", F.when(F.col("id") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return p.filter("id % 11 != 0"), new


def version_diff(s, d):
    return lifecycle.diff_versions(*_versions(s, d), "id", ["p_name", "p_brand", "p_size"])


def version_merge(s, d):
    return lifecycle.merge_sets(*_versions(s, d))


def version_checksum(s, d):
    return lifecycle.checksum(_t(s, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def candidates(s, d):
    return lifecycle.candidates(_docs(s, d), LATIN.cues, stop=("theand",))


def term_update(s, d):
    known = _t(s, d, "benchmark").select(F.explode(parse.tokens(parse.TEXT())).alias("term"))
    return lifecycle.run_update(candidates(s, d), known, 0.85).select("id", "term", "occurrences", "confidence", "status")


def approvals(s, d):
    """Pending parts approved into a ledger that holds some of them already."""
    p = _t(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("term"))
    ledger = p.filter("CAST(id AS BIGINT) % 3 = 0").withColumn("status", F.lit("approved"))
    chosen = p.filter("CAST(id AS BIGINT) % 2 = 0").withColumn("status", F.lit("pending"))
    return lifecycle.approve(chosen, ledger).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("bigint")).alias("ids"))


def containment_dedup(s, d):
    names = _t(s, d, "conversations").select(F.explode(parse.tokens(parse.TEXT())).alias("term")).filter("length(term) >= 6").distinct()
    return lifecycle.drop_contained(names)


def term_search(s, d):
    terms = _t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.col("p_brand").alias("source"), F.col("p_type").alias("severity"))
    return lifecycle.search_terms(terms, "1", columns=("term", "source")).select("id", "term")


def loose_json(s, d):
    props = lifecycle.unchecked_json(F.concat(F.lit("answer: ```"), "props", F.lit("```")), "map<string,string>")
    return _t(s, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(props)), ",").alias("keys"))


# issues


def issue_overlap_resolved(s, d):
    return resolve.resolve_overlaps(_issues(s, d)).select("doc_id", "rule_id", "start", "end")


def critic_conflict(s, d):
    return resolve.resolve_conflicts(_issues(s, d)).select("issue_id", "doc_id", "rule_id", "start", "end")


def issue_dedup(s, d):
    return resolve.deduplicate(_issues(s, d).unionByName(_issues(s, d))).select("issue_id", "doc_id", "severity")


def issue_review(s, d):
    return resolve.review(_issues(s, d), _docs(s, d)).select("issue_id", "doc_id", F.coalesce("rejected", F.lit("")).alias("rejected"))


def second_round(s, d):
    return resolve.reportable(resolve.second_round(_issues(s, d))).select("issue_id", "doc_id")


def fact_checks(s, d):
    return resolve.fact_checks(_issues(s, d)).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


def dimension_scores(s, d):
    out = score.dimension_scores(_docs(s, d), _issues(s, d))
    return out.select("doc_id", "dimension", F.round("penalty", 3).alias("penalty"), F.round("score", 6).alias("score"), "n_fatal", "n_major", "n_minor", "n_info")


def gate(s, d):
    out = score.document_scores(score.dimension_scores(_docs(s, d), _issues(s, d)))
    return out.select("doc_id", F.round("overall", 3).alias("overall"), "gate")


def severity_pivot(s, d):
    return score.severity_pivot(_issues(s, d))


def score_rollup(s, d):
    return score.score_rollup(_issues(s, d))


def engine_trace(s, d):
    return score.node_trace(_issues(s, d))


def issue_summaries(s, d):
    return score.summaries(_issues(s, d), 3)


def issue_browser(s, d):
    return score.browse(_issues(s, d), ("FATAL", "MAJOR"), ("language", "political")).select("issue_id", "doc_id", "severity", "category")


def revised_text(s, d):
    rule = [r for r in LATIN.language if r.id == "odd-suffix"]
    found = make_issues(norm.rule_hits(_docs(s, d), rule), "norm")
    out = revise.apply_edits(_docs(s, d), revise.edits_of(found))
    return out.select("doc_id", F.md5("revised").alias("digest"), "n_applied", "n_skipped")


def highlighted(s, d):
    return revise.highlight(_docs(s, d), _issues(s, d)).select("doc_id", F.length("html").alias("n_chars"), F.md5("html").alias("digest"))


def json_report(s, d):
    found = _issues(s, d)
    dims = score.dimension_scores(_docs(s, d), found)
    return audit.render(audit.Report(found, dims, score.document_scores(dims), score.node_trace(found)), _docs(s, d), "json").select("doc_id", F.get_json_object("json", "$.gate").alias("gate"), F.size(F.from_json(F.get_json_object("json", "$.issues"), "array<string>")).alias("n_issues"))


# history


def history_latest(s, d):
    return score.latest(_t(s, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


def history_trend(s, d):
    out = score.trend(_t(s, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "value", "event_id")
    return out.select("user_id", "event_id", F.round("change", 6).alias("change"))


NAMES = [sum_consistency, share_consistency, numbering_lines, numbering_turns, labels_unlisted, approvals, dup_titles, simhash_items, simhash_nearest, minhash_items, dup_cross, tfidf_topk, tfidf_search, cross_duplicates, intra_duplicates, version_diff, version_merge, version_checksum, candidates, term_update, containment_dedup, term_search, loose_json, issue_overlap_resolved, critic_conflict, issue_dedup, issue_review, second_round, fact_checks, dimension_scores, gate, severity_pivot, score_rollup, engine_trace, issue_summaries, issue_browser, revised_text, highlighted, json_report, history_latest, history_trend]
QUERIES = {f.__name__: f for f in NAMES}

_ISSUES = issues(RULES, "norm")
_H64 = "('0x' || substr(md5(token), 1, 16))::UBIGINT"
_SIM = f"""tok AS (SELECT item_id, lower(unnest(regexp_extract_all({T}, {q(TOKENS)}))) AS token FROM benchmark), tf AS (SELECT item_id, {_H64} AS h, count(*) AS w FROM tok GROUP BY item_id, token),
votes AS (SELECT item_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN w ELSE -w END) AS v FROM tf, (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY 1, 2),
sim AS (SELECT item_id, sum(CASE WHEN v > 0 THEN 1::UBIGINT << b ELSE 0 END)::UBIGINT AS u FROM votes GROUP BY 1)"""
_SIGNED = "CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END"
_COEFFS = """g AS (SELECT 1 AS i, (20260918::UHUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 AS x UNION ALL SELECT i + 1, (x * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM g WHERE i < 16),
k AS (SELECT (p.i - 1) // 2 AS slot, (p.x >> 16)::HUGEINT | 1::HUGEINT AS a, (r.x >> 16)::HUGEINT AS b FROM g p JOIN g r ON r.i = p.i + 1 WHERE p.i % 2 = 1)"""
_SHINGLES = lambda table, key: f"""(SELECT {key}, ('0x' || substr(md5(array_to_string(t[i:i+2], ' ')), 9, 8))::UBIGINT::BIGINT AS h FROM (SELECT {key}, t, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS i FROM (SELECT {key}, list_transform(regexp_extract_all({T}, {q(TOKENS)}), lambda x: lower(x)) AS t FROM {table}) WHERE len(t) > 0) GROUP BY ALL)"""
_CANDS = f"""c0 AS ({" UNION ALL ".join(f"SELECT doc_id, lower(unnest(regexp_extract_all({T}, {q(c)}, 1))) AS term, {i} AS cue FROM documents" for i, c in enumerate(LATIN.cues))}),
cands AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS n_docs, min(cue)::BIGINT AS first_cue, round(least(0.95, least(0.9, 0.55 + 0.04 * length(term)) + 0.05 * (count(*) - 1)), 6)::DOUBLE AS confidence FROM c0 WHERE length(term) >= 4 AND term <> 'theand' GROUP BY term)"""
_VERSIONS = """o AS (SELECT p_partkey AS id, p_name, p_brand, p_size FROM part WHERE p_partkey % 11 <> 0), n AS (SELECT p_partkey AS id, p_name, p_brand, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0)"""
_DIM_OF = "CASE WHEN category IN ('term', 'political') THEN 'terminology' WHEN category IN ('language', 'format') THEN 'language' WHEN category = 'logic' THEN 'logic' WHEN category IN ('data', 'duplicate', 'reference') THEN 'academic' WHEN category = 'style' THEN 'style' END"
_DIMS = "dims AS (SELECT * FROM (VALUES ('terminology', 150.0, 0.35), ('language', 130.0, 0.18), ('logic', 200.0, 0.17), ('academic', 200.0, 0.25), ('style', 120.0, 0.05)) v(dimension, scale, weight))"
_SCORES = f"""{_ISSUES}, {_DIMS}, sums AS (SELECT doc_id, {_DIM_OF} AS dimension, sum({PENALTY})::DOUBLE AS penalty, count(*) FILTER (severity = 'FATAL') AS f, count(*) FILTER (severity = 'MAJOR') AS m, count(*) FILTER (severity = 'MINOR') AS n, count(*) FILTER (severity = 'INFO') AS i FROM issues GROUP BY 1, 2),
scored AS (SELECT d.doc_id, dims.dimension, weight, coalesce(penalty, 0.0) AS penalty, 100 * exp(-coalesce(penalty, 0.0) / scale) AS score, coalesce(f, 0) AS n_fatal, coalesce(m, 0) AS n_major, coalesce(n, 0) AS n_minor, coalesce(i, 0) AS n_info FROM documents d CROSS JOIN dims LEFT JOIN sums ON sums.doc_id = d.doc_id AND sums.dimension = dims.dimension)"""
_GATES = f"""{_SCORES}, g AS (SELECT doc_id, sum(round(score, 1)::DECIMAL(10,1) * weight::DECIMAL(4,2))::DOUBLE AS overall, sum(n_fatal) AS f, sum(n_major) AS m FROM scored GROUP BY 1)"""
_GATE = "CASE WHEN f > 0 THEN 'BLOCK' WHEN overall < 75 OR m > 5 THEN 'REVIEW' ELSE 'PASS' END"
_ODD = next(r.pattern for r in LATIN.language if r.id == "odd-suffix")

SQL = {
    "sum_consistency": """WITH c AS (SELECT l_orderkey AS o_orderkey, sum((l_extendedprice * (1 - l_discount) * (1 + l_tax))::DECIMAL(38,6))::DOUBLE AS computed FROM lineitem GROUP BY 1), j AS (SELECT o.o_orderkey, o_totalprice AS stated, computed, abs(computed - o_totalprice) / abs(o_totalprice) AS off FROM orders o JOIN c ON c.o_orderkey = o.o_orderkey) SELECT o_orderkey, stated, round(computed, 2) AS computed, round(off, 6) AS off FROM j WHERE off > 0.01""",
    "share_consistency": """WITH c AS (SELECT n_regionkey, n_name, sum(c_acctbal::DECIMAL(18,4)) AS part FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT n_regionkey::BIGINT AS n_regionkey, n_name, round(part::DOUBLE / (sum(part) OVER (PARTITION BY n_regionkey))::DOUBLE * 100, 6) AS share FROM c""",
    "numbering_lines": """WITH w AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1)::BIGINT AS expected FROM lineitem) SELECT * FROM w WHERE l_linenumber <> expected""",
    "numbering_turns": """WITH w AS (SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 1)::BIGINT AS expected FROM conversations) SELECT * FROM w WHERE turn <> expected""",
    "labels_unlisted": """SELECT DISTINCT doc_id, 'missing' AS kind FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT DISTINCT doc_id, 'orphan' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "dup_titles": """WITH k AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS title_key FROM part), w AS (SELECT *, min(p_partkey) OVER (PARTITION BY title_key) AS first_of FROM k) SELECT * FROM w WHERE p_partkey <> first_of""",
    "simhash_items": f"WITH {_SIM} SELECT item_id, {_SIGNED} AS simhash FROM sim",
    "simhash_nearest": f"WITH {_SIM}, p AS (SELECT a.item_id, b.item_id AS other, bit_count(xor(a.u, b.u))::BIGINT AS bits FROM sim a, sim b WHERE a.item_id <> b.item_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bits, other) AS n FROM p) SELECT item_id, other, bits FROM r WHERE n = 1",
    "minhash_items": f"WITH RECURSIVE {_COEFFS}, s AS {_SHINGLES('benchmark', 'item_id')} SELECT item_id, slot::BIGINT AS slot, (min((a * h::HUGEINT + b) % 2305843009213693951) % 4294967296)::BIGINT AS value FROM s, k GROUP BY 1, 2",
    "dup_cross": f"WITH l AS {_SHINGLES('documents', 'doc_id')}, r AS {_SHINGLES('benchmark', 'item_id')}, n AS (SELECT item_id, count(*) AS n FROM r GROUP BY 1), p AS (SELECT doc_id, item_id, count(*) AS shared FROM l JOIN r USING (h) GROUP BY 1, 2) SELECT doc_id, item_id, shared, round(shared / n::DOUBLE, 9) AS overlap FROM p JOIN n USING (item_id) WHERE shared / n::DOUBLE >= 0.45",
    "tfidf_topk": f"""WITH d AS (SELECT doc_id, lower(unnest(regexp_extract_all({T}, {q(TOKENS)}))) AS token FROM documents), dt AS (SELECT doc_id, token, count(*) AS tf FROM d GROUP BY 1, 2), nn AS (SELECT count(*)::DOUBLE AS n FROM documents), idf AS (SELECT token, ln((1 + (SELECT n FROM nn)) / (1 + count(*))) + 1 AS idf FROM dt GROUP BY 1),
  dw AS (SELECT doc_id, token, (1 + ln(tf)) * idf AS w FROM dt JOIN idf USING (token)), b AS (SELECT item_id, lower(unnest(regexp_extract_all({T}, {q(TOKENS)}))) AS token FROM benchmark), qt AS (SELECT item_id, token, count(*) AS tf FROM b GROUP BY 1, 2), qw AS (SELECT item_id, token, (1 + ln(tf)) * coalesce(idf, ln(1 + (SELECT n FROM nn)) + 1) AS w FROM qt LEFT JOIN idf USING (token)),
  dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1), dots AS (SELECT item_id, doc_id, sum(dw.w * qw.w) AS dot FROM dw JOIN qw USING (token) GROUP BY 1, 2), s AS (SELECT item_id, doc_id, round(dot / (dn.n * qn.n), 9) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (item_id)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 3""",
    "version_diff": f"""WITH {_VERSIONS}, j AS (SELECT coalesce(o.id, n.id) AS id, o.id AS oid, n.id AS nid, concat_ws(',', CASE WHEN o.p_name IS DISTINCT FROM n.p_name THEN 'p_name' END, CASE WHEN o.p_brand IS DISTINCT FROM n.p_brand THEN 'p_brand' END, CASE WHEN o.p_size IS DISTINCT FROM n.p_size THEN 'p_size' END) AS changed FROM o FULL JOIN n ON o.id = n.id) SELECT id, CASE WHEN oid IS NULL THEN 'added' WHEN nid IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN oid IS NOT NULL AND nid IS NOT NULL THEN changed ELSE '' END AS columns FROM j WHERE oid IS NULL OR nid IS NULL OR changed <> ''""",
    "version_merge": f"WITH {_VERSIONS} SELECT id, p_name, p_brand, p_size::BIGINT AS p_size FROM n UNION ALL SELECT id, p_name, p_brand, p_size::BIGINT FROM o WHERE id NOT IN (SELECT id FROM n)",
    "version_checksum": "SELECT substr(sha256(string_agg(line, chr(10) ORDER BY line)), 1, 16) AS version FROM (SELECT concat_ws('|', n_nationkey, n_name, n_regionkey) AS line FROM nation)",
    "candidates": f"WITH {_CANDS} SELECT term, occurrences, n_docs, first_cue, confidence FROM cands",
    "term_update": f"WITH {_CANDS} SELECT 'cand-' || substr(md5(term), 1, 10) AS id, term, occurrences, confidence, 'pending' AS status FROM cands WHERE confidence >= 0.85 AND term NOT IN (SELECT lower(unnest(regexp_extract_all({T}, {q(TOKENS)}))) FROM benchmark)",
    "approvals": "SELECT 'approved' AS status, count(*) AS n, sum(p_partkey)::BIGINT AS ids FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0",
    "containment_dedup": f"WITH t AS (SELECT DISTINCT term FROM (SELECT lower(unnest(regexp_extract_all({T}, {q(TOKENS)}))) AS term FROM conversations) WHERE length(term) >= 6) SELECT a.term FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE length(b.term) > length(a.term) AND contains(b.term, a.term))",
    "term_search": "SELECT p_partkey AS id, p_name AS term FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), '1')",
    "loose_json": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "critic_conflict": f"""WITH {_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY {WEIGHT} DESC, confidence DESC, length(suggestion) DESC, issue_id) AS nth FROM issues) SELECT issue_id, doc_id, rule_id, start, "end" FROM r WHERE nth = 1""",
    "issue_dedup": f"WITH {_ISSUES} SELECT DISTINCT issue_id, doc_id, severity FROM issues",
    "issue_review": f"""WITH {_ISSUES} SELECT issue_id, doc_id, CASE WHEN suggestion <> '' AND suggestion = original THEN 'no-change' ELSE '' END AS rejected FROM issues""",
    "second_round": f"WITH {_ISSUES} SELECT issue_id, doc_id FROM issues WHERE (severity IN ('FATAL', 'MAJOR') OR confidence >= 0.6) AND (severity <> 'INFO' OR confidence >= 0.6)",
    "fact_checks": f"""WITH {_ISSUES} SELECT CASE WHEN category IN ('term', 'political') THEN 'term' ELSE 'other' END AS kind, CASE WHEN category IN ('term', 'political') THEN 'confirmed' ELSE 'unchecked' END AS verdict, count(*) AS n FROM issues GROUP BY 1, 2""",
    "dimension_scores": f"WITH {_SCORES} SELECT doc_id, dimension, round(penalty, 3) AS penalty, round(score, 6) AS score, n_fatal, n_major, n_minor, n_info FROM scored",
    "gate": f"WITH {_GATES} SELECT doc_id, round(overall, 3) AS overall, {_GATE} AS gate FROM g",
    "severity_pivot": f"""WITH {_ISSUES} SELECT category, count(*) FILTER (severity = 'FATAL') AS "FATAL", count(*) FILTER (severity = 'MAJOR') AS "MAJOR", count(*) FILTER (severity = 'MINOR') AS "MINOR", count(*) FILTER (severity = 'INFO') AS "INFO" FROM issues GROUP BY 1""",
    "score_rollup": f"WITH {_ISSUES} SELECT coalesce(dimension, 'ALL') AS dimension, coalesce(severity, 'ALL') AS severity, count(*) AS n FROM (SELECT {_DIM_OF} AS dimension, severity FROM issues) GROUP BY ROLLUP (dimension, severity)",
    "engine_trace": f"WITH {_ISSUES} SELECT engine, count(*) AS n, 'FATAL ' || count(*) FILTER (severity = 'FATAL') || ', MAJOR ' || count(*) FILTER (severity = 'MAJOR') || ', MINOR ' || count(*) FILTER (severity = 'MINOR') || ', INFO ' || count(*) FILTER (severity = 'INFO') AS line FROM issues GROUP BY 1",
    "issue_summaries": f"""WITH {_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {WEIGHT} DESC, start, rule_id, message) AS nth FROM issues WHERE severity IN ('FATAL', 'MAJOR')) SELECT doc_id, string_agg(rule_id || ': ' || message, '; ' ORDER BY nth) AS summary FROM r WHERE nth <= 3 GROUP BY 1""",
    "issue_browser": f"WITH {_ISSUES} SELECT issue_id, doc_id, severity, category FROM issues WHERE severity IN ('FATAL', 'MAJOR') AND category IN ('language', 'political')",
    "revised_text": f"SELECT doc_id, md5(regexp_replace({T}, {q(_ODD)}, '\\1', 'g')) AS digest, len(regexp_extract_all({T}, {q(_ODD)}))::BIGINT AS n_applied, 0::BIGINT AS n_skipped FROM documents",
    "json_report": f"WITH {_GATES}, n AS (SELECT doc_id, count(*) AS n_issues FROM issues GROUP BY 1) SELECT doc_id, {_GATE} AS gate, coalesce(n_issues, 0) AS n_issues FROM g LEFT JOIN n USING (doc_id)",
    "history_latest": "WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, value FROM r WHERE n = 1",
    "history_trend": "SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events",
}
SQL["tfidf_search"] = SQL["tfidf_topk"]
_ALL_COEFFS = _COEFFS.replace("i < 16", "i < 256")
SQL["intra_duplicates"] = f"""WITH RECURSIVE {LINES}, {_ALL_COEFFS},
b AS (SELECT doc_id, para_idx AS i, text, regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS l FROM paras WHERE NOT is_heading AND NOT in_ref AND length({strip("text")}) >= {similarity.MIN_CHARS}),
gr AS (SELECT DISTINCT doc_id, i, substr(l, at0::BIGINT, 3) AS gram FROM (SELECT doc_id, i, l, unnest(range(1, greatest(length(l) - 2, 1) + 1)) AS at0 FROM b WHERE l <> '')),
n AS (SELECT doc_id, i, count(*) AS n FROM gr GROUP BY 1, 2),
pr AS (SELECT x.doc_id, x.i, y.i AS j, count(*) AS met FROM gr x JOIN gr y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i GROUP BY 1, 2, 3),
jc AS (SELECT pr.doc_id, pr.i, pr.j, met::DOUBLE / (a.n + c.n - met) AS gram FROM pr JOIN n a ON a.doc_id = pr.doc_id AND a.i = pr.i JOIN n c ON c.doc_id = pr.doc_id AND c.i = pr.j WHERE met::DOUBLE / (a.n + c.n - met) >= 0.7499),
ask AS (SELECT doc_id, i FROM jc UNION SELECT doc_id, j FROM jc),
tk AS (SELECT doc_id, i, list_transform(regexp_extract_all(text, {q(TOKENS)}), lambda x: lower(x)) AS t FROM b JOIN ask USING (doc_id, i)),
tf AS (SELECT doc_id, i, ('0x' || substr(md5(token), 1, 16))::UBIGINT AS h, count(*) AS w FROM (SELECT doc_id, i, unnest(t) AS token FROM tk) GROUP BY doc_id, i, token),
vt AS (SELECT doc_id, i, nth_bit, sum(CASE WHEN (h >> nth_bit) & 1 = 1 THEN w ELSE -w END) AS v FROM tf, (SELECT unnest(range(0, 64))::UBIGINT AS nth_bit) GROUP BY 1, 2, 3),
sm AS (SELECT doc_id, i, sum(CASE WHEN v > 0 THEN 1::UBIGINT << nth_bit ELSE 0 END)::UBIGINT AS u FROM vt GROUP BY 1, 2),
sh AS (SELECT DISTINCT doc_id, i, ('0x' || substr(md5(array_to_string(t[at0:at0+2], ' ')), 9, 8))::UBIGINT::HUGEINT AS h FROM (SELECT doc_id, i, t, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS at0 FROM tk WHERE len(t) > 0)),
sl AS (SELECT doc_id, i, slot, min((a * h + k.b) % 2305843009213693951) % 4294967296 AS v FROM sh, k GROUP BY 1, 2, 3),
mh AS (SELECT jc.doc_id, jc.i, jc.j, count(*) FILTER (x.v = y.v) / 128.0::DOUBLE AS mins FROM jc JOIN sl x ON x.doc_id = jc.doc_id AND x.i = jc.i JOIN sl y ON y.doc_id = jc.doc_id AND y.i = jc.j AND y.slot = x.slot GROUP BY 1, 2, 3),
sc AS (SELECT jc.doc_id, jc.i, jc.j, 1 - bit_count(xor(x.u, y.u)) / 64.0::DOUBLE AS sim, mins, gram FROM jc JOIN mh USING (doc_id, i, j) JOIN sm x ON x.doc_id = jc.doc_id AND x.i = jc.i JOIN sm y ON y.doc_id = jc.doc_id AND y.i = jc.j),
ln AS (SELECT doc_id, i, j, 0.25::DOUBLE * sim + 0.35::DOUBLE * mins + 0.40::DOUBLE * gram AS score FROM sc WHERE sim >= 0.85 AND 0.25::DOUBLE * sim + 0.35::DOUBLE * mins + 0.40::DOUBLE * gram >= 0.9),
both_ways AS (SELECT doc_id, i AS x, j AS y FROM ln UNION SELECT doc_id, j, i FROM ln),
reach AS (SELECT doc_id, x, x AS y FROM both_ways UNION SELECT r.doc_id, r.x, w.y FROM reach r JOIN both_ways w ON w.doc_id = r.doc_id AND w.x = r.y),
cl AS (SELECT doc_id, x AS j, min(y) AS class FROM reach GROUP BY 1, 2),
fi AS (SELECT *, row_number() OVER (PARTITION BY doc_id, j ORDER BY i) AS nth FROM ln)
SELECT fi.doc_id, cl.class, fi.i AS first, fi.j AS second, round(fi.score, 9) AS score FROM fi JOIN cl USING (doc_id, j) WHERE nth = 1"""
