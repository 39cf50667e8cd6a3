"""Queries over documents and pages: parsing, terms, norms, logic, style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.operators import academic, logic, norm, parse, style, terms
from proofloom.plans import audit
from proofloom.plans.sql import LINES, SEGMENTS, TOKENS, T, any_contains, hits, q, strip
from proofloom.rules import LATIN, term_rows
from proofloom.schema import entries

RULES = (*LATIN.language, *LATIN.banned)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return parse.spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sents(s, d):
    return parse.sentence_windows(docs(s, d))


def doc_meta(s, d):
    return parse.doc_meta(docs(s, d))


def paragraphs(s, d):
    return parse.paragraphs(docs(s, d))


def sentences(s, d):
    return parse.sentences(docs(s, d))


def rule_positions(s, d):
    """Hits of rules with their line, paragraph and surroundings."""
    rows = docs(s, d).select("doc_id", parse.TEXT().alias("text")).withColumn("hits", norm.rule_array(F.col("text"), RULES))
    at = F.transform("hits", lambda x: x["start"])
    paras = F.transform(parse.paragraph_array(F.col("text")), lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end")))
    rows = rows.withColumn("para", parse.piece_indices(at, paras)).withColumn("line", parse.line_numbers(at, F.col("text")))
    around = parse.contexts(F.col("text"), F.col("hits"))
    rows = entries(rows, F.when(F.size("hits") > 0, F.arrays_zip("hits", "para", "line", around.alias("around"))))
    return rows.select("doc_id", "hits.rule_id", "hits.start", "hits.end", F.col("para").alias("para_idx"), "line", "around")


def hit_sentences(s, d):
    """Sentence of each rule hit."""
    rows = docs(s, d).select("doc_id", parse.TEXT().alias("text")).withColumn("hits", norm.rule_array(F.col("text"), RULES))
    rows = rows.withColumn("sent", parse.piece_indices(F.transform("hits", lambda x: x["start"]), parse.sentence_array(F.col("text"))))
    rows = entries(rows, F.when(F.size("hits") > 0, F.arrays_zip("hits", "sent")))
    return rows.select("doc_id", "hits.rule_id", "hits.start", "hits.end", F.col("sent").alias("sent_idx"))


def quote_spans(s, d):
    return docs(s, d).select("doc_id", F.explode(parse.quote_spans(parse.TEXT())).alias("x")).select("doc_id", "x.qs", "x.qe")


def tokens_top(s, d):
    return docs(s, d).select(F.explode(parse.tokens(parse.TEXT())).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def char_ngram_stats(s, d):
    return _table(s, d, "benchmark").select("item_id", F.explode(parse.char_ngrams(parse.TEXT(), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


def html_strip(s, d):
    return _table(s, d, "pages").select("page_id", "url", F.length(parse.html_strip(F.col("html"))).alias("n_chars"), F.md5(parse.html_strip(F.col("html"))).alias("digest"))


def exact_term_hits(s, d):
    return terms.exact_hits(docs(s, d), term_rows(s, LATIN)).select("doc_id", "start", "end", "pattern", "role", "term_id")


def term_variants(s, d):
    hit = terms.exact_hits(docs(s, d), term_rows(s, LATIN))
    return terms.exact_issues(hit).select("doc_id", "rule_id", "severity", "message", "start", "end", "original", "suggestion")


def fuzzy_term_hits(s, d):
    t, p = docs(s, d), term_rows(s, LATIN)
    return terms.fuzzy_hits(t, p, terms.exact_hits(t, p))


def semantic_nearest(s, d):
    vectors = _table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    seeds = _table(s, d, "embeddings").filter("vec_id < 10").select(F.lit("seeds").alias("term"), F.col("vec_id").alias("seed"), F.col("embedding").alias("vec"))
    return terms.semantic_hits(vectors, seeds, 0.3).select("key", "seed", F.round("score", 6).alias("score"))


def ordering_violations(s, d):
    return terms.ordering_issues(docs(s, d))


def banned_patterns(s, d):
    return norm.banned_issues(docs(s, d)).select("issue_id", "doc_id", "category", "severity", "rule_id", "start", "end", "original")


def dict_rules(s, d):
    return norm.rule_hits(docs(s, d), LATIN.language)


def punctuation(s, d):
    return norm.punctuation_issues(docs(s, d)).select("doc_id", "rule_id", "start", "end", "original", "suggestion")


def long_sentences(s, d):
    return norm.long_sentences(docs(s, d)).select("doc_id", "start", "end")


def suppressed_terms(s, d):
    """Variants with the reason for which they are not reported."""
    t = docs(s, d)
    found = terms.exact_issues(terms.exact_hits(t, term_rows(s, LATIN)))
    return terms.suppress(found, t).select("doc_id", "rule_id", "start", "end", F.coalesce("suppressed", F.lit("")).alias("suppressed"))


def overgeneralisation(s, d):
    return logic.overgeneralisation(_sents(s, d)).select("doc_id", "sent_idx", "start", "end")


def claims(s, d):
    return logic.claims_without_evidence(parse.paragraphs(docs(s, d))).select("doc_id", "para_idx")


def causal_leap(s, d):
    return logic.causal_leaps(_sents(s, d)).select("doc_id", "sent_idx")


def absolute_terms(s, d):
    return logic.absolute_claims(_sents(s, d))


def intensity_conflict(s, d):
    return logic.intensity_conflicts(_sents(s, d)).select("doc_id", "sent_idx", "strong", "weak")


def vague_reference(s, d):
    return logic.vague_references(_sents(s, d)).select("doc_id", "sent_idx", "word")


def quantifier_conflict(s, d):
    return logic.quantifier_conflicts(_sents(s, d)).select("doc_id", "sent_idx", "top", "word")


def claim_sentences(s, d):
    return academic.claim_sentences(_sents(s, d)).select("doc_id", "sent_idx")


def number_facts(s, d):
    return docs(s, d).select("doc_id", F.explode(academic.number_facts(parse.TEXT())).alias("f")).select("doc_id", "f.label", "f.value", "f.unit", "f.start", "f.end")


def vague_comparisons(s, d):
    return academic.vague_comparisons(_sents(s, d)).select("doc_id", "sent_idx", "phrase")


def style_profile(s, d):
    p = style.profile(docs(s, d))
    return p.select("doc_id", "n_sentences", F.round("mean_sentence", 6).alias("mean_sentence"), "max_sentence", F.round("symbol_density", 9).alias("symbol_density"), F.round("hedge_density", 9).alias("hedge_density"), F.round("data_ratio", 9).alias("data_ratio"), F.round("lead_ratio", 9).alias("lead_ratio"), "europeanised")


def _gaps(s, d):
    profiles = style.profile(docs(s, d)).withColumn("preset", F.lit("default"))
    return profiles, style.metric_gaps(profiles, audit.style_targets(s))


def metric_gap(s, d):
    return _gaps(s, d)[1].select("doc_id", "metric", F.round("value", 9).alias("value"), "direction", F.round("excess", 9).alias("excess"), "severity")


def style_score(s, d):
    return style.style_scores(*_gaps(s, d)).withColumn("style_score", F.round("style_score", 6))


def style_plan(s, d):
    return style.transfer_plan(_gaps(s, d)[1])


def intake_routes(s, d):
    x = F.col("x")
    rows = docs(s, d).select("doc_id", audit.intake_struct(parse.TEXT()).alias("x"))
    return rows.select("doc_id", "x.n_chars", F.round("x.digit_density", 9).alias("digit_density"), "x.n_refs", "x.is_academic", "x.doc_type", *[audit.route(x, e).alias(f"run_{e}") for e in audit.ENGINES])


NAMES = [doc_meta, paragraphs, sentences, rule_positions, hit_sentences, quote_spans, tokens_top, char_ngram_stats, html_strip, exact_term_hits, term_variants, fuzzy_term_hits, semantic_nearest, ordering_violations, banned_patterns, dict_rules, punctuation, long_sentences, suppressed_terms, overgeneralisation, claims, causal_leap, absolute_terms, intensity_conflict, vague_reference, quantifier_conflict, claim_sentences, number_facts, vague_comparisons, style_profile, metric_gap, style_score, style_plan, intake_routes]
QUERIES = {f.__name__: f for f in NAMES}

W = LATIN.words
_EVIDENCE = lambda x: rf"(regexp_matches({x}, '\d|%|（|\[|\(') OR {any_contains(x, W['evidence'])})"
_PATTERNS = {p: (role, t.id) for t in LATIN.terms for role, ps in (("standard", (t.term,)), ("variant", t.variants)) for p in ps}
_PATTERN_ROWS = ", ".join(f"({q(p)}, {q(role)}, {q(i)})" for p, (role, i) in sorted(_PATTERNS.items()))
_TERM_HITS = f"""pats AS (SELECT * FROM (VALUES {_PATTERN_ROWS}) v(pattern, role, term_id)),
docs AS (SELECT doc_id, {T} AS t FROM documents),
pos AS (SELECT doc_id, t, pattern, role, term_id, unnest(range(0, length(t) - length(pattern) + 1)) AS start FROM docs, pats WHERE contains(t, pattern)),
found AS (SELECT doc_id, start, start + length(pattern) AS "end", pattern, role, term_id, t FROM pos WHERE substr(t, start + 1, length(pattern)) = pattern)"""
_TERM_COLUMNS = {t.id: (t.severity, t.replaces or t.term, t.type) for t in LATIN.terms}
_TERM_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({q(i)}, {q(a)}, {q(b)}, {q(c)})" for i, (a, b, c) in _TERM_COLUMNS.items()) + ") v(term_id, severity, suggestion, type))"
_VARIANTS = f"""{_TERM_HITS}, {_TERM_DIM},
variants AS (SELECT doc_id, 'term-' || found.term_id AS rule_id, severity, CASE WHEN type = 'deprecated' THEN 'deprecated term' ELSE 'term variant' END AS message, start, "end", pattern AS original, suggestion, t FROM found JOIN dim USING (term_id) WHERE role = 'variant' AND pattern <> suggestion)"""
_NUMBER = academic.number_pattern(LATIN)
_FOUND = "(" + ", ".join(q(w) for w in W["absolute"]) + ")"
_LIST = lambda name: "list_filter([" + ", ".join(q(w) for w in W[name]) + "], lambda w: contains(text, w))"
_METRICS = ", ".join(f"({q(m)}, {lo}, {hi})" for m, lo, hi in LATIN.metrics)
_ANY = lambda name: "(?:" + "|".join(W[name]) + ")"
_PROFILE = f"""base AS (SELECT doc_id, {T} AS t, list_filter(list_transform(regexp_extract_all({T}, {q(parse.sentence_pattern(LATIN))}), lambda x: {strip("x")}), lambda x: length(x) >= 4) AS s, list_filter(string_split({T}, chr(10)), lambda x: {strip("x")} <> '') AS p FROM documents),
profile AS (SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x)))::DOUBLE / len(s), 0.0) AS mean_sentence, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS max_sentence,
  CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[$#%&*!|]'))::DOUBLE / length(t) ELSE 0.0 END AS symbol_density,
  CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, {q(_ANY("hedge"))}))::DOUBLE / length(t) ELSE 0.0 END AS hedge_density,
  CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: regexp_matches(x, '\\d')))::DOUBLE / len(p) ELSE 0.0 END AS data_ratio,
  CASE WHEN len(list_filter(p, lambda x: length(x) > 40)) > 0 THEN len(list_filter(p, lambda x: length(x) > 40 AND regexp_matches(substr(x, 1, 30), {q(_ANY("lead"))})))::DOUBLE / len(list_filter(p, lambda x: length(x) > 40)) ELSE 1.0 END AS lead_ratio,
  len(regexp_extract_all(t, {q(_ANY("europeanised"))}))::BIGINT AS europeanised FROM base)"""
_GAPS = f"""{_PROFILE}, long_form AS (SELECT doc_id, 'mean_sentence' AS metric, mean_sentence AS value FROM profile UNION ALL SELECT doc_id, 'symbol_density', symbol_density FROM profile UNION ALL SELECT doc_id, 'lead_ratio', lead_ratio FROM profile),
targets AS (SELECT * FROM (VALUES {_METRICS}) v(metric, lo, hi)),
gaps AS (SELECT doc_id, metric, value, lo::DOUBLE AS lo, hi::DOUBLE AS hi, CASE WHEN value < lo THEN 'low' ELSE 'high' END AS direction, abs(value - CASE WHEN value < lo THEN lo ELSE hi END) AS excess, CASE WHEN value < lo THEN lo ELSE hi END AS bound FROM long_form JOIN targets USING (metric) WHERE value < lo OR value > hi)"""

SQL = {
    "doc_meta": f"""SELECT doc_id, substr(md5({T}), 1, 12) AS doc_key, coalesce(substr({strip("regexp_replace(list_filter(string_split(" + T + ", chr(10)), lambda x: " + strip("x") + " <> '')[1], '^\\s*#+', '')")}, 1, 60), '') AS title,
  length(regexp_replace({T}, '\\s', '', 'g')) AS char_count, len(list_filter(string_split({T}, chr(10)), lambda x: {strip("x")} <> ''))::BIGINT AS n_paragraphs,
  len(list_filter(regexp_extract_all({T}, {q(parse.sentence_pattern(LATIN))}), lambda x: {strip("x")} <> ''))::BIGINT AS n_sentences FROM documents""",
    "paragraphs": f'WITH {LINES} SELECT doc_id, para_idx, line, start, "end", text, is_heading, in_ref FROM paras',
    "sentences": f'WITH {SEGMENTS} SELECT doc_id, sent_idx, start, "end", text FROM sents',
    "rule_positions": f"""WITH {LINES}, {hits(RULES)} SELECT h.doc_id, h.rule_id, h.start, h."end", coalesce(p.para_idx, -1) AS para_idx, len(regexp_extract_all(substr({T.replace("text", "d.text")}, 1, h.start), chr(10))) + 1 AS line,
  substr({T.replace("text", "d.text")}, greatest(h.start - 15, 0) + 1, h."end" + 15 - greatest(h.start - 15, 0)) AS around
  FROM hits h JOIN documents d USING (doc_id) LEFT JOIN paras p ON h.doc_id = p.doc_id AND h.start >= p.start AND h.start < p."end\"""",
    "hit_sentences": f'WITH {SEGMENTS}, {hits(RULES)} SELECT h.doc_id, h.rule_id, h.start, h."end", coalesce(s.sent_idx, -1) AS sent_idx FROM hits h LEFT JOIN sents s ON h.doc_id = s.doc_id AND h.start >= s.start AND h.start < s."end"',
    "quote_spans": f"""WITH m AS (SELECT doc_id, {T} AS t, unnest(range(0, length({T}))) AS p FROM documents WHERE contains({T}, '"')), s AS (SELECT doc_id, t, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM m WHERE substr(t, p + 1, 1) = '"'),
  pairs AS (SELECT doc_id, any_value(t) AS t, min(p) AS qs, max(p) + 1 AS qe, count(*) AS c FROM s GROUP BY doc_id, (n + 1) // 2)
  SELECT doc_id, qs, qe FROM pairs WHERE c = 2 AND NOT contains(substr(t, qs + 1, qe - qs), chr(10))""",
    "tokens_top": f"SELECT lower(token) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({T}, {q(TOKENS)})) AS token FROM documents) GROUP BY 1",
    "char_ngram_stats": rf"WITH c AS (SELECT item_id, regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, substr(t, unnest(range(1, greatest(length(t) - 1, 2))), 3) AS gram FROM c WHERE length(t) > 0) SELECT gram, count(*) AS n, count(DISTINCT item_id) AS n_items FROM g GROUP BY 1",
    "html_strip": r"""WITH h AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS a FROM pages), b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '&nbsp;|\x{a0}', ' ', 'g'), '\s{2,}', ' ', 'g') AS t FROM h) SELECT page_id, url, length(t) AS n_chars, md5(t) AS digest FROM b""",
    "exact_term_hits": f'WITH {_TERM_HITS} SELECT doc_id, start, "end", pattern, role, term_id FROM found',
    "term_variants": f'WITH {_VARIANTS} SELECT doc_id, rule_id, severity, message, start, "end", original, suggestion FROM variants',
    "semantic_nearest": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT * FROM v WHERE vec_id < 10),
  c AS (SELECT v.vec_id AS key, s.vec_id AS seed, list_dot_product(v.e, s.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(s.e, s.e)) AS score FROM v, s),
  b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, seed) AS n FROM c) SELECT key, seed, round(score, 6) AS score FROM b WHERE n = 1 AND score >= 0.3""",
    "banned_patterns": f"""WITH {hits(LATIN.banned)} SELECT rule_id || '#' || substr(md5(rule_id || '|' || start || '|' || "end"), 1, 10) AS issue_id, doc_id, CASE WHEN severity = 'FATAL' THEN 'political' ELSE 'language' END AS category, severity, rule_id, start, "end", original FROM hits""",
    "dict_rules": f'WITH {hits(LATIN.language)} SELECT doc_id, rule_id, severity, category, message, start, "end", original, suggestion, explain, confidence FROM hits',
    "long_sentences": f"""WITH {SEGMENTS} SELECT doc_id, start, "end" FROM sents WHERE length({strip("text")}) > 90 AND len(regexp_extract_all(text, '[,，、]')) >= 5 AND NOT starts_with({strip("text")}, '[')""",
    "overgeneralisation": f"""WITH {SEGMENTS}, w AS (SELECT *, string_agg(text, '') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS scope FROM sents) SELECT doc_id, sent_idx, start, "end" FROM w WHERE {any_contains("text", W["conclusion"])} AND {any_contains("text", W["universal"])} AND {any_contains("scope", W["local"])}""",
    "claims": f"WITH {LINES} SELECT doc_id, para_idx FROM paras WHERE NOT is_heading AND length({strip('text')}) >= 30 AND {any_contains('text', W['claim'])} AND NOT {_EVIDENCE('text')}",
    "causal_leap": f"""WITH {SEGMENTS}, w AS (SELECT *, coalesce(string_agg(text, '') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS prior, list_min(list_filter([{", ".join(f"instr(text, {q(x)})" for x in W["causal"])}], lambda i: i > 0)) AS place FROM sents)
  SELECT doc_id, sent_idx FROM w WHERE place IS NOT NULL AND NOT regexp_matches(substr(text, 1, place - 1), '[,，]') AND NOT regexp_matches(text, '\\d|%|（|\\[|\\(') AND NOT regexp_matches(prior, '\\d|%|（|\\[|\\(') AND length({strip("prior")}) >= 10""",
    "absolute_terms": f"""WITH {SEGMENTS}, w AS (SELECT *, {strip("text")} AS body, {_LIST("absolute")} AS found, regexp_matches(text, '\\d|%|（|\\[|\\(') AS proof FROM sents), x AS (SELECT *, list_filter(found, lambda f: f IN ({", ".join(q(h) for h in W["hard"])})) AS hard FROM w WHERE len(found) > 0 AND len(list_filter(found, lambda f: starts_with(body, f) AND regexp_matches(substr(body, 1, length(f) + 6), '[,，]'))) = 0),
  y AS (SELECT *, CASE WHEN len(hard) >= 2 OR (len(hard) = 1 AND NOT proof) THEN 'MAJOR' WHEN len(hard) = 1 THEN 'MINOR' WHEN NOT proof THEN 'INFO' END AS severity, CASE WHEN len(hard) > 0 THEN hard ELSE found END AS used FROM x)
  SELECT doc_id, sent_idx, start + list_min(list_transform(used, lambda f: instr(text, f))) - 1 AS start, start + list_max(list_transform(used, lambda f: instr(text, f) + length(f))) - 1 AS "end", array_to_string(used, ',') AS terms, len(hard)::BIGINT AS n_hard, severity FROM y WHERE severity IS NOT NULL""",
    "intensity_conflict": f"""WITH {SEGMENTS} SELECT doc_id, sent_idx, array_to_string({_LIST("absolute")}, ',') AS strong, array_to_string({_LIST("hedge")}, ',') AS weak FROM sents WHERE len({_LIST("absolute")}) > 0 AND len({_LIST("hedge")}) > 0""",
    "vague_reference": f"""WITH {SEGMENTS}, w AS (SELECT *, coalesce(string_agg(text, '') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS prior, regexp_extract({strip("text")}, {q("^" + _ANY("vague"))}) AS word FROM sents) SELECT doc_id, sent_idx, word FROM w WHERE word <> '' AND NOT {any_contains("prior", W["noun"])}""",
    "quantifier_conflict": f"""WITH {SEGMENTS}, w AS (SELECT *, list_max(list_transform(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)%', 1), lambda x: x::DOUBLE)) AS top FROM sents), r AS (SELECT * FROM (VALUES {", ".join(f"({q(a)}, {lo}, {hi})" for a, lo, hi, _ in LATIN.quantifiers)}) v(word, lo, hi)) SELECT doc_id, sent_idx, top, word FROM w, r WHERE top IS NOT NULL AND contains(text, word) AND (top < lo OR top > hi)""",
    "claim_sentences": f"WITH {SEGMENTS} SELECT doc_id, sent_idx FROM sents WHERE length({strip('text')}) >= 18 AND {any_contains('text', W['claim'])}",
    "vague_comparisons": f"WITH {SEGMENTS}, w AS (SELECT doc_id, sent_idx, regexp_extract(text, {q(academic.comparison_pattern())}) AS phrase FROM sents) SELECT doc_id, sent_idx, phrase FROM w WHERE phrase <> '' AND NOT regexp_matches(phrase, '[0-9]')",
    "number_facts": f"""WITH m AS (SELECT doc_id, regexp_extract_all({T}, {q(_NUMBER)}) AS h, regexp_split_to_array({T}, {q(_NUMBER)}) AS g FROM documents WHERE regexp_matches({T}, '\\d')),
  f AS (SELECT doc_id, h[i] AS x, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i-1], lambda v: length(v))), 0) AS start FROM (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM m)),
  n AS (SELECT doc_id, trim(regexp_replace(regexp_extract(x, {q(_NUMBER)}, 1), '(?i)^(?:(?:the|a|an|of|and|is|was|were)\\b|为|达|约|共)\\s*', '')) AS label, regexp_extract(x, {q(_NUMBER)}, 2) AS raw, regexp_extract(x, {q(_NUMBER)}, 3) AS unit, start::BIGINT AS start, (start + length(x))::BIGINT AS "end" FROM f)
  SELECT doc_id, label, replace(raw, ',', '')::DOUBLE AS value, unit, start, "end" FROM n WHERE NOT (regexp_full_match(raw, '\\d{{4}}') AND unit = '' AND raw::DOUBLE BETWEEN 1900 AND 2100)""",
    "style_plan": f"""WITH {_GAPS} SELECT doc_id, string_agg(CASE metric || '/' || direction WHEN 'mean_sentence/high' THEN 'split sentences' WHEN 'mean_sentence/low' THEN 'join sentences' WHEN 'symbol_density/high' THEN 'drop symbols' WHEN 'lead_ratio/low' THEN 'open paragraphs with their point' ELSE 'adjust ' || metric END || ' (' || format('{{:,.2f}}', value) || ')', '; ' ORDER BY metric) AS plan FROM gaps GROUP BY 1""",
    "style_profile": f"WITH {_PROFILE} SELECT doc_id, n_sentences, round(mean_sentence, 6) AS mean_sentence, max_sentence, round(symbol_density, 9) AS symbol_density, round(hedge_density, 9) AS hedge_density, round(data_ratio, 9) AS data_ratio, round(lead_ratio, 9) AS lead_ratio, europeanised FROM profile",
    "metric_gap": f"WITH {_GAPS} SELECT doc_id, metric, round(value, 9) AS value, direction, round(excess, 9) AS excess, CASE WHEN excess > 0.3 * abs(bound) THEN 'MINOR' ELSE 'INFO' END AS severity FROM gaps",
    "style_score": f"WITH {_GAPS}, l AS (SELECT doc_id, sum(least(12.0, 12.0 * excess / greatest(hi - lo, 1e-9))) AS lost FROM gaps GROUP BY 1) SELECT doc_id, round(greatest(0.0, 100.0 - coalesce(lost, 0.0)), 6) AS style_score FROM profile LEFT JOIN l USING (doc_id)",
    "intake_routes": f"""WITH p AS (SELECT doc_id, {T} AS t, length({T}) AS n_chars, CASE WHEN length({T}) > 0 THEN len(regexp_extract_all({T}, '\\d'))::DOUBLE / length({T}) ELSE 0.0 END AS dd, len(regexp_extract_all({T}, '\\[\\d{{1,3}}\\]'))::BIGINT AS n_refs FROM documents), a AS (SELECT *, n_refs >= 2 OR regexp_matches(t, {q(LATIN.reference_head)}) AS ac FROM p)
  SELECT doc_id, n_chars, round(dd, 9) AS digit_density, n_refs, ac AS is_academic, CASE WHEN ac THEN 'paper' WHEN dd > 0.05 THEN 'report' WHEN n_chars < 400 THEN 'note' ELSE 'article' END AS doc_type, true AS run_term, true AS run_norm, n_chars >= 40 AS run_logic, ac OR dd > 0 AS run_academic, n_chars >= 100 AS run_style FROM a""",
}
