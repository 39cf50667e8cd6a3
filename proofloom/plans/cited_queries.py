"""Queries over documents with reference sections of several kinds, and over what single steps of the engines make of documents:
splits, spans, previews, reviews, judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.operators import academic, norm, parse, resolve, style, terms
from proofloom.plans.sql import LINES, WEIGHT, T, any_contains, issues, q, strip
from proofloom.plans.text_queries import _TERM_HITS, _VARIANTS, RULES, docs
from proofloom.rules import LATIN, term_rows
from proofloom.schema import make_issues

LAST_YEAR = 2030
SECTIONS = ("License", "Copyright", "Usage", "the")

#: What is put behind the text of a document, by the remainder of its id: two items, an empty section, two styles of citing, Chinese
#: items, one item without a section, nothing.
TAILS = (
    "\nReferences\n[1] Ames A. Trade[J]. Acta, 2010: 1-2.\n[2] Orr B, Poe C, Lee D, Kim E. Rates[M]. Bern: Hill, 2031: 3–9.",
    "\nReferences\n",
    "\nas (Smith, 2001) has it, and as [2] and [1] say",
    "\nBibliography\n[3] 王明，李一，张二，赵三. 题[M]. 上海：某社，2010. doi: 11.5/x\n[4] 王明，李一，张二，等. 题[XY]. 12010. doi:10.5555/ok",
    "\n[1] one item alone",
    "",
)


def cited(s: SparkSession, d: str) -> DataFrame:
    """doc_id, text: documents with the tails; each 24th text is null."""
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.pmod("doc_id", F.lit(len(TAILS))) + 1).cast("int"))
    return docs(s, d).select("doc_id", F.when(F.col("doc_id") % 24 != 5, F.concat(parse.TEXT(), tail)).alias("text"))


def _issues(s, d):
    return make_issues(norm.rule_hits(docs(s, d), RULES), "norm")


def cited_split(s, d):
    """Where the references of a text begin, and what lies before and behind."""
    rows = parse.reference_start(cited(s, d)).withColumn("text", parse.TEXT())
    last = F.length("text") - 1
    return rows.select("doc_id", "ref_start", F.length(parse.body_text(F.col("text"), F.col("ref_start"))).alias("n_body"), F.md5(parse.reference_text(F.col("text"), F.col("ref_start"))).alias("digest"), parse.in_reference_section(last, F.col("ref_start")).alias("ends_in_refs"))


def cited_gaps(s, d):
    """Documents with an empty reference section, or with two styles of citing."""
    t = cited(s, d)
    empty = academic.empty_reference_sections(t).withColumn("finding", F.lit("empty-section"))
    return empty.unionByName(academic.mixed_citation_styles(t).withColumn("finding", F.lit("mixed-styles")))


def cited_faults(s, d):
    """Faults of the items: kinds, years, pages, authors, DOIs (A17-A21), in Latin and Chinese, with items that have none."""
    return academic.reference_issues(parse.references(cited(s, d)), LAST_YEAR)


def cited_places(s, d):
    """Numbers cited in the body, at their first place."""
    return parse.citations(cited(s, d))


def required_sections(s, d):
    """Sections that a document must have and lacks."""
    return style.missing_sections(docs(s, d), SECTIONS)


def lead_paragraphs(s, d):
    """Long paragraphs and whether their point leads them."""
    return style.lead_paragraphs(docs(s, d))


def shared_spans(s, d):
    """The longest block that two texts share, by place in the first."""
    p = s.read.parquet(f"{d}/part.parquet").withColumn("x", terms.best_span(F.col("p_name"), F.lower("p_type")))
    return p.select("p_partkey", "x.start", "x.end")


def fill_previews(s, d):
    """Surroundings of term variants with the standard term filled in."""
    t = docs(s, d)
    found = terms.exact_issues(terms.exact_hits(t, term_rows(s, LATIN))).select("doc_id", "start", "end", "suggestion")
    rows = found.join(t.select("doc_id", parse.TEXT().alias("t")), "doc_id")
    return rows.select("doc_id", "start", "end", terms.preview(F.col("t"), F.col("start"), F.col("end"), F.col("suggestion")).alias("preview"))


def annotated_issues(s, d):
    """Issues with line, paragraph and what their span covers."""
    out = resolve.annotate(_issues(s, d), docs(s, d), parse.paragraph_array(parse.TEXT()))
    return out.select("doc_id", "rule_id", "start", "end", "line", "paragraph", "original", "sentence")


def critic_rounds(s, d):
    """What two rounds of the critic leave of each document, by severity."""
    held = _issues(s, d).groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in _issues(s, d).columns if c != "doc_id"])).alias("items"))
    rows = docs(s, d).join(held, "doc_id").select("doc_id", F.explode(resolve.critic_array(F.col("items"), parse.TEXT())).alias("x"))
    return rows.groupBy("doc_id", F.col("x.severity").alias("severity")).agg(F.count("*").alias("n"), F.sum("x.start").alias("starts"))


def judged_issues(s, d):
    """Issues after the verdicts of a judge that refuses what starts at an odd place; verdicts on what was not asked count
    nothing (O10)."""
    found = _issues(s, d)
    verdicts = found.select("doc_id", "issue_id", (F.col("start") % 2 == 0).alias("accept"), F.lit("odd").alias("note"))
    return resolve.apply_verdicts(found, verdicts).select("doc_id", "issue_id", "severity", "refused")


NAMES = [cited_split, cited_gaps, cited_faults, cited_places, required_sections, lead_paragraphs, shared_spans, fill_previews, annotated_issues, critic_rounds, judged_issues]
QUERIES = {f.__name__: f for f in NAMES}

_TAIL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {q(t).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}" for i, t in enumerate(TAILS)) + " END"
_CITED = f"""documents AS (SELECT doc_id, CASE WHEN doc_id % 24 <> 5 THEN {T} || ({_TAIL}) END AS text FROM documents), {LINES},
numbered AS (SELECT doc_id, start, "end", {strip("text")} AS text, in_ref, regexp_extract(text, '^\\s*\\[(\\d{{1,4}})\\]', 1) AS num FROM paras),
held AS (SELECT doc_id, bool_or(in_ref) AS any_ref, count(*) AS n FROM numbered WHERE num <> '' GROUP BY 1),
kept AS (SELECT x.*, row_number() OVER (PARTITION BY x.doc_id, num::INT ORDER BY start DESC) AS nth FROM numbered x JOIN held USING (doc_id) WHERE num <> '' AND CASE WHEN any_ref THEN in_ref ELSE n >= 2 END),
items AS (SELECT doc_id, num::INT AS num, start, text FROM kept WHERE nth = 1),
split AS (SELECT d.doc_id, {T} AS t, coalesce(min(start), -1) AS ref_start FROM documents d LEFT JOIN (SELECT doc_id, start FROM items) i ON d.doc_id = i.doc_id GROUP BY d.doc_id, d.text)"""
_CODES = "(" + ", ".join(q(c) for c in academic.TYPE_CODES) + ")"
_CARRIERS = "(" + ", ".join(q(c) for c in academic.CARRIERS) + ")"
_ISSUES = issues(RULES, "norm")

SQL = {
    "cited_split": f"WITH {_CITED} SELECT doc_id, ref_start, CASE WHEN ref_start >= 0 THEN ref_start ELSE length(t) END AS n_body, md5(CASE WHEN ref_start >= 0 THEN substr(t, ref_start + 1) ELSE '' END) AS digest, ref_start >= 0 AND length(t) - 1 >= ref_start AS ends_in_refs FROM split",
    "cited_gaps": f"""WITH {_CITED} SELECT doc_id, 'empty-section' AS finding FROM paras GROUP BY 1 HAVING bool_or(in_ref) AND doc_id NOT IN (SELECT doc_id FROM items)
  UNION ALL SELECT doc_id, 'mixed-styles' FROM documents WHERE regexp_matches({T}, '\\[\\d{{1,3}}\\]') AND regexp_matches({T}, '[(（](?:\\p{{L}}[\\p{{L}} .&]{{1,40}}[,，]\\s*(?:19|20)\\d{{2}}|\\d{{1,3}})[)）]')""",
    "cited_faults": f"""WITH {_CITED}, f AS (SELECT doc_id, num, text, regexp_extract(text, '\\[([A-Z]{{1,2}}(?:/[A-Z]{{2}})?)\\]', 1) AS code, regexp_extract(text, '^\\s*\\[\\d+\\]\\s*([^.。]*)', 1) AS authors, regexp_extract(text, '(?i)doi:?\\s*(\\S+)', 1) AS doi,
  list_filter(regexp_extract_all(text, '\\d+'), lambda y: regexp_full_match(y, '(?:1[5-9]|20|21)\\d\\d')) AS years FROM items)
  SELECT doc_id, num, 'type-code' AS "check" FROM f WHERE code = '' OR string_split(code, '/')[1] NOT IN {_CODES} OR (contains(code, '/') AND string_split(code, '/')[2] NOT IN {_CARRIERS})
  UNION ALL SELECT doc_id, num, 'year' FROM f WHERE list_max(list_transform(years, lambda y: y::INT)) > {LAST_YEAR}
  UNION ALL SELECT doc_id, num, 'pages' FROM f WHERE regexp_matches(text, '\\d\\s*[–—~～]\\s*\\d')
  UNION ALL SELECT doc_id, num, 'authors' FROM f WHERE len(regexp_extract_all(authors, '[,，]')) >= 3 AND NOT regexp_matches(text, '(?i)et al|等')
  UNION ALL SELECT doc_id, num, 'doi' FROM f WHERE doi <> '' AND NOT regexp_matches(doi, '^10\\.\\d{{4,9}}/\\S+')""",
    "cited_places": f"""WITH {_CITED}, b AS (SELECT doc_id, CASE WHEN ref_start >= 0 THEN substr(t, 1, ref_start) ELSE t END AS b FROM split), m AS (SELECT doc_id, regexp_extract_all(b, '\\[\\d{{1,4}}\\]') AS h, regexp_split_to_array(b, '\\[\\d{{1,4}}\\]') AS g FROM b WHERE regexp_matches(b, '\\[\\d{{1,4}}\\]')),
  p AS (SELECT doc_id, regexp_extract(h[i], '\\d+')::INT AS num, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i-1], lambda v: length(v))), 0) AS pos FROM (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM m))
  SELECT doc_id, num, min(pos)::BIGINT AS pos FROM p GROUP BY 1, 2""",
    "required_sections": f"SELECT doc_id, section FROM documents, (SELECT unnest([{', '.join(q(x) for x in SECTIONS)}]) AS section) WHERE NOT contains({T}, section)",
    "lead_paragraphs": f"WITH {LINES} SELECT doc_id, para_idx, {any_contains('substr(text, 1, 30)', LATIN.words['lead'])} AS leads FROM paras WHERE length(text) > 40",
    "shared_spans": """WITH p AS (SELECT p_partkey, p_name AS s, lower(p_type) AS t FROM part), b AS (SELECT *, CASE WHEN length(t) >= 3 THEN list_filter(flatten(list_transform(range(length(t), 2, -1), lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n)))), lambda x: contains(s, x))[1] END AS f FROM p)
  SELECT p_partkey, CASE WHEN f IS NULL THEN 0 ELSE instr(s, f) - 1 END AS start, CASE WHEN f IS NULL THEN least(length(s), greatest(6, length(t))) ELSE instr(s, f) - 1 + length(f) END AS "end" FROM b""",
    "fill_previews": f"""WITH {_VARIANTS} SELECT doc_id, start, "end", substr(substr(t, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)) || suggestion || substr(t, "end" + 1, 80), 1, 120) AS preview FROM variants""",
    "annotated_issues": f"""WITH {LINES}, {_ISSUES} SELECT h.doc_id, h.rule_id, h.start, h."end", len(regexp_extract_all(substr({T.replace("text", "d.text")}, 1, h.start), chr(10))) + 1 AS line, greatest(coalesce(p.para_idx, 0), 0) AS paragraph, substr({T.replace("text", "d.text")}, h.start + 1, h."end" - h.start) AS original, '' AS sentence
  FROM issues h JOIN documents d USING (doc_id) LEFT JOIN paras p ON h.doc_id = p.doc_id AND h.start >= p.start AND h.start < p."end\"""",
    "critic_rounds": f"""WITH {_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY {WEIGHT} DESC, confidence DESC, length(suggestion) DESC) AS nth FROM issues WHERE NOT (suggestion <> '' AND suggestion = original)),
  c AS (SELECT *, bool_or(severity IN ('FATAL', 'MAJOR')) OVER (PARTITION BY doc_id) AS grave FROM r WHERE nth = 1) SELECT doc_id, severity, count(*) AS n, sum(start)::BIGINT AS starts FROM c WHERE NOT grave OR severity IN ('FATAL', 'MAJOR') OR confidence >= 0.6 GROUP BY 1, 2""",
    "judged_issues": f"""WITH {_ISSUES}, r AS (SELECT *, severity IN ('FATAL', 'MAJOR') AND row_number() OVER (PARTITION BY doc_id, severity IN ('FATAL', 'MAJOR') ORDER BY {WEIGHT} DESC, confidence DESC, issue_id) <= 12 AND start % 2 = 1 AS refused FROM issues)
  SELECT doc_id, issue_id, CASE WHEN refused THEN 'INFO' ELSE severity END AS severity, refused FROM r""",
}

# what queries over documents and issues find, told once more in SQL
_QUOTES = """marks AS (SELECT doc_id, t, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM (SELECT doc_id, t, unnest(range(0, length(t))) AS p FROM docs WHERE contains(t, '"')) WHERE substr(t, p + 1, 1) = '"'),
quoted AS (SELECT doc_id, min(p) AS qs, max(p) + 1 AS qe FROM marks GROUP BY doc_id, (n + 1) // 2 HAVING count(*) = 2 AND NOT contains(substr(any_value(t), min(p) + 1, max(p) + 1 - min(p)), chr(10)))"""
_NEGATED = parse.any_of(LATIN.negation) + r"[^.,;:!?。，；：！？\n]{0,6}$"
SQL["suppressed_terms"] = f"""WITH {_VARIANTS}, {LINES}, {_QUOTES}, heads AS (SELECT doc_id, min(start) AS ref_from FROM paras WHERE in_ref GROUP BY 1)
SELECT v.doc_id, rule_id, start, "end", CASE WHEN EXISTS (SELECT 1 FROM quoted k WHERE k.doc_id = v.doc_id AND k.qs <= v.start AND v.start < k.qe AND k.qe - k.qs >= 20) THEN 'long-quote'
  WHEN regexp_matches(substr(t, greatest(start - 8, 0) + 1, least(start, 8)), {q(_NEGATED)}) THEN 'negated' WHEN start >= ref_from THEN 'reference' ELSE '' END AS suppressed FROM variants v LEFT JOIN heads USING (doc_id)"""

_ORDERED = next(t for t in LATIN.terms if t.type == "ordering")
_LISTED = "[" + ", ".join(q(w) for w in _ORDERED.order) + "]"
_SEPARATED = parse.any_of(_ORDERED.order) + "([、，,; ]{1,2})" + parse.any_of(_ORDERED.order)
SQL["ordering_violations"] = f"""WITH m AS (SELECT doc_id, regexp_extract_all({T}, {q(_ORDERED.segment)}) AS h, regexp_split_to_array({T}, {q(_ORDERED.segment)}) AS g FROM documents WHERE regexp_matches({T}, {q(_ORDERED.segment)})),
s AS (SELECT doc_id, h[i] AS x, (list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i-1], lambda v: length(v))), 0))::BIGINT AS start FROM (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM m)),
p AS (SELECT *, list_transform(list_sort(list_filter(list_transform({_LISTED}, lambda w: {{'i': instr(x, w), 'w': w}}), lambda k: k.i > 0)), lambda k: k.w) AS present FROM s),
e AS (SELECT *, list_filter({_LISTED}, lambda w: list_contains(present, w)) AS expected, coalesce(nullif(regexp_extract(x, {q(_SEPARATED)}, 1), ''), ', ') AS sep FROM p WHERE len(present) >= 2),
k AS (SELECT *, CASE WHEN len(present) < {len(_ORDERED.order)} THEN 'incomplete' WHEN present <> expected THEN 'order' END AS kind FROM e)
SELECT doc_id, {q(_ORDERED.id)} AS rule_id, start, start + length(x) AS "end", x AS original, kind, CASE WHEN kind = 'order' THEN list_filter(range(1, len(present) + 1), lambda i: present[i] <> expected[i])[1] - 1 ELSE -1 END AS first_wrong,
  list_reduce(CASE WHEN kind = 'order' THEN expected ELSE {_LISTED} END, lambda a, b: a || sep || b) AS suggestion, {q(_ORDERED.severity)} AS severity FROM k WHERE kind IS NOT NULL"""

SQL["issue_overlap_resolved"] = f"""WITH RECURSIVE {_ISSUES}, o AS MATERIALIZED (SELECT doc_id, rule_id, start, "end", row_number() OVER (PARTITION BY doc_id ORDER BY {WEIGHT} DESC, start - "end", rule_id, start, message) AS n FROM issues),
r AS (SELECT doc_id, n, [{{'s': start, 'e': "end"}}] AS kept, true AS taken, rule_id, start, "end" FROM o WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN taken THEN list_append(kept, {{'s': start, 'e': "end"}}) ELSE kept END, taken, rule_id, start, "end"
  FROM (SELECT o.doc_id, o.n, kept, o.rule_id, o.start, o."end", len(list_filter(kept, lambda k: k.s < o."end" AND o.start < k.e)) = 0 AS taken FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1))
SELECT doc_id, rule_id, start, "end" FROM r WHERE taken"""

_ESCAPED = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
SQL["highlighted"] = f"""WITH RECURSIVE {_ISSUES}, o AS MATERIALIZED (SELECT doc_id, start, "end", severity, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, severity, rule_id) AS n FROM issues WHERE "end" > start),
r AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS was, 0::BIGINT AS cur, 0::BIGINT AS start, '' AS severity FROM documents
  UNION ALL SELECT r.doc_id, o.n, cur, CASE WHEN o.start < cur THEN cur ELSE o."end" END, o.start, o.severity FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1),
p AS (SELECT doc_id, n, {_ESCAPED(f"substr({T}, was + 1, start - was)")} || '<mark class="' || lower(severity) || '">' || {_ESCAPED(f"substr({T}, start + 1, cur - start)")} || '</mark>' AS piece FROM r JOIN documents USING (doc_id) WHERE cur > was AND start >= was),
m AS (SELECT doc_id, string_agg(piece, '' ORDER BY n) AS made FROM p GROUP BY 1), c AS (SELECT doc_id, max(cur) AS cur FROM r GROUP BY 1),
w AS (SELECT doc_id, coalesce(made, '') || {_ESCAPED(f"substr({T}, cur + 1)")} AS html FROM c JOIN documents USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, length(html) AS n_chars, md5(html) AS digest FROM w"""

_SURFACES = ", ".join(sorted({f"({q(r['pattern'])}, {q(r['term_id'])})" for r in terms.pattern_rows(LATIN) if len(r["pattern"]) >= 8}))
_STANDARDS = "[" + ", ".join(q(w) for w in sorted({t.term for t in LATIN.terms})) + "]"
SQL["fuzzy_term_hits"] = f"""WITH {_TERM_HITS}, surf AS (SELECT * FROM (VALUES {_SURFACES}) v(surface, term_id)),
pieces AS (SELECT doc_id, base, substr(t, base + 1, 232) AS piece FROM (SELECT doc_id, t, unnest(range(0, length(t), 200)) AS base FROM docs)),
w AS (SELECT doc_id, base + p AS start, surface, term_id, substr(piece, p + 1, length(surface)) AS "window" FROM (SELECT doc_id, base, piece, surface, term_id, unnest(range(0, least(200, length(piece) - length(surface) + 1))) AS p FROM pieces, surf)),
c AS (SELECT *, levenshtein("window", surface) AS distance FROM w WHERE "window" <> surface),
n AS (SELECT * FROM c WHERE distance <= 2 AND 1 - distance / length(surface) >= 0.86 AND len(list_filter(range(1, length(surface)), lambda i: substr("window", i, 2) = substr(surface, i, 2))) > 0
  AND len(list_filter({_STANDARDS}, lambda x: x = "window" OR (length(x) >= 6 AND contains("window", x)))) = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, length(surface) ORDER BY distance, surface) AS nth FROM n WHERE (doc_id, start) NOT IN (SELECT doc_id, start FROM found))
SELECT doc_id, start, start + length(surface) AS "end", "window", surface, term_id, distance FROM b WHERE nth = 1"""
