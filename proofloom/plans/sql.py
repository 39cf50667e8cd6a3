"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from proofloom.operators.parse import sentence_pattern
from proofloom.rules import LATIN

T = "coalesce(text, '')"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")" if words else "false"


LINES = f"""lines AS (SELECT doc_id, unnest(string_split({T}, chr(10))) AS text, generate_subscripts(string_split({T}, chr(10)), 1) AS line FROM documents),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines),
paras0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS para_idx, line, start, start + length(text) AS "end", text,
  regexp_matches(text, {q(LATIN.heading)}) AND length({strip("text")}) < 60 AS is_heading,
  regexp_matches(text, {q(LATIN.reference_head)}) AND length({strip("text")}) < 60 AS is_head FROM placed WHERE {strip("text")} <> ''),
paras AS (SELECT doc_id, para_idx, line, start, "end", text, is_heading, coalesce(bool_or(is_head) OVER (PARTITION BY doc_id ORDER BY line), false) AS in_ref FROM paras0)"""

SEGMENTS = f"""segs AS (SELECT doc_id, unnest(regexp_extract_all({T}, {q(sentence_pattern(LATIN))})) AS text, generate_subscripts(regexp_extract_all({T}, {q(sentence_pattern(LATIN))}), 1) AS i FROM documents),
cut AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM segs),
sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent_idx, start, start + length(text) AS "end", text FROM cut WHERE {strip("text")} <> '')"""


def hits(rules) -> str:
    """CTE hits: doc_id, rule_id, severity, category, message, start, end, original, suggestion, explain, confidence."""
    parts = []
    for r in rules:
        replaced = "''" if r.replacement is None else f"regexp_replace(o, {q(r.pattern)}, {q(r.replacement.replace('$', chr(92)))}, 'g')"
        parts.append(f"""SELECT doc_id, {q(r.id)} AS rule_id, {q(r.severity)} AS severity, {q(r.category)} AS category, {q(r.message)} AS message,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::BIGINT AS start, o AS original, {replaced} AS suggestion, {q(r.advice)} AS explain, {r.confidence}::DOUBLE AS confidence
  FROM (SELECT doc_id, h, g, unnest(h) AS o, generate_subscripts(h, 1) AS i FROM (SELECT doc_id, regexp_extract_all({T}, {q(r.pattern)}) AS h, regexp_split_to_array({T}, {q(r.pattern)}) AS g FROM documents WHERE regexp_matches({T}, {q(r.pattern)})))""")
    return "hits AS (SELECT *, start + length(original) AS \"end\" FROM (" + "\nUNION ALL ".join(parts) + "))"


def issues(rules, engine: str) -> str:
    """CTE issues over hits, with the columns of the fact table."""
    return hits(rules) + f""",
issues AS (SELECT rule_id || '#' || substr(md5(rule_id || '|' || start || '|' || "end"), 1, 10) AS issue_id, doc_id, {q(engine)} AS engine, category, severity, rule_id, message, start, "end", original, suggestion, explain, 'rule' AS source, confidence FROM hits)"""


WEIGHT = "CASE severity WHEN 'FATAL' THEN 100 WHEN 'MAJOR' THEN 20 WHEN 'MINOR' THEN 5 ELSE 1 END"
PENALTY = "CASE severity WHEN 'FATAL' THEN 100.0 WHEN 'MAJOR' THEN 20.0 WHEN 'MINOR' THEN 5.0 ELSE 0.5 END"
TOKENS = r"[\x{4e00}-\x{9fff}]+|[\p{L}]+|\d+(?:\.\d+)?%?"
