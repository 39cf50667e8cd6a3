"""Rule packs from files (S07, S08): terms, banned patterns, a local ledger, word lists, style targets, reference codes.

A file is YAML (if the yaml module is there) or JSON; a missing one leaves what the base pack has. Formats:

terms, ledger   entries: [{id, term, type, severity, tags, variants, order, pattern, semantic_seeds, explain, source, confidence, replaces}]
banned          rules: [{id, pattern, severity, category, message, suggestion, allow_context}]
resources       logic: {list of words by name, quantity_claim_map: {word: {min_ratio, max_ratio, advice}}},
                language: {group: [{pattern, fix, severity, halfwidth_only}]},
                style: {presets: {name: {avoid, ...}}, metrics: [{name, target: {preset: [lo, hi]}}]}
references      known_publishers: [name]
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from dataclasses import fields, replace

from pyspark.sql import DataFrame

from proofloom.rules import ZH, Pack, Rule, Term

#: Names of word lists, of markers and of metrics in files, and the pack's names for them.
WORD_LISTS = {"absolute_claims": "absolute", "hedges": "hedge", "causal_connectives": "causal", "vague_reference": "vague"}
MARKERS = {"claim": "claim", "evidence": "evidence"}
METRICS = {"平均句长": "mean_sentence", "口语词密度": "colloquial_density", "绝对化词密度": "absolute_density", "数据标注率": "data_ratio"}


def read_data(path: str | None) -> dict:
    """The mapping in a YAML or JSON file; {} if there is none."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError(f"{path}: the yaml module is not installed; use JSON") from e
    return yaml.safe_load(text) or {}


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return bool(pattern)


def term_of(row: Mapping) -> Term:
    """A term of a row of a file or table; fields that are missing or null get defaults."""
    given = {k: row.get(k) for k in ("id", "term", "type", "severity", "source", "replaces", "explain", "confidence", "priority", "version") if row.get(k) is not None}
    lists = {k: tuple(row.get(k) or ()) for k in ("variants", "order", "tags")}
    return Term(**({"id": "", "term": "", "severity": "MINOR", "confidence": 1.0} | given | lists), segment=row.get("pattern") or row.get("segment") or "", seeds=tuple(row.get("semantic_seeds") or row.get("seeds") or ()))


def banned_of(row: Mapping) -> Rule:
    return Rule(row.get("id") or "", row.get("pattern") or "", row.get("severity") or "MINOR", "language", row.get("message") or "", None, row.get("suggestion") or "", 0.9, tuple(row.get("allow_context") or ()))


def language_rules(groups: Mapping) -> list[Rule]:
    """Rules of {group: [row]}; a fix with a group of the pattern is a replacement, another one advice that replaces the whole
    match if it has no space or punctuation. Patterns that don't compile are left out."""
    out = []
    for group, rows in groups.items():
        for n, row in enumerate(rows if isinstance(rows, list) else ()):
            fix, pattern = row.get("fix") or "", row.get("pattern") or ""
            if not compiles(pattern):
                continue
            template = re.sub(r"\\g<(\w+)>|\\(\d)", lambda m: "${" + m[1] + "}" if m[1] and not m[1].isdigit() else "$" + (m[1] or m[2]), fix)
            whole = template != fix or re.fullmatch(r"\w+", fix) is not None
            if row.get("halfwidth_only"):
                pattern = rf"(?=\S*[\x00-\x7f])(?:{pattern})"
            out.append(Rule(f"lang-{group}-{n:03d}", pattern, row.get("severity") or "MINOR", "language", "" if whole else fix, template if whole and fix else None, "" if whole else fix, 0.9))
    return out


def load_pack(terms: str | None = None, banned: str | None = None, ledger: str | None = None, resources: str | None = None, references: str | None = None, base: Pack = ZH, preset: str | None = None, name: str = "files") -> Pack:
    """base with what the files hold. A term of the ledger wins over one of equal id, and its patterns over others."""
    core = {t.id: t for t in map(term_of, read_data(terms).get("entries") or ())}
    own = {t.id: replace(t, priority=t.priority + 1) for t in map(term_of, read_data(ledger).get("entries") or ())}
    found = tuple((core | own).values())
    rules = tuple(r for r in map(banned_of, read_data(banned).get("rules") or ()) if compiles(r.pattern))
    data = read_data(resources)
    logic, style = data.get("logic") or {}, data.get("style") or {}
    words = dict(base.words)
    words |= {ours: tuple(logic[theirs]) for theirs, ours in WORD_LISTS.items() if logic.get(theirs)}
    marks = logic.get("argument_markers") or {}
    words |= {ours: tuple(marks[theirs]) for theirs, ours in MARKERS.items() if marks.get(theirs)}
    chosen = (style.get("presets") or {}).get(preset) or {}
    if chosen.get("avoid"):
        words["avoid"] = tuple(chosen["avoid"])
    percent = lambda x, other: other if x is None else 100.0 * x
    quantities = tuple((w, percent(x.get("min_ratio"), 0.0), percent(x.get("max_ratio"), 100.0), x.get("advice") or "") for w, x in (logic.get("quantity_claim_map") or {}).items())
    targets = tuple((METRICS.get(m["name"], m["name"]), *map(float, m["target"][preset])) for m in style.get("metrics") or () if preset in (m.get("target") or {}))
    known = {"terms": found, "banned": rules, "language": tuple(language_rules(data.get("language") or {})), "quantifiers": quantities, "metrics": targets, "publishers": tuple(read_data(references).get("known_publishers") or ())}
    return replace(base, name=name, words=words, **{k: v for k, v in known.items() if v})


def pack_of_tables(base: Pack, terms: DataFrame | None = None, banned: DataFrame | None = None, limit: int = 50_000) -> Pack:
    """base with the rows of rule tables (`readers.rule_table`), which come to the driver: at most `limit` of each."""

    def rows(df: DataFrame | None) -> Iterable[dict]:
        got = [] if df is None else [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
        if len(got) > limit:
            raise ValueError(f"a rule table has over {limit} rows")
        return got

    found, rules = tuple(map(term_of, rows(terms))), tuple(r for r in map(banned_of, rows(banned)) if compiles(r.pattern))
    return replace(base, **({"terms": found} if found else {}), **({"banned": rules} if rules else {}))


class TermSet:
    """A pack's terms by kind and id."""

    def __init__(self, pack: Pack):
        self.pack, self.by_id = pack, {t.id: t for t in pack.terms}

    def semantic(self) -> list[Term]:
        return [t for t in self.pack.terms if t.type == "semantic" and t.seeds]

    def ordering(self) -> list[Term]:
        return [t for t in self.pack.terms if t.type == "ordering"]

    def names(self) -> list[str]:
        return sorted({p for t in self.pack.terms for p in (t.term, *t.variants) if p})

    def rows(self, spark) -> DataFrame:
        """The terms as a table."""
        kinds = {"variants": "array<string>", "order": "array<string>", "tags": "array<string>", "seeds": "array<string>", "priority": "int", "confidence": "double"}
        names = [f.name for f in fields(Term)]
        return spark.createDataFrame([tuple(list(v) if isinstance(v := getattr(t, n), tuple) else v for n in names) for t in self.pack.terms], ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))
