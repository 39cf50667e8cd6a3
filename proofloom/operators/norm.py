"""Language norms by regular expressions with offsets.

Checks are expressions over a text, its paragraphs or its sentences; the audit applies them in a document's row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.offsets import find_all, let, strip
from proofloom.operators.parse import TEXT, any_of, body_text, context, paragraph_array, paragraphs, reference_array, reference_offset, sentence_array, sentences
from proofloom.rules import LATIN, Pack, Rule
from proofloom.schema import entries, explode_issues, issue, make_issues, no_issues

CHECKS = ("dictionary", "punctuation", "repeats", "percent", "long", "pairs")


#: How a rule's suggestion is made of what it hits: nothing, its replacement, the first half, full-width forms of marks and
#: brackets, digits without commas, curly quotes.
FIXES = ("", "replace", "half", "marks", "brackets", "digits", "quotes")


def _suggestion(rule: Column, hit: Column) -> Column:
    made = {
        "replace": F.regexp_replace(hit, rule["pattern"], rule["replacement"]), "half": F.substring(hit, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(hit) / 2).cast("int"))), "marks": F.translate(hit, HALF, FULL),
        "brackets": F.translate(hit, "()", "（）"), "digits": F.replace(hit, F.lit(","), F.lit("")), "quotes": F.regexp_replace(hit, '^"(.*)"$', "“$1”"),
    }
    out = F.lit("")
    for name, column in made.items():
        out = F.when(rule["fix"] == name, column).otherwise(out)
    return out


def rule_array(text: Column, rules: Sequence[Rule], fix: str = "") -> Column:
    """Issues of all matches of each rule (N01). Rules are an array of the plan, so that the plan does not grow with them; a
    pattern that a text lacks costs one search. Replacement and advice are separate. fix: for rules that name none."""
    if not rules:
        return no_issues()
    fixes = [r.fix or fix or ("" if r.replacement is None else "replace") for r in rules]
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in {"id": r.id, "pattern": r.pattern, "category": r.category, "severity": r.severity, "message": r.message, "advice": r.advice, "confidence": float(r.confidence), "fix": x, "replacement": r.replacement or ""}.items()]) for r, x in zip(rules, fixes, strict=True)])
    hit = lambda r: lambda x: issue(r["id"], x["start"], x["end"], r["category"], r["severity"], r["message"], x["text"], _suggestion(r, x["text"]), r["advice"], confidence=r["confidence"])
    return F.flatten(F.transform(F.filter(table, lambda r: F.rlike(text, r["pattern"])), lambda r: F.transform(find_all(text, r["pattern"]), hit(r))))


def rule_hits(docs: DataFrame, rules: Sequence[Rule], text: Column | None = None) -> DataFrame:
    """One row per match of each rule: doc_id, the rule's columns, span, original and suggestion."""
    return entries(docs, rule_array(TEXT() if text is None else text, rules)).select("doc_id", "rule_id", "severity", "category", "message", "start", "end", "original", "suggestion", "explain", "confidence")


def dictionary_issues(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """Dictionary rules as issues."""
    return make_issues(rule_hits(docs, pack.language), "norm")


def banned_array(text: Column, pack: Pack = LATIN, honour_context: bool = False) -> Column:
    """Banned patterns; a fatal one counts as political, others as language. With honour_context a hit whose surroundings
    hold one of the rule's allowed contexts falls to INFO (T16)."""
    found = rule_array(text, pack.banned)

    def severity(x: Column) -> Column:
        out = x["severity"]
        for r in pack.banned if honour_context else ():
            if r.allow_context:
                out = F.when((x["rule_id"] == r.id) & context(text, x["start"], x["end"]).rlike(any_of(r.allow_context)), "INFO").otherwise(out)
        return out

    return F.transform(found, lambda x: x.withField("category", F.when(x["severity"] == "FATAL", "political").otherwise("language")).withField("severity", severity(x)))


def banned_issues(docs: DataFrame, pack: Pack = LATIN, honour_context: bool = False) -> DataFrame:
    """Banned patterns over documents."""
    return explode_issues(docs, "term", banned_array(TEXT(), pack, honour_context))


#: Half-width marks and their full-width forms.
HALF, FULL = ",;:?!", "，；：？！"

PUNCTUATION = (
    Rule("ellipsis", r"\.{3,}|。{3,}", message="ellipsis form", replacement="…", confidence=0.93),
    Rule("repeated-mark", r"([!?,;！？，；])\1+", message="repeated mark", replacement="$1", confidence=0.9),
    Rule("thousands", r"\d{1,3}(?:,\d{3})+", "INFO", "data", "thousands comma", advice="write digits without commas", confidence=0.75, fix="digits"),
    Rule("full-parens", r"\([\x{4e00}-\x{9fff}][^()\n]{0,40}\)", "INFO", "format", "half-width brackets around CJK", confidence=0.85, fix="brackets"),
    Rule("cjk-quotes", "\"[^\"\\n]{0,40}[\\x{4e00}-\\x{9fff}][^\"\\n]{0,40}\"", "MINOR", "format", "straight quotes around CJK", confidence=0.92, fix="quotes"),
)
HALF_WIDTH = Rule("half-width", f"(?<=[\\x{{4e00}}-\\x{{9fff}}])[{HALF}](?=[\\x{{4e00}}-\\x{{9fff}}])", message="half-width mark between CJK", confidence=0.95, fix="marks")
SPACING = Rule("cjk-latin-space", r"(?<![\sA-Za-z])[A-Za-z]{3,}(?=[\x{4e00}-\x{9fff}])", "INFO", "format", "no space between Latin and CJK", confidence=0.55)


MARKS = (*PUNCTUATION, HALF_WIDTH, SPACING)


def punctuation_array(text: Column, pack: Pack = LATIN) -> Column:
    """Marks, brackets, quotes, thousands, spacing (N02-N06, N11, N12). Words of the pack's closed_up need no space."""
    return closed_up(rule_array(text, MARKS), pack)


def closed_up(found: Column, pack: Pack = LATIN) -> Column:
    """Issues without those of words that need no space."""
    if not pack.closed_up:
        return found
    return F.filter(found, lambda x: (x["rule_id"] != SPACING.id) | ~F.lower(x["original"]).isin(*pack.closed_up))


def repeat_array(text: Column, pack: Pack = LATIN) -> Column:
    """Doubled words and chains of attributes; the suggestion is the first half of what stands there."""
    return rule_array(text, pack.repeats, "half")


def punctuation_issues(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """Marks, brackets, quotes, thousands, spacing, repeats over documents."""
    return explode_issues(docs, "norm", F.concat(punctuation_array(TEXT(), pack), repeat_array(TEXT(), pack)))


def uneven_percentages(text: Column) -> Column:
    """Whether percentages of a paragraph differ by more than one in their number of decimals."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?%"), F.lit(0))
    decimals = F.transform(found, lambda x: F.length(F.regexp_extract(x, r"\.(\d+)%", 1)))
    return let(decimals, lambda d: (F.size(d) > 1) & (F.array_max(d) - F.array_min(d) > 1))


def percent_precision(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """Paragraphs with uneven percentages."""
    return paragraphs(docs, pack).filter(uneven_percentages(F.col("text")))


def is_long(text: Column, longest: int = 90, commas: int = 5) -> Column:
    """Whether a sentence has over `longest` characters and at least `commas` commas; one that opens with [ does not count
    (N10)."""
    return (F.length(strip(text)) > longest) & (F.regexp_count(text, F.lit("[,，、]")) >= commas) & ~strip(text).startswith("[")


def long_sentences(docs: DataFrame, pack: Pack = LATIN, longest: int = 90, commas: int = 5) -> DataFrame:
    """Long sentences over documents."""
    return sentences(docs, pack).filter(is_long(F.col("text"), longest, commas))


def pair_array(body: Column, pack: Pack = LATIN) -> Column:
    """Array of (pair, n_open, n_close) where the counts differ."""

    def counted(b: Column) -> Column:
        count = lambda mark: F.length(b) - F.length(F.replace(b, F.lit(mark), F.lit("")))
        counts = F.array(*[F.struct(F.lit(x + y).alias("pair"), count(x).alias("n_open"), count(y).alias("n_close")) for x, y in pack.pairs])
        return F.filter(counts, lambda x: x["n_open"] != x["n_close"])

    return let(body, counted)


def pair_balance(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, pair, n_open, n_close of the bodies where the counts differ."""
    body = body_text(TEXT(), reference_offset(reference_array(paragraph_array(TEXT(), pack))))
    return docs.select("doc_id", F.explode(pair_array(body, pack)).alias("x")).select("doc_id", "x.*")


def mark_faults(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, rule_id, original of marks, paragraphs with uneven percentages and pairs out of balance, from one pass over
    the rows (N03, N06, N07, N13)."""
    rows = docs.select("doc_id", TEXT().alias("text"), paragraph_array(TEXT(), pack).alias("paras"))
    rows = rows.withColumn("body", body_text(F.col("text"), reference_offset(reference_array(F.col("paras")))))
    told = lambda rule, original: F.struct(rule.alias("rule_id"), original.alias("original"))
    marks = F.transform(rule_array(F.col("text"), PUNCTUATION), lambda x: told(x["rule_id"], x["original"]))
    uneven = F.transform(F.filter("paras", lambda p: uneven_percentages(p["text"])), lambda p: told(F.lit("percent"), F.lit("")))
    pairs = F.transform(pair_array(F.col("body"), pack), lambda x: told(F.lit("pair"), F.concat_ws(" ", x["pair"], x["n_open"], x["n_close"])))
    return entries(rows, F.concat(marks, uneven, pairs))


def norm_array(text: Column, body: Column, sents: Column, paras: Column, pack: Pack = LATIN, checks: Sequence[str] = CHECKS) -> Column:
    """The engine: issues of one document by the checks named; those left out never enter the plan."""
    made = {
        "percent": lambda: F.transform(F.filter(paras, lambda p: uneven_percentages(p["text"])), lambda p: issue("percent-precision", p["start"], p["start"] + F.length(p["text"]), "data", "INFO", "percentages of different precision", F.substring(p["text"], 1, 60), confidence=0.7)),
        "long": lambda: F.transform(F.filter(sents, lambda s: is_long(s["text"])), lambda s: issue("long-sentence", s["start"], s["end"], "language", "INFO", "long sentence", F.substring(strip(s["text"]), 1, 60), confidence=0.8)),
        "pairs": lambda: F.transform(pair_array(body, pack), lambda x: issue(F.concat(F.lit("pair-"), x["pair"]), 0, 0, "format", "MAJOR", F.format_string("%s does not match: %d and %d", x["pair"], x["n_open"], x["n_close"]), x["pair"], confidence=0.95)),
    }
    halved = [replace(r, fix=r.fix or "half") for r in pack.repeats]
    rules = [r for c, own in (("dictionary", pack.language), ("punctuation", MARKS), ("repeats", halved)) if c in checks for r in own]
    return F.concat(closed_up(rule_array(text, rules), pack), *[made[c]() for c in checks if c in made])


def norm_issues(docs: DataFrame, pack: Pack = LATIN, checks: Sequence[str] = CHECKS) -> DataFrame:
    """The engine over documents, as the fact table; reference sections are exempt only after overlaps are resolved."""
    paras = paragraph_array(TEXT(), pack)
    body = body_text(TEXT(), reference_offset(reference_array(paras)))
    return explode_issues(docs, "norm", norm_array(TEXT(), body, sentence_array(TEXT(), pack), paras, pack, checks))


def outside_references(issues: Column, ref_start: Column) -> Column:
    """Issues of an array that don't start in the references."""
    return F.filter(issues, lambda x: (ref_start < 0) | (x["start"] < ref_start))


def quoted_once(text: Column, words: Sequence[str]) -> Column:
    """The words of a list that a text holds, in the list's order."""
    held = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    return let(text, lambda t: F.filter(held, lambda w: F.contains(t, w)))
