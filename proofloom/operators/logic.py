"""Logic checks over sentences and the few before them.

Each check is an expression over a sentence's columns (`parse.Sentence`); the audit applies it to the sentences of a
document in its row, and the functions over DataFrames to rows of `parse.sentence_windows`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.offsets import let, strip
from proofloom.operators.norm import quoted_once
from proofloom.operators.parse import TEXT, Sentence, any_of, paragraph_array, sentence_array, sentence_of, sentence_row, window_array
from proofloom.rules import LATIN, Pack
from proofloom.schema import explode_issues, issue, issues_where

EVIDENCE = r"\d|%|（|\[|\("
CHECKS = ("general", "claim", "leap", "absolute", "intensity", "vague", "quantity")


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def has_evidence(text: Column, pack: Pack = LATIN) -> Column:
    """A number, a bracket or an evidence word."""
    return text.rlike(EVIDENCE) | has_any(text, pack.words["evidence"])


def is_general(s: Sentence, pack: Pack = LATIN) -> Column:
    """A conclusion about all in a sentence, with local scope in it or the three before."""
    local = has_any(s.text, pack.words["local"]) | has_any(s.before(3), pack.words["local"])
    return has_any(s.text, pack.words["conclusion"]) & has_any(s.text, pack.words["universal"]) & local


def is_unfounded(text: Column, is_heading: Column, pack: Pack = LATIN, least: int = 30) -> Column:
    """A paragraph with a claim word and no evidence."""
    return ~is_heading & (F.length(strip(text)) >= least) & has_any(text, pack.words["claim"]) & ~has_evidence(text, pack)


def is_leap(s: Sentence, pack: Pack = LATIN) -> Column:
    """A connective with no comma before it, no figure or bracket here or in the two sentences before, which have at least
    ten characters (L03)."""
    at = F.array_min(F.filter(F.array(*[F.instr(s.text, word) for word in pack.words["causal"]]), lambda i: i > 0))
    prior = s.before(2)
    return at.isNotNull() & ~F.substring(s.text, F.lit(1), F.coalesce(at, F.lit(1)) - 1).rlike("[,，]") & ~s.text.rlike(EVIDENCE) & ~prior.rlike(EVIDENCE) & (F.length(strip(prior)) >= 10)


def absolute(s: Sentence, pack: Pack = LATIN) -> Column:
    """(start, end, terms, n_hard, severity) of a sentence's absolute words, null if there is nothing to report.

    Hard words alone count where there are any: MAJOR for two, or without evidence, else MINOR. Soft words are a hint, and
    only without evidence. A sentence that opens with one of its words and a comma soon after is a figure of speech.
    """
    found = quoted_once(s.text, pack.words["absolute"])
    opener = lambda w: F.startswith(strip(s.text), w) & F.substring(strip(s.text), F.lit(1), F.length(w) + 6).rlike("[,，]")
    proof = s.text.rlike(EVIDENCE)

    def judged(words: Column) -> Column:
        hard = F.array_intersect(words, F.array(*[F.lit(w) for w in pack.words["hard"]]).cast("array<string>"))
        severity = F.when(F.size(hard) > 0, F.when((F.size(hard) >= 2) | ~proof, "MAJOR").otherwise("MINOR")).when(~proof, "INFO")
        terms = F.when(F.size(hard) > 0, hard).otherwise(words)
        lo = F.array_min(F.transform(terms, lambda t: F.instr(s.text, t)))
        hi = F.array_max(F.transform(terms, lambda t: F.instr(s.text, t) + F.length(t)))
        made = F.struct((s.start + lo - 1).alias("start"), (s.start + hi - 1).alias("end"), F.array_join(terms, ",").alias("terms"), F.size(hard).alias("n_hard"), severity.alias("severity"))
        return F.when((F.size(words) > 0) & severity.isNotNull() & ~F.exists(words, opener), made)

    return let(found, judged)


def intensity(s: Sentence, pack: Pack = LATIN) -> Column:
    """(strong, weak): the absolute words and the hedges of a sentence, null unless it has both."""
    made = F.struct(F.array_join(quoted_once(s.text, pack.words["absolute"]), ",").alias("strong"), F.array_join(quoted_once(s.text, pack.words["hedge"]), ",").alias("weak"))
    return F.when(has_any(s.text, pack.words["absolute"]) & has_any(s.text, pack.words["hedge"]), made)


def vague_word(s: Sentence, pack: Pack = LATIN) -> Column:
    """The demonstrative that opens a sentence while none of the five before holds a noun it could mean, else '' (L06)."""
    word = F.regexp_extract(strip(s.text), "^" + any_of(pack.words["vague"]), 0)
    return F.when((word != "") & ~has_any(s.before(5), pack.words["noun"]), word).otherwise("")


def quantity_conflicts(s: Sentence, pack: Pack = LATIN) -> Column:
    """Array of (top, word, advice): quantity words whose range does not hold the sentence's largest percentage."""
    top = F.array_max(F.transform(F.regexp_extract_all(s.text, F.lit(r"(\d+(?:\.\d+)?)%"), F.lit(1)), lambda x: x.cast("double")))
    rules = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(advice).alias("advice")) for w, lo, hi, advice in pack.quantifiers])
    broken = lambda t: F.transform(F.filter(rules, lambda r: F.contains(s.text, r["word"]) & ((t["top"] < r["lo"]) | (t["top"] > r["hi"]))), lambda r: F.struct(t["top"].alias("top"), r["word"].alias("word"), r["advice"].alias("advice")))
    none = F.array().cast("array<struct<top:double,word:string,advice:string>>")
    return F.coalesce(let(F.struct(top.alias("top")), broken), none) if pack.quantifiers else none


def overgeneralisation(sents: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """L01 over rows of sentences."""
    return sents.filter(is_general(sentence_row(), pack))


def claims_without_evidence(paras: DataFrame, pack: Pack = LATIN, least: int = 30) -> DataFrame:
    """L02 over rows of paragraphs."""
    return paras.filter(is_unfounded(F.col("text"), F.col("is_heading"), pack, least))


def causal_leaps(sents: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """L03 over rows of sentences."""
    return sents.filter(is_leap(sentence_row(), pack))


def absolute_claims(sents: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, sent_idx, start, end, terms, n_hard, severity."""
    return sents.select("doc_id", "sent_idx", absolute(sentence_row(), pack).alias("x")).filter("x IS NOT NULL").select("doc_id", "sent_idx", "x.*")


def intensity_conflicts(sents: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, sent_idx, strong, weak."""
    return sents.select("doc_id", "sent_idx", intensity(sentence_row(), pack).alias("x")).filter("x IS NOT NULL").select("doc_id", "sent_idx", "x.*")


def vague_references(sents: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """Rows of sentences with the word that refers to nothing."""
    return sents.withColumn("word", vague_word(sentence_row(), pack)).filter("word != ''")


def quantifier_conflicts(sents: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, sent_idx, top, word, advice."""
    return sents.select("doc_id", "sent_idx", F.explode(quantity_conflicts(sentence_row(), pack)).alias("x")).select("doc_id", "sent_idx", "x.*")


def logic_array(windows: Column, paras: Column, pack: Pack = LATIN, checks: Sequence[str] = CHECKS) -> Column:
    """The engine: issues of one document's sentences and paragraphs, by the checks named."""

    def of_sentence(x: Column) -> Column:
        s = sentence_of(x)
        cut = F.substring(strip(s.text), 1, 80)
        made = {
            "general": lambda: issues_where(is_general(s, pack), issue("logic-general", s.start, s.end, "logic", "MAJOR", "conclusion beyond its scope", strip(s.text), confidence=0.88)),
            "leap": lambda: issues_where(is_leap(s, pack), issue("logic-leap", s.start, s.end, "logic", "MINOR", "cause without grounds", strip(s.text), confidence=0.72)),
            "absolute": lambda: let(absolute(s, pack), lambda a: issues_where(a.isNotNull(), issue("logic-absolute", a["start"], a["end"], "logic", a["severity"], F.concat(F.lit("absolute claim: "), a["terms"]), cut, confidence=F.when(a["severity"] == "INFO", 0.6).otherwise(0.8)))),
            "intensity": lambda: let(intensity(s, pack), lambda a: issues_where(a.isNotNull(), issue("logic-intensity", s.start, s.end, "logic", "MINOR", F.concat(F.lit("strong and weak words conflict: "), a["strong"], F.lit("; "), a["weak"]), cut, confidence=0.7))),
            "vague": lambda: let(vague_word(s, pack), lambda w: issues_where(w != "", issue("logic-vague", s.start + F.instr(s.text, w) - 1, s.start + F.instr(s.text, w) - 1 + F.length(w), "logic", "MINOR", "unclear reference", cut, confidence=0.72))),
            "quantity": lambda: F.transform(quantity_conflicts(s, pack), lambda c: issue("logic-quantity", s.start, s.end, "logic", "MAJOR", F.concat(F.lit("quantity word against the figure: "), c["word"]), cut, explain=c["advice"], confidence=0.85)),
        }
        return F.concat(*[made[c]() for c in checks if c in made])

    parts = []
    if set(checks) - {"claim"}:
        parts.append(F.flatten(F.transform(windows, of_sentence)))
    if "claim" in checks:
        claims = F.filter(paras, lambda p: is_unfounded(p["text"], p["is_heading"], pack))
        parts.append(F.transform(claims, lambda p: issue("logic-claim", p["start"], p["start"] + F.length(p["text"]), "logic", "MINOR", "claim without evidence", F.substring(p["text"], 1, 70), confidence=0.75)))
    return F.concat(*parts)


def logic_issues(docs: DataFrame, pack: Pack = LATIN, checks: Sequence[str] = CHECKS) -> DataFrame:
    """The engine over documents, as the fact table."""
    return explode_issues(docs, "logic", logic_array(window_array(sentence_array(TEXT(), pack)), paragraph_array(TEXT(), pack), pack, checks))
