"""Document parsing: paragraphs, sentences, quotes, references, positions, tokens.

Everything here is a generator over one row: no operator shuffles. docs has doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.offsets import characters, cutting, find_all, let, prefix_sums, ranks, strip, tiles
from proofloom.rules import LATIN, Pack

def TEXT() -> Column:  # noqa: N802  a column needs a session, so it is made when it is used
    return F.coalesce(F.col("text"), F.lit(""))


PART = 4 << 20  # bytes of files for each task


def spread(docs: DataFrame, part: int = PART) -> DataFrame:
    """docs, dealt out over all cores, or over more tasks if these would get over `part` bytes of the table's files: else one
    row group of a file is one task, however large it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(cores, -(-size // part))
    return docs.repartition(n) if n > 1 else docs


NO_SPACE = r"(?U)\s"


def literal(word: str) -> str:
    """A word as a pattern that Java and RE2 read alike."""
    return re.sub(r"([^\w\s])", r"\\\1", word)


def any_of(words) -> str:
    return "(?:" + "|".join(literal(w) for w in words) + ")"


def doc_key(text: Column) -> Column:
    """The first 12 hex digits of md5 of the text: id of a document that has none."""
    return F.substring(F.md5(text), 1, 12)


def doc_meta(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, doc_key, title, char_count, n_paragraphs, n_sentences."""
    lines = F.filter(F.split(TEXT(), "\n", -1), lambda x: strip(x) != "")
    title = F.substring(strip(F.regexp_replace(F.get(lines, F.lit(0)), r"^\s*#+", "")), 1, 60)
    sents = F.filter(F.regexp_extract_all(TEXT(), F.lit(sentence_pattern(pack)), F.lit(0)), lambda x: strip(x) != "")
    return docs.select("doc_id", doc_key(TEXT()).alias("doc_key"), F.coalesce(title, F.lit("")).alias("title"), F.length(F.regexp_replace(TEXT(), NO_SPACE, "")).cast("bigint").alias("char_count"), F.size(lines).cast("bigint").alias("n_paragraphs"), F.size(sents).cast("bigint").alias("n_sentences"))


def paragraph_array(text: Column, pack: Pack = LATIN) -> Column:
    """Array of (line, start, text, is_heading, in_ref) of the lines that are not blank."""
    placed = lambda ls: F.zip_with(ls, prefix_sums(F.transform(ls, lambda x: F.length(x) + 1)), lambda x, at: F.struct(x.alias("text"), at.alias("start")))
    numbered = F.transform(let(F.split(text, "\n", -1), placed), lambda x, i: F.struct((i + 1).alias("line"), x["start"].alias("start"), x["text"].alias("text")))
    short = lambda x: (F.length(x) < 60) | (F.length(strip(x)) < 60)
    kinds = lambda x: F.struct(x["line"].alias("line"), x["start"].alias("start"), x["text"].alias("text"), (short(x["text"]) & x["text"].rlike(pack.heading)).alias("is_heading"), (short(x["text"]) & x["text"].rlike(pack.reference_head)).alias("is_head"))
    kept = F.transform(F.filter(numbered, lambda x: x["text"].rlike(r"(?U)\S")), kinds)

    def marked(ps: Column) -> Column:
        head = F.array_min(F.transform(F.filter(ps, lambda x: x["is_head"]), lambda x: x["line"]))
        return let(F.struct(head.alias("line")), lambda h: F.transform(ps, lambda x: F.struct(x["line"].alias("line"), x["start"].alias("start"), x["text"].alias("text"), x["is_heading"].alias("is_heading"), F.coalesce(x["line"] >= h["line"], F.lit(False)).alias("in_ref"))))

    return let(kept, marked)


def paragraphs(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, para_idx (dense), line (from 1), start, end, text, is_heading, in_ref."""
    rows = docs.select("doc_id", F.posexplode(paragraph_array(TEXT(), pack)).alias("para_idx", "x"))
    return rows.select("doc_id", "para_idx", "x.line", "x.start", (F.col("x.start") + F.length("x.text")).alias("end"), "x.text", "x.is_heading", "x.in_ref")


def sentence_pattern(pack: Pack) -> str:
    t, c = pack.terminators, pack.closers
    return f"[^{t}]*[{t}][{t}{c}]*|[^{t}]+\\z"


def sentence_array(text: Column, pack: Pack = LATIN) -> Column:
    """Array of (start, end, text): segments that end with terminators and closers; blank ones are dropped."""
    segments = F.regexp_extract_all(text, F.lit(sentence_pattern(pack)), F.lit(0))
    return F.filter(let(segments, tiles), lambda x: x["text"].rlike(r"(?U)\S"))


def sentences(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, sent_idx, start, end, text."""
    return docs.select("doc_id", F.posexplode(sentence_array(TEXT(), pack)).alias("sent_idx", "x")).select("doc_id", "sent_idx", "x.start", "x.end", "x.text")


class Sentence(NamedTuple):
    """A sentence's columns; prior holds the texts of up to PRIOR sentences before it."""

    start: Column
    end: Column
    text: Column
    prior: Column

    def before(self, n: int) -> Column:
        """The texts of the n sentences before, as one."""
        return F.array_join(F.slice(self.prior, F.greatest(F.size(self.prior) - (n - 1), F.lit(1)), n), "")


PRIOR = 5


def window_array(sents: Column) -> Column:
    """Array of (start, end, text, prior) of an array of sentences: each carries the few before it, so that checks of a
    neighbourhood need neither a shuffle nor a window."""
    prior = lambda a, i: F.transform(F.slice(a, F.greatest(i + 1 - PRIOR, F.lit(1)), F.least(i, F.lit(PRIOR))), lambda x: x["text"])
    return let(sents, lambda a: F.transform(a, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), prior(a, i).alias("prior"))))


def sentence_windows(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, sent_idx, start, end, text, prior: the rows that checks of sentences take."""
    rows = docs.select("doc_id", F.posexplode(window_array(sentence_array(TEXT(), pack))).alias("sent_idx", "x"))
    return rows.select("doc_id", "sent_idx", "x.*")


def sentence_of(x: Column) -> Sentence:
    return Sentence(x["start"], x["end"], x["text"], x["prior"])


def sentence_row() -> Sentence:
    return Sentence(*[F.col(c) for c in Sentence._fields])


def line_of(text: Column, pos: Column) -> Column:
    """Line of an offset, from 1."""
    return F.regexp_count(F.substring(text, F.lit(1), pos), F.lit("\n")) + 1


def piece_indices(positions: Column, pieces: Column) -> Column:
    """For each position, the index of the piece (an array of structs with start and end) that holds it, -1 if none does
    (D06, D07)."""
    found = lambda p: F.zip_with(positions, ranks(positions, F.transform(p, lambda x: x["start"])), lambda at, n: F.when((n > 0) & (at < F.get(p, n - 1)["end"]), n - 1).otherwise(F.lit(-1)))
    return let(pieces, found)


def line_numbers(positions: Column, text: Column) -> Column:
    """For each position its line, from 1."""
    return F.transform(ranks(positions, F.transform(find_all(text, "\n"), lambda x: x["end"])), lambda n: n + 1)


#: Quotation marks that open and close.
QUOTES = (("“", "”"), ("‘", "’"), ("「", "」"))


def quote_spans(text: Column) -> Column:
    """Array of (qs, qe), quotes included: asymmetric pairs by a stack (nested ones too, an open one ends with its line),
    straight quotes in pairs that don't cross a line (D08)."""
    return F.sort_array(F.concat(_straight_quotes(text), *[_nested_quotes(text, o, c) for o, c in QUOTES]))


def _nested_quotes(text: Column, opening: str, closing: str) -> Column:
    spans_type = "array<struct<qs:int,qe:int>>"
    state = lambda open_, spans: F.struct(open_.alias("open"), spans.alias("spans"))
    no_open = F.array().cast("array<int>")

    def step(acc, m):
        pop = state(F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0))), F.array_append(acc["spans"], F.struct(F.element_at(acc["open"], -1).alias("qs"), m["end"].alias("qe"))))
        flush = state(no_open, F.concat(acc["spans"], F.transform(acc["open"], lambda o: F.struct(o.alias("qs"), m["start"].alias("qe")))))
        push = state(F.array_append(acc["open"], m["start"]), acc["spans"])
        return F.when(m["text"] == opening, push).when(m["text"] == "\n", flush).when(F.size(acc["open"]) > 0, pop).otherwise(acc)

    marks = find_all(text, f"[{opening}{closing}\\n]")
    spans = F.aggregate(marks, state(no_open, F.array().cast(spans_type)), step, lambda acc: F.concat(acc["spans"], F.transform(acc["open"], lambda o: F.struct(o.alias("qs"), F.length(text).alias("qe")))))
    return F.when(F.contains(text, F.lit(opening)), spans).otherwise(F.array().cast(spans_type))


def _straight_quotes(text: Column) -> Column:
    marks = find_all(text, '"')

    def paired(m):
        pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(m) / 2).cast("int")), lambda k: F.struct(F.element_at(m, 2 * k - 1)["start"].alias("qs"), F.element_at(m, 2 * k)["end"].alias("qe")))
        return F.when(F.size(m) >= 2, F.filter(pairs, lambda p: ~F.contains(F.substring(text, p["qs"] + 1, p["qe"] - p["qs"]), F.lit("\n")))).otherwise(F.array().cast("array<struct<qs:int,qe:int>>"))

    return let(marks, paired)


def in_quote(spans: Column, pos: Column, min_length: int = 0) -> Column:
    """Whether the offset lies in a quote of at least min_length characters, quotes included."""
    return F.exists(spans, lambda q: (q["qs"] <= pos) & (pos < q["qe"]) & (q["qe"] - q["qs"] >= min_length))


def is_negated(text: Column, pos: Column, pack: Pack = LATIN, cut: Callable[[Column, Column], Column] | None = None) -> Column:
    """A negation and at most six characters, none of them a mark, stand right before the offset, within eight (D10). cut: what
    `cutting` gives of the text."""
    before = cut(F.greatest(pos - 8, F.lit(0)), pos) if cut else F.substring(text, F.greatest(pos - 7, F.lit(1)), F.least(pos, F.lit(8)))
    return before.rlike(any_of(pack.negation) + r"[^.,;:!?。，；：！？\n]{0,6}\z")


def context(text: Column, start: Column, end: Column, before: int = 15, after: int = 15) -> Column:
    """The text around a span."""
    lo = F.greatest(start - before, F.lit(0))
    return F.substring(text, lo + 1, end + after - lo)


def contexts(text: Column, spans: Column, before: int = 15, after: int = 15) -> Column:
    """The text around each of an array of spans."""
    around = lambda n, cut: F.transform(spans, lambda x: cut(F.greatest(x["start"] - before, F.lit(0)), F.least(x["end"] + after, n)))
    return cutting(text, around)


def _last_of_run(items: Column, key: str) -> Column:
    """Of a sorted array, the last entry of each run of equal keys."""
    return let(items, lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)[key] != x[key], F.lit(True))))


def reference_array(paras: Column) -> Column:
    """Array of (num, start, end, text), by number: lines that open with [n] in the reference section, or, without one,
    anywhere if there are two or more of them; the last of a number wins (D14)."""
    num = lambda x: F.regexp_extract(x["text"], r"^\s*\[(\d{1,4})\]", 1)
    items = F.transform(F.filter(paras, lambda x: num(x) != ""), lambda x: F.struct(num(x).cast("int").alias("num"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), strip(x["text"]).alias("text"), x["in_ref"].alias("in_ref")))
    kept = lambda a: F.when(F.exists(a, lambda x: x["in_ref"]), F.filter(a, lambda x: x["in_ref"])).when(F.size(a) >= 2, a).otherwise(F.filter(a, lambda x: F.lit(False)))
    return F.transform(_last_of_run(F.sort_array(let(items, kept)), "num"), lambda x: F.struct(x["num"].alias("num"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))


def references(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, num, start, end, text of each reference item."""
    return docs.select("doc_id", F.explode(reference_array(paragraph_array(TEXT(), pack))).alias("x")).select("doc_id", "x.*")


def reference_offset(items: Column) -> Column:
    """Offset of the first reference item, -1 without one."""
    return F.coalesce(F.array_min(F.transform(items, lambda x: x["start"])), F.lit(-1))


def reference_start(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """docs with ref_start: offset of the first reference item, -1 without one."""
    return docs.withColumn("ref_start", reference_offset(reference_array(paragraph_array(TEXT(), pack))))


def reference_text(text: Column, ref_start: Column) -> Column:
    """The part of a text from its first reference item on, '' without one."""
    return F.when(ref_start >= 0, F.substring(text, ref_start + 1, F.length(text))).otherwise("")


def in_reference_section(position: Column, ref_start: Column) -> Column:
    """Whether a position lies in the references."""
    return (ref_start >= 0) & (position >= ref_start)


def body_text(text: Column, ref_start: Column) -> Column:
    return F.when(ref_start >= 0, F.substring(text, F.lit(1), ref_start)).otherwise(text)


def citation_array(body: Column) -> Column:
    """Array of (pos, num) of the numbers cited as [n], each at its first place, by place."""
    hits = F.transform(find_all(body, r"\[\d{1,4}\]"), lambda x: F.struct(F.regexp_extract(x["text"], r"\d+", 0).cast("int").alias("num"), (-x["start"]).alias("pos")))
    return F.sort_array(F.transform(_last_of_run(F.sort_array(hits), "num"), lambda x: F.struct((-x["pos"]).alias("pos"), x["num"].alias("num"))))


def citations(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, num, pos: [n] in the body, at its first place."""
    rows = reference_start(docs, pack).select("doc_id", F.explode(citation_array(body_text(TEXT(), F.col("ref_start")))).alias("x"))
    return rows.select("doc_id", "x.num", "x.pos")


TOKEN = r"[\x{4e00}-\x{9fff}]+|[\p{L}]+|\d+(?:\.\d+)?%?"


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers; runs of CJK characters as bigrams, a single one alone."""
    pieces = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    plain = F.transform(pieces, F.lower)
    is_cjk = lambda p: p.rlike("^[\\x{4e00}-\\x{9fff}]")
    pairs = lambda p: let(characters(p), lambda c: F.when(F.size(c) < 2, c).otherwise(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.array_join(F.slice(c, i, 2), ""))))
    mixed = F.flatten(F.transform(pieces, lambda p: F.when(is_cjk(p), pairs(p)).otherwise(F.array(F.lower(p)))))
    return F.when(text.rlike("[\\x{4e00}-\\x{9fff}]"), mixed).otherwise(plain)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams without marks and blanks; a shorter text is its own n-gram."""
    from proofloom.functions.offsets import ngrams

    return ngrams(characters(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), n)


def html_strip(html: Column) -> Column:
    """Without script and style blocks and tags; no-break spaces and runs of blanks become one space."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), "&nbsp;|\\x{a0}", " ")
    return F.regexp_replace(out, r"\s{2,}", " ")
