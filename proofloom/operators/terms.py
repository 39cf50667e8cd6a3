"""Terminology: exact, fuzzy and semantic matching, ordering, suppression."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.functions.hashing import cosine, hashed_vector
from proofloom.functions.offsets import characters, cutting, find_all, first_of_runs, let, ngrams, prefix_sums
from proofloom.operators.norm import banned_array
from proofloom.operators.parse import TEXT, any_of, context, in_quote, is_negated, paragraph_array, quote_spans, sentence_array
from proofloom.operators.similarity import in_python
from proofloom.rules import LATIN, Pack, Term, pattern_rows
from proofloom.schema import explode_issues, issue, make_issues, no_issues
from proofloom.sources.tables import shared_folder

CHECKS = ("exact", "fuzzy", "semantic", "ordering", "banned")

BROADCAST_PATTERNS = 50_000  # a pattern table above this size joins by shuffle
SEARCHED_PATTERNS = 256  # up to so many patterns each text is searched for each of them


def _small(patterns: DataFrame) -> DataFrame:
    return F.broadcast(patterns) if patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS else patterns


def occurrences(text: Column, pattern: Column) -> Column:
    """Starts of all occurrences of a literal, overlapping ones too: the text is cut before each of them."""
    cut = F.split(text, F.concat(F.lit(r"(?=\Q"), pattern, F.lit(r"\E)")), -1)
    starts = let(cut, lambda c: prefix_sums(F.transform(c, F.length)))
    return F.filter(starts, lambda at: (at > 0) | F.startswith(text, pattern))


def located(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, text, p (the pattern's row), start of every hit. Which patterns a text may hold is found first: by search while the patterns are few, else by joining the text's
    distinct n-grams to the patterns' first ones. Only those are then located.
    """
    n = patterns.limit(SEARCHED_PATTERNS + 1).count()
    if n <= SEARCHED_PATTERNS:
        table = F.broadcast(patterns.agg(F.collect_list(F.struct(*patterns.columns)).alias("table")))
        pairs = docs.select("doc_id", TEXT().alias("text")).join(table).select("doc_id", "text", F.explode(F.filter("table", lambda p: F.contains("text", p["pattern"]))).alias("p"))
    else:
        width = patterns.agg(F.min(F.length("pattern"))).first()[0]
        grams = docs.select("doc_id", F.explode(F.array_distinct(ngrams(characters(TEXT()), width))).alias("gram"))
        keyed = patterns.select(F.struct(*patterns.columns).alias("p"), F.substring("pattern", 1, width).alias("gram"))
        pairs = grams.join(_small(keyed), "gram").select("doc_id", "p").join(docs.select("doc_id", TEXT().alias("text")), "doc_id")
    return pairs.select("doc_id", "text", "p", F.explode(occurrences(F.col("text"), F.col("p.pattern"))).alias("start"))


def exact_hits(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, start, end, and the pattern's columns: all hits of all patterns, overlapping ones too."""
    columns = [F.col(f"p.{c}").alias(c) for c in patterns.columns]
    return located(docs, patterns).select("doc_id", "start", (F.col("start") + F.length("p.pattern")).alias("end"), *columns)


def exact_issues(hits: DataFrame) -> DataFrame:
    """Hits of variants as issues; those of standard terms only protect what they cover."""
    wrong = hits.filter("role = 'variant' AND pattern != suggestion")
    message = F.when(F.col("type") == "deprecated", "deprecated term").otherwise("term variant")
    return make_issues(wrong.withColumn("original", F.col("pattern")), "term", rule_id=F.concat(F.lit("term-"), "term_id"), category="term", message=message, confidence=0.95)


def fuzzy_hits(docs: DataFrame, surfaces: DataFrame, exact: DataFrame, max_distance: int = 2, least: float = 0.86, allow_short: int = 4) -> DataFrame:
    """doc_id, start, end, window, surface, term_id, distance: same-length windows within an edit distance.

    A window has its surface's length and shares a pair of neighbours with it in place. Candidates come from blocks of the
    surfaces: cut into one block more than edits are allowed, one block must stand unchanged, at its place or, with two
    edits, one off. Blocks are located like exact patterns. Windows that start where an exact hit starts, equal their surface
    or a standard term, or hold a standard term of six characters or more are left out; the nearest surface wins, then the
    first in order.
    """
    edits = F.least(F.lit(max_distance), F.floor((1 - least) * F.length("surface") + 1e-9)).cast("int")
    sized = surfaces.filter(F.length("pattern") >= allow_short).select("term_id", F.col("pattern").alias("surface")).withColumn("edits", edits).filter("edits > 0")
    block = lambda k: F.struct(F.floor(k * F.length("surface") / (F.col("edits") + 1)).cast("int").alias("lo"), F.floor((k + 1) * F.length("surface") / (F.col("edits") + 1)).cast("int").alias("hi"))
    cut = sized.withColumn("b", F.explode(F.transform(F.sequence(F.lit(0), F.col("edits")), block)))
    blocks = cut.select(F.expr("substring(surface, b.lo + 1, b.hi - b.lo)").alias("pattern"), "term_id", "surface", F.col("b.lo").alias("offset"), F.when(F.col("edits") > 1, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("shifts"))
    votes = located(docs, blocks).select("doc_id", "text", "p.term_id", "p.surface", (F.col("start") - F.col("p.offset")).alias("at"), F.explode("p.shifts").alias("shift"))
    votes = votes.withColumn("start", F.col("at") + F.col("shift")).withColumn("len", F.length("surface")).filter("start >= 0")
    windows = votes.withColumn("window", F.expr("substring(text, start + 1, len)")).filter("length(window) = len AND window != surface").drop("text")
    equal = F.zip_with(characters(F.col("window")), characters(F.col("surface")), lambda a, b: a == b)
    windows = windows.filter(let(equal, lambda e: F.exists(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.element_at(e, i) & F.element_at(e, i + 1))))
    close = windows.withColumn("distance", F.levenshtein("window", "surface", max_distance)).filter(F.col("distance") > 0).filter(1 - F.col("distance") / F.col("len") >= least)
    standards = surfaces.filter("role = 'standard'").select(F.collect_set("pattern").alias("standards"))  # one row
    close = close.select("doc_id", "start", (F.col("start") + F.col("len")).alias("end"), "window", "surface", "term_id", "distance").distinct().crossJoin(standards)
    close = close.filter(~F.exists("standards", lambda s: (s == F.col("window")) | ((F.length(s) >= 6) & F.contains(F.col("window"), s)))).drop("standards")
    free = close.join(exact.select("doc_id", "start").distinct(), ["doc_id", "start"], "left_anti")
    best = Window.partitionBy("doc_id", "start", "end").orderBy("distance", "surface")
    return free.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")


def semantic_hits(vectors: DataFrame, seeds: DataFrame, least: float = 0.82, seeds_limit: int = 4096) -> DataFrame:
    """key, term, seed, score: for each vector and term the nearest seed by cosine, if near enough.

    vectors: key, vec. seeds: term, seed, vec. Vectors meet all seeds, which are a stated set: up to seeds_limit of them are
    broadcast at once. More come in blocks by hash, each of about half as many; a block's hits are written before the next
    one's, so neither the plan nor what is broadcast grows with the seeds. On equal scores the smaller seed wins; a zero vector
    is near nothing (score 0), a null one has no score.
    """

    def best(scored: DataFrame) -> DataFrame:
        top = scored.groupBy("key", "term").agg(F.max_by("seed", F.struct("score", -F.col("seed"))).alias("seed"), F.max("score").alias("score"))
        return top.filter(F.col("score") >= least)

    def block(part: DataFrame) -> DataFrame:
        return best(vectors.join(F.broadcast(part.withColumnRenamed("vec", "seed_vec"))).withColumn("score", cosine(F.col("vec"), F.col("seed_vec"))).select("key", "term", "seed", "score"))

    if seeds.limit(seeds_limit + 1).count() <= seeds_limit:
        return block(seeds)
    blocks = -(-2 * seeds.count() // seeds_limit)
    folder = f"{shared_folder(seeds.sparkSession)}/semantic-{uuid.uuid4().hex}"
    number = F.pmod(F.xxhash64("term", "seed"), F.lit(blocks))
    for n in range(blocks):
        block(seeds.filter(number == n)).write.mode("append").parquet(folder)
    return best(seeds.sparkSession.read.parquet(folder))


def best_span(sentence: Column, seed: Column, least: int = 3) -> Column:
    """(start, end) of the longest common block of sentence and seed if it has `least` characters, else a prefix."""
    lengths = F.sequence(F.length(seed), F.lit(least), F.lit(-1))
    blocks = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length(seed) - n + 1), lambda i: F.substring(seed, i, n))))
    found = F.filter(F.when(F.length(seed) >= least, blocks).otherwise(F.array().cast("array<string>")), lambda b: F.contains(sentence, b))
    first = F.get(found, F.lit(0))
    prefix = F.struct(F.lit(0).alias("start"), F.least(F.length(sentence), F.greatest(F.lit(6), F.length(seed))).alias("end"))
    return F.when(first.isNull(), prefix).otherwise(F.struct((F.instr(sentence, first) - 1).alias("start"), (F.instr(sentence, first) - 1 + F.length(first)).alias("end")))


def ordering_array(text: Column, t: Term) -> Column:
    """Array of (start, end, original, kind: incomplete or order, first_wrong, suggestion) of a term's segments."""
    order = F.array(*[F.lit(w) for w in t.order])
    separator = lambda x: F.regexp_extract(x, any_of(t.order) + r"([、，,; ]{1,2})" + any_of(t.order), 1)
    placed = lambda x: F.transform(F.sort_array(F.filter(F.transform(order, lambda w: F.struct(F.instr(x, w).alias("at"), w.alias("w"))), lambda p: p["at"] > 0)), lambda p: p["w"])

    def judged(x: Column) -> Column:
        def against(present: Column) -> Column:
            expected = F.filter(order, lambda w: F.array_contains(present, w))
            kind = F.when(F.size(present) < 2, None).when(F.size(present) < len(t.order), "incomplete").when(F.to_json(present) != F.to_json(expected), "order")
            wrong = F.when(kind == "order", F.array_position(F.zip_with(present, expected, lambda a, b: a == b), False).cast("int") - 1).otherwise(-1)
            sep = F.when(separator(x["text"]) == "", ", ").otherwise(separator(x["text"]))
            joined = F.array_join(F.when(kind == "order", expected).otherwise(order), "\u0001")
            made = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("original"), kind.alias("kind"), wrong.alias("first_wrong"), F.replace(joined, F.lit("\u0001"), sep).alias("suggestion"))
            return F.when(kind.isNotNull(), made)

        return let(placed(x["text"]), against)

    return F.filter(F.transform(find_all(text, t.segment), judged), lambda x: x.isNotNull())


def _ordering(pack: Pack) -> list[Term]:
    return [t for t in pack.terms if t.type == "ordering" and t.segment]


def ordering_issues(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, rule_id, start, end, original, kind, first_wrong, suggestion, severity."""
    out = [docs.select("doc_id", F.lit(t.id).alias("rule_id"), F.explode(ordering_array(TEXT(), t)).alias("x"), F.lit(t.severity).alias("severity")) for t in _ordering(pack)]
    return reduce(DataFrame.unionByName, out).select("doc_id", "rule_id", "x.*", "severity")


def pattern_table(pack: Pack) -> Column:
    """The pack's patterns as an array of structs, a literal of the plan."""
    fields = ("pattern", "role", "term_id", "term", "type", "severity", "suggestion", "source", "confidence", "explain")
    rows = [F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in pattern_rows(pack)]
    return F.array(*rows)


def exact_array(text: Column, pack: Pack = LATIN) -> Column:
    """Array of the pattern's columns with start and end: all hits of all patterns, overlapping ones too.

    The text is searched for each pattern; see with_hits for many of them.
    """
    held = F.filter(pattern_table(pack), lambda p: F.contains(text, p["pattern"]))
    return F.flatten(F.transform(held, lambda p: F.transform(occurrences(text, p["pattern"]), lambda n: _at(p, n))))


def _at(p: Column, n: Column) -> Column:
    return p.withField("start", n).withField("end", n + F.length(p["pattern"]))


def with_hits(rows: DataFrame, pack: Pack = LATIN, out: str = "hits") -> DataFrame:
    """rows (text) with exact_array; a pack of over SEARCHED_PATTERNS patterns is sought by an automaton in Python, in Arrow
    batches."""
    patterns = pattern_rows(pack)
    if len(patterns) <= SEARCHED_PATTERNS:
        return rows.withColumn(out, exact_array(F.col("text"), pack))
    table = pattern_table(pack)
    return in_python(rows, "found_", _scan(patterns), F.col("text")).withColumn(out, F.transform("found_", lambda h: _at(F.get(table, h["row"]), h["start"]))).drop("found_")


def _scan(rows: list[dict]):
    """A function that finds all patterns in texts: array of (row, start) by start."""
    patterns = [r["pattern"] for r in rows]

    @F.pandas_udf("array<struct<row:int,start:int>>")
    def find(texts: pd.Series) -> pd.Series:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            found.add_word(p, i)
        found.make_automaton()
        return pd.Series([sorted(({"row": i, "start": end - len(patterns[i]) + 1} for end, i in found.iter(t or "")), key=lambda x: (x["start"], x["row"])) for t in texts])

    return find


def exact_term_array(hits: Column) -> Column:
    """Issues of the hits of variants; those of standard terms only protect what they cover."""
    wrong = F.filter(hits, lambda h: (h["role"] == "variant") & (h["pattern"] != h["suggestion"]))
    return F.transform(wrong, lambda h: issue(F.concat(F.lit("term-"), h["term_id"]), h["start"], h["end"], "term", h["severity"], F.when(h["type"] == "deprecated", "deprecated term").otherwise("term variant"), h["pattern"], h["suggestion"], h["explain"], h["source"], h["confidence"]))


def surface_blocks(pack: Pack, max_distance: int = 2, least: float = 0.86, allow_short: int = 4) -> list[dict]:
    """Blocks of the pack's surfaces of which one stands unchanged in any window within the distance: pattern, surface,
    offset, reach (how far it may be off its place)."""
    out = []
    for r in pattern_rows(pack):
        w = r["pattern"]
        edits = min(max_distance, int((1 - least) * len(w) + 1e-9))
        if len(w) < allow_short or not edits:
            continue
        for k in range(edits + 1):
            lo, hi = k * len(w) // (edits + 1), (k + 1) * len(w) // (edits + 1)
            out.append({"pattern": w[lo:hi], "surface": w, "term_id": r["term_id"], "severity": r["severity"], "confidence": r["confidence"], "offset": lo, "reach": int(edits > 1)})
    return out


_VOTE = "struct<start:int,surface:string,term_id:string,severity:string,confidence:double>"
_NEAR = "struct<start:int,end:int,distance:int,surface:string,window:string,term_id:string,severity:string,confidence:double>"


def fuzzy_votes(text: Column, pack: Pack = LATIN, max_distance: int = 2, least: float = 0.86) -> Column:
    """Array of (start, surface, and its columns): places where a block of a surface stands unchanged."""
    none = F.array().cast(f"array<{_VOTE}>")
    blocks = surface_blocks(pack, max_distance, least)
    if not blocks:
        return none
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in b.items()]) for b in blocks])
    vote = lambda b, n, s: F.struct((n - b["offset"] + s).alias("start"), *[b[c].alias(c) for c in ("surface", "term_id", "severity", "confidence")])
    of_block = lambda b: F.flatten(F.transform(occurrences(text, b["pattern"]), lambda n: F.transform(F.sequence(-b["reach"], b["reach"]), lambda s: vote(b, n, s))))
    found = F.flatten(F.transform(F.filter(table, lambda b: F.contains(text, b["pattern"])), of_block))
    ordered = F.sort_array(F.filter(F.concat(none, found), lambda v: v["start"] >= 0))  # equal ones side by side: array_distinct compares all pairs
    return first_of_runs(ordered, lambda a, b: (a["start"] == b["start"]) & (a["surface"] == b["surface"]) & (a["term_id"] == b["term_id"]))


def fuzzy_array(text: Column, votes: Column, hits: Column, pack: Pack = LATIN, max_distance: int = 2, least: float = 0.86) -> Column:
    """Array of (start, end, distance, surface, window, term_id, severity, confidence): same-length windows within an edit
    distance of a surface, as `fuzzy_hits` finds them (T06-T08)."""
    window = lambda cut: F.transform(votes, lambda v: F.struct(cut(v["start"], v["start"] + F.length(v["surface"])).alias("window"), v.alias("v")))
    windows = F.filter(cutting(text, lambda n, cut: window(cut)), lambda x: (x["window"] != x["v"]["surface"]) & (F.length(x["window"]) == F.length(x["v"]["surface"])))
    told = F.transform(windows, lambda x: F.struct(x["v"]["start"].alias("start"), (x["v"]["start"] + F.length(x["window"])).alias("end"), F.levenshtein(x["window"], x["v"]["surface"], max_distance).alias("distance"), x["v"]["surface"].alias("surface"), x["window"].alias("window"), *[x["v"][c].alias(c) for c in ("term_id", "severity", "confidence")]))
    near = F.filter(told, lambda v: (v["distance"] > 0) & (1 - v["distance"] / F.length(v["surface"]) >= least))
    equal = lambda v: F.zip_with(characters(v["window"]), characters(v["surface"]), lambda a, b: F.when(a == b, "1").otherwise("0"))
    standards = F.array(*[F.lit(x) for x in sorted({t.term for t in pack.terms})]).cast("array<string>")
    free = lambda v: ~F.exists(hits, lambda h: h["start"] == v["start"]) & ~F.exists(standards, lambda w: (w == v["window"]) | ((F.length(w) >= 6) & F.contains(v["window"], w)))
    kept = F.sort_array(F.filter(near, lambda v: free(v) & F.contains(F.array_join(equal(v), ""), F.lit("11"))))
    return F.concat(F.array().cast(f"array<{_NEAR}>"), first_of_runs(kept, lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])))


def _embedded_sentences(seeds: list[tuple[str, str]], dim: int, least: float):
    """A function that gives, for an array of sentences, an array of (i, seed, score): for each sentence and term the nearest
    seed by cosine of hashed vectors, if near enough."""

    @F.pandas_udf("array<struct<i:int,seed:int,score:double>>")
    def near(rows: pd.Series) -> pd.Series:
        wanted = np.stack([hashed_vector(text, dim) for _, text in seeds])
        terms = {t: [k for k, (x, _) in enumerate(seeds) if x == t] for t, _ in seeds}
        out = []
        for sents in rows:
            found = []
            scores = np.stack([hashed_vector(s, dim) for s in sents]) @ wanted.T if len(sents) else np.zeros((0, len(seeds)))
            for i, row in enumerate(scores):
                for own in terms.values():
                    k = max(own, key=lambda x: row[x])
                    if row[k] >= least:
                        found.append({"i": i, "seed": k, "score": float(row[k])})
            out.append(found)
        return pd.Series(out)

    return near


def with_meanings(rows: DataFrame, taken: str, ref_start: str, out: str, pack: Pack = LATIN, least: float = 0.82, dim: int = 256, shortest: int = 12) -> DataFrame:
    """rows (sents) with the issues of sentences that are close to a seed of a semantic term, outside the references, of `shortest` characters or
    more, that overlap no span in taken; the span is what sentence and seed share most (T09, T10, T12)."""
    terms = {t.id: t for t in pack.terms if t.type == "semantic" and t.seeds}
    seeds = [(t.id, seed) for t in terms.values() for seed in t.seeds]
    if not seeds:
        return rows.withColumn(out, no_issues())
    table = F.array(*[F.struct(F.lit(t).alias("term_id"), F.lit(seed).alias("seed"), F.lit(terms[t].term).alias("term"), F.lit(terms[t].severity).alias("severity"), F.lit(terms[t].source).alias("source")) for t, seed in seeds])
    open_ = F.filter("sents", lambda s: (F.length(s["text"]) >= shortest) & ((F.col(ref_start) < 0) | (s["start"] < F.col(ref_start))) & ~F.exists(taken, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))

    def one(f: Column) -> Column:
        def told(x: Column) -> Column:
            s, t = x["s"], x["t"]
            made = lambda b: issue(F.concat(F.lit("semantic-"), t["term_id"]), s["start"] + b["start"], s["start"] + b["end"], "term", t["severity"], F.concat(F.lit("close in meaning to "), t["term"]), F.substring(s["text"], b["start"] + 1, b["end"] - b["start"]), t["term"], F.concat(F.lit("seed: "), t["seed"]), t["source"], F.round(f["score"], 3))
            return let(best_span(s["text"], t["seed"]), made)

        return let(F.struct(F.get("open_", f["i"]).alias("s"), F.get(table, f["seed"]).alias("t")), told)

    rows = in_python(rows.withColumn("open_", open_), "close_", _embedded_sentences(seeds, dim, least), F.transform("open_", lambda s: s["text"]))
    return rows.withColumn(out, F.transform("close_", one)).drop("open_", "close_")


def suppression(x: Column, text: Column, quotes: Column, ref_start: Column, pack: Pack = LATIN, min_quote: int = 20, cut: Callable[[Column, Column], Column] | None = None) -> Column:
    """Why an issue is not reported: long-quote (orders are not exempt), negated, reference; null if it is (T17). cut: what
    `cutting` gives of the text, for many issues of one."""
    quoted = ~x["rule_id"].startswith("order-") & in_quote(quotes, x["start"], min_quote)
    return F.when(quoted, "long-quote").when(is_negated(text, x["start"], pack, cut), "negated").when((ref_start >= 0) & (x["start"] >= ref_start), "reference")


def reference_line(paras: Column) -> Column:
    """Offset of the first paragraph in the reference section, -1 without one."""
    return F.coalesce(F.array_min(F.transform(F.filter(paras, lambda p: p["in_ref"]), lambda p: p["start"])), F.lit(-1))


def suppress(issues: DataFrame, docs: DataFrame, pack: Pack = LATIN, min_quote: int = 20) -> DataFrame:
    """Issues that come as rows with `suppressed`, the reason or null (T17). One join by doc_id brings quotes and texts."""
    facts = docs.select(F.col("doc_id").alias("d"), TEXT().alias("doc_text"), quote_spans(TEXT()).alias("quotes"), reference_line(paragraph_array(TEXT(), pack)).alias("ref_from"))
    rows = issues.join(facts, F.col("doc_id").eqNullSafe(F.col("d")))
    reason = suppression(F.struct("rule_id", "start"), F.col("doc_text"), F.col("quotes"), F.col("ref_from"), pack, min_quote)
    return rows.withColumn("suppressed", reason).drop("d", "doc_text", "quotes", "ref_from")


def protect_array(issues: Column, hits: Column) -> Column:
    """Issues inside a hit of a standard term fall to INFO."""
    covered = lambda x: F.exists(hits, lambda h: (h["role"] == "standard") & (h["start"] <= x["start"]) & (x["end"] <= h["end"]))
    return F.transform(issues, lambda x: x.withField("severity", F.when(covered(x), "INFO").otherwise(x["severity"])))


def preview(text: Column, start: Column, end: Column, replacement: Column, size: int = 120) -> Column:
    """The text around a span with the replacement filled in."""
    before = context(text, start, start, 40, 0)
    return F.substring(F.concat(before, replacement, F.substring(text, end + 1, F.lit(80))), 1, size)


def with_terms(rows: DataFrame, pack: Pack = LATIN, checks: Sequence[str] = CHECKS) -> DataFrame:
    """rows (text, sents, paras) with term_issues: exact, fuzzy, semantic, ordering and banned findings after suppression
    (O32), and suppressed, the number of those that are not reported (T19). Each step is a column of the row."""
    text = F.col("text")
    grade = lambda v: F.when(v["severity"] == "INFO", "MINOR").otherwise(v["severity"])
    sure = lambda v: F.round(F.greatest(F.lit(0.6), v["confidence"] * (1 - v["distance"] / F.length(v["surface"]))), 2)
    note = lambda v: F.concat(F.lit("fills to: "), preview(text, v["start"], v["end"], v["surface"]))
    close = lambda v: issue(F.concat(F.lit("fuzzy-"), v["term_id"]), v["start"], v["end"], "term", grade(v), "close to a term", v["window"], v["surface"], note(v), confidence=sure(v))
    segment = lambda t: lambda x: issue(f"order-{t.id}", x["start"], x["end"], "term", t.severity, F.concat(F.lit("fixed order: "), x["kind"]), x["original"], x["suggestion"], confidence=t.confidence)
    rows = with_hits(rows, pack, "hits_").withColumn("votes_", fuzzy_votes(text, pack)).withColumn("quotes_", quote_spans(text)).withColumn("line_", reference_line(F.col("paras")))
    rows = rows.withColumn("near_", fuzzy_array(text, F.col("votes_"), F.col("hits_"), pack))
    exact = exact_term_array(F.col("hits_")) if "exact" in checks else no_issues()
    fuzzy = F.transform("near_", close) if "fuzzy" in checks else no_issues()
    rows = rows.withColumn("plain_", F.concat(exact, fuzzy))
    rows = with_meanings(rows, "plain_", "line_", "meant_", pack) if "semantic" in checks else rows.withColumn("meant_", no_issues())
    order = [F.transform(ordering_array(text, t), segment(t)) for t in _ordering(pack)] if "ordering" in checks else []
    banned = banned_array(text, pack) if "banned" in checks else no_issues()
    rows = rows.withColumn("all_", F.concat(protect_array(F.concat("plain_", "meant_"), F.col("hits_")), *order, banned))
    kept = cutting(text, lambda n, cut: F.filter("all_", lambda x: suppression(x, text, F.col("quotes_"), F.col("line_"), pack, cut=cut).isNull()))
    rows = rows.withColumn("term_issues", kept).withColumn("suppressed", F.size("all_") - F.size("term_issues"))
    return rows.drop("hits_", "votes_", "quotes_", "line_", "near_", "plain_", "meant_", "all_")


def term_issues(docs: DataFrame, pack: Pack = LATIN, checks: Sequence[str] = CHECKS) -> DataFrame:
    """The engine over documents, as the fact table."""
    rows = docs.select("doc_id", TEXT().alias("text"), sentence_array(TEXT(), pack).alias("sents"), paragraph_array(TEXT(), pack).alias("paras"))
    return explode_issues(with_terms(rows, pack, checks), "term", F.col("term_issues"))


LEVELS = ("term", "fuzzy", "semantic", "order")


def level_counts(issues: DataFrame) -> DataFrame:
    """Issues per document and level."""
    level = F.split_part("rule_id", F.lit("-"), F.lit(1))
    named = [F.count_if(level == k).alias(k) for k in LEVELS]
    return issues.filter("engine = 'term'").groupBy("doc_id").agg(*named, F.count_if(~level.isin(*LEVELS)).alias("banned"), F.count("*").alias("final"))
