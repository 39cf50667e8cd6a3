"""Overlaps, conflicts, repeats, filters, positions of issues.

What holds within one document is an expression over its array of issues, so that no issue is shuffled; the functions over
DataFrames are for issues that come as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.functions.offsets import cutting, first_of_runs, let, scan
from proofloom.operators.parse import line_numbers, piece_indices
from proofloom.rules import SEVERITY_ORDER
from proofloom.schema import by_severity, entries, fingerprint, weight


def severity_weight(x: Column) -> Column:
    return by_severity(SEVERITY_ORDER, x["severity"])


def _clash(a: Column, b: Column, exempt_global: bool) -> Column:
    point = (a["start"] == a["end"]) | (b["start"] == b["end"])
    hit = F.when(point, a["start"] == b["start"]).otherwise((a["start"] < b["end"]) & (b["start"] < a["end"]))
    if exempt_global:
        hit = hit & ~((a["start"] == 0) & (a["end"] == 0) | (b["start"] == 0) & (b["end"] == 0))
    return hit


def resolve_array(issues: Column, exempt_global: bool = False) -> Column:
    """Issues of one document and engine that are kept greedily: heavier first, then longer, then by rule, start and
    message; one that overlaps a kept one goes (O01). A zero-length issue overlaps only what starts where it does.

    Only issues of one connected run of spans can clash, so each run is folded by itself. exempt_global keeps issues with
    the span 0-0 apart, so that global findings don't hide each other.
    """
    placed = F.sort_array(F.transform(issues, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x.alias("row"))))
    order = lambda x: F.struct((-severity_weight(x)).alias("o1"), (x["start"] - x["end"]).alias("o2"), x["rule_id"].alias("o3"), x["start"].alias("o4"), x["message"].alias("o5"), x.alias("row"))

    def greedy(run: Column) -> Column:
        ordered = F.transform(F.sort_array(F.transform(run, lambda x: order(x["row"]))), lambda x: x["row"])
        return let(ordered, lambda a: F.aggregate(F.slice(a, 2, F.size(a)), F.slice(a, 1, 1), lambda kept, x: F.when(F.exists(kept, lambda k: _clash(k, x, exempt_global)), kept).otherwise(F.array_append(kept, x))))

    def runs(a: Column) -> Column:
        reach = scan(F.transform(a, lambda x: x["end"]), -1, F.greatest)
        opens = F.filter(F.zip_with(F.transform(a, lambda x, i: F.struct(i.alias("i"), x["start"].alias("start"))), reach, lambda x, r: F.when((x["i"] == 0) | ((x["start"] >= r) & (x["start"] != F.get(a, x["i"] - 1)["start"])), x["i"])), lambda i: i.isNotNull())
        cut = lambda o: F.transform(o, lambda i, n: F.slice(a, i + 1, F.coalesce(F.get(o, n + 1), F.size(a)) - i))
        return F.flatten(F.transform(let(opens, cut), lambda run: F.when(F.size(run) == 1, F.transform(run, lambda x: x["row"])).otherwise(greedy(run))))

    return let(placed, lambda a: F.when(F.size(a) == 0, F.transform(a, lambda x: x["row"])).otherwise(runs(a)))


def resolve_overlaps(issues: DataFrame, by: tuple[str, ...] = ("doc_id", "engine"), exempt_global: bool = False) -> DataFrame:
    """O01 over rows of issues: those of one document and engine together."""
    columns = [c for c in issues.columns if c not in by]
    held = issues.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("items"))
    return held.select(*by, F.explode(resolve_array(F.col("items"), exempt_global)).alias("x")).select(*by, "x.*").select(*issues.columns)


def annotate_array(issues: Column, text: Column, paras: Column) -> Column:
    """Issues with line, paragraph (0 if none), the text their span covers as original, and what the rule gave in
    `sentence`, if that was other (O02)."""
    bounds = F.transform(paras, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end")))

    def placed(a: Column, n: Column, cut_at: Callable[[Column, Column], Column]) -> Column:
        at = F.transform(a, lambda x: F.least(F.greatest(x["start"], F.lit(0)), n))
        where = let(at, lambda p: F.arrays_zip(line_numbers(p, text).alias("line"), piece_indices(p, bounds).alias("paragraph")))

        def told(x: Column, w: Column) -> Column:
            def of_cut(cut: Column) -> Column:  # null if there is none
                given = F.when(cut.isNotNull() & (x["original"] != "") & (x["original"] != cut), x["original"]).otherwise("")
                return x.withField("original", F.coalesce(cut, x["original"])).withField("line", w["line"]).withField("paragraph", F.greatest(w["paragraph"], F.lit(0))).withField("sentence", given)

            return let(F.when((x["end"] > x["start"]) & (x["end"] <= n), cut_at(x["start"], x["end"])), of_cut)

        return F.zip_with(a, where, told)

    return let(issues, lambda a: cutting(text, lambda n, cut: placed(a, n, cut)))


def annotate(issues: DataFrame, docs: DataFrame, paras: Column) -> DataFrame:
    """O02 over rows of issues; paras: an expression over docs (`parse.paragraph_array`)."""
    columns = [c for c in issues.columns if c != "doc_id"]
    held = issues.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("items"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(held.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")))
    return entries(rows, annotate_array(F.col("items"), text, paras))


#: Categories whose issues may have no span.
GLOBAL_CATEGORIES = ("format", "reference", "style", "logic")


def reject_reason(x: Column, n: Column, cut_at: Callable[[Column, Column], Column]) -> Column:
    """Why an issue (a struct) cannot stand: no change, empty span, out of range, drift of its original from the text; null
    if it can (O06). n, cut_at: what `cutting` gives of the text."""
    cut = F.trim(cut_at(x["start"], x["end"]))
    own = F.trim(x["original"])
    drift = (x["end"] > x["start"]) & (x["original"] != "") & ~F.contains(own, cut) & ~F.contains(cut, own)
    same = (x["suggestion"] != "") & (x["suggestion"] == x["original"])
    empty = (x["end"] <= x["start"]) & ~x["category"].isin(*GLOBAL_CATEGORIES)
    return F.when(same, "no-change").when(empty, "empty-span").when((x["start"] < 0) | (x["end"] > n), "out-of-range").when(drift, "drift")


def review(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """All issues with `rejected`, the reason or null (O06). For issues that come as rows: those of a document
    meet its text together, so that no text is copied for each of them."""
    texts = docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("doc_text"))
    held = issues.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in issues.columns if c != "doc_id"])).alias("items"))
    rows = texts.join(held, F.col("doc_id").eqNullSafe(F.col("d")))
    told = lambda n, cut: F.transform("items", lambda x: x.withField("rejected", reject_reason(x, n, cut)))
    return entries(rows, cutting(F.col("doc_text"), told)).select(*issues.columns, "rejected")


def conflict_array(issues: Column) -> Column:
    """One issue per span, or per rule if it has no length: the heaviest, most confident, with the longest suggestion, the
    first of equals (O07)."""
    keyed = F.transform(issues, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["start"] == x["end"], x["rule_id"]).otherwise("").alias("rule"), (-severity_weight(x)).alias("o1"), (-x["confidence"]).alias("o2"), (-F.length(x["suggestion"])).alias("o3"), i.alias("i"), x.alias("row")))
    point = lambda x: x["start"] == x["end"]
    same = lambda a, b: (point(a) & point(b) & (a["rule"] == b["rule"])) | (~point(a) & (a["start"] == b["start"]) & (a["end"] == b["end"]))
    spans = first_of_runs(F.sort_array(F.filter(keyed, lambda x: ~point(x))), same)
    points = first_of_runs(F.sort_array(F.transform(F.filter(keyed, point), lambda x: F.struct(x["rule"].alias("rule"), *[x[c].alias(c) for c in ("o1", "o2", "o3", "i", "start", "end", "row")]))), lambda a, b: a["rule"] == b["rule"])
    return F.concat(F.transform(spans, lambda x: x["row"]), F.transform(points, lambda x: x["row"]))


def resolve_conflicts(issues: DataFrame) -> DataFrame:
    """O07 over rows of issues."""
    key = F.when(F.col("start") == F.col("end"), F.concat(F.lit("rule:"), "rule_id")).otherwise(F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string")))
    w = Window.partitionBy("doc_id", "key").orderBy(F.desc(weight()), F.desc("confidence"), F.desc(F.length("suggestion")), "issue_id")
    return issues.withColumn("key", key).withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("key", "nth")


def is_grave(x: Column) -> Column:
    return x["severity"].isin("FATAL", "MAJOR")


def critic_array(issues: Column, text: Column, rounds: int = 2) -> Column:
    """At most two rounds, unrolled: rejects and conflicts; then, where a grave issue remains, only grave or confident ones
    stay (O06-O09)."""
    stands = lambda n, cut: F.filter(issues, lambda x: reject_reason(x, n, cut).isNull())
    kept = conflict_array(cutting(text, stands))
    if rounds < 2:
        return kept
    return let(kept, lambda a: F.when(F.exists(a, is_grave), F.filter(a, lambda x: is_grave(x) | (x["confidence"] >= 0.6))).otherwise(a))


def dedup_array(issues: Column) -> Column:
    """One issue per rule, span and original, the heaviest (O15), by place."""
    keyed = F.sort_array(F.transform(issues, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rule_id"].alias("rule"), x["original"].alias("original"), (-severity_weight(x)).alias("o1"), (-x["confidence"]).alias("o2"), x.alias("row"))))
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["rule"] == b["rule"]) & (a["original"] == b["original"])
    return F.transform(first_of_runs(keyed, same), lambda x: x["row"])


def reportable_array(issues: Column, least: float = 0.6) -> Column:
    """Without informational issues that are not confident."""
    return F.filter(issues, lambda x: (x["severity"] != "INFO") | (x["confidence"] >= least))


def second_round(issues: DataFrame, least: float = 0.6) -> DataFrame:
    """What a second review keeps: grave or confident issues."""
    return issues.filter(F.col("severity").isin("FATAL", "MAJOR") | (F.col("confidence") >= least))


def verdict_targets(issues: DataFrame, least: float = 0.92, top: int = 12) -> DataFrame:
    """Issues that a judge is asked about: close and similar terms of confidence below `least`, and the `top` gravest of
    each document (O10)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(weight()), F.desc("confidence"), "issue_id")
    grave = issues.filter(F.col("severity").isin("FATAL", "MAJOR")).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top).drop("nth")
    unsure = issues.filter(F.col("rule_id").rlike("^(fuzzy|semantic)-") & (F.col("confidence") < least))
    return grave.unionByName(unsure).dropDuplicates(["doc_id", "issue_id"])


def apply_verdicts(issues: DataFrame, verdicts: DataFrame, least: float = 0.92, top: int = 12) -> DataFrame:
    """issues with the verdicts (issue_id, doc_id, accept, note) of a judge on verdict_targets: a refused issue falls to INFO
    and is marked, not dropped; other verdicts count nothing (O10, M01). Without a judge pass an empty table."""
    asked = verdict_targets(issues, least, top).select("doc_id", "issue_id")
    heard = verdicts.join(asked, ["doc_id", "issue_id"], "left_semi")
    rows = issues.join(heard, ["doc_id", "issue_id"], "left")
    refused = F.coalesce(~F.col("accept"), F.lit(False))
    return rows.withColumn("severity", F.when(refused, "INFO").otherwise(F.col("severity"))).withColumn("refused", refused).drop("accept")


def fact_checks(issues: DataFrame) -> DataFrame:
    """doc_id, issue_id, kind, verdict: what a check of the issue's facts says by its kind."""
    kind = F.when(F.col("category") == "data", "data").when(F.col("rule_id").startswith("ref-") | F.col("rule_id").startswith("un"), "reference").when(F.col("category").isin("term", "political"), "term").otherwise("other")
    verdict = F.when(kind == "data", "recomputed").when(kind == "reference", "needs-source").when((kind == "term") & F.col("original").rlike('^["“]'), "quoted").when(kind == "term", "confirmed").otherwise("unchecked")
    return issues.select("doc_id", "issue_id", kind.alias("kind"), verdict.alias("verdict"))


def deduplicate(issues: DataFrame) -> DataFrame:
    """One issue per fingerprint, the heaviest."""
    w = Window.partitionBy("doc_id", "print").orderBy(F.desc(weight()), F.desc("confidence"), "issue_id")
    return issues.withColumn("print", fingerprint()).withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("print", "nth")


def reportable(issues: DataFrame, least: float = 0.6, suppressed: DataFrame | None = None) -> DataFrame:
    """Without informational issues that are suppressed or not confident."""
    out = issues.filter((F.col("severity") != "INFO") | (F.col("confidence") >= least))
    if suppressed is not None:
        info = out.filter("severity = 'INFO'").join(suppressed, ["doc_id", "issue_id"], "left_anti")
        out = out.filter("severity != 'INFO'").unionByName(info)
    return out
