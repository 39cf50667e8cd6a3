"""Text revision and highlighted manuscripts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.operators.resolve import resolve_overlaps

#: Openings of advice that is not a replacement.
ADVICE_OPENINGS = ("use ", "write ", "drop ", "remove ", "name ", "start ", "choose ", "adjust ")


def autofixable() -> Column:
    """Whether an issue's suggestion can be put in its place without a reader: replacement and advice are separate, the
    span is real, the text changes, and the issue is not a mere hint (O12)."""
    advice = F.lit(False)
    for opening in ADVICE_OPENINGS:
        advice = advice | F.startswith(F.lower("suggestion"), F.lit(opening))
    return (F.col("end") > F.col("start")) & (F.col("suggestion") != "") & (F.col("suggestion") != F.col("original")) & (F.col("severity") != "INFO") & ~advice


def edits_of(issues: DataFrame) -> DataFrame:
    """Edits that don't overlap: doc_id, start, end, before, after, rule_id."""
    chosen = resolve_overlaps(issues.filter(autofixable()), by=("doc_id",))
    return chosen.select("doc_id", "start", "end", F.col("original").alias("before"), F.col("suggestion").alias("after"), "rule_id")


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, revised, n_applied, n_skipped: edits from right to left; one that runs into the last or whose slice is
    not what it was made for is skipped (O13). Texts without edits come back unchanged;
    rows without an id get the edits without one."""
    per_doc = edits.groupBy(F.col("doc_id").alias("d")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "before", "after")), asc=False).alias("edits"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    start = F.struct(F.array().cast("array<string>").alias("tail"), F.length("text").alias("cursor"), F.lit(0).alias("done"), F.lit(0).alias("skipped"))

    def step(acc: Column, e: Column) -> Column:
        fits = (e["end"] <= acc["cursor"]) & (F.substring("text", e["start"] + 1, e["end"] - e["start"]) == e["before"])
        after = F.concat(F.array(F.concat(e["after"], F.substring("text", e["end"] + 1, acc["cursor"] - e["end"]))), acc["tail"])
        applied = F.struct(after.alias("tail"), e["start"].alias("cursor"), (acc["done"] + 1).alias("done"), acc["skipped"].alias("skipped"))
        passed = F.struct(acc["tail"].alias("tail"), acc["cursor"].alias("cursor"), acc["done"].alias("done"), (acc["skipped"] + 1).alias("skipped"))
        return F.when(fits, applied).otherwise(passed)

    folded = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,before:string,after:string>>")), start, step)
    out = rows.withColumn("f", folded)
    return out.select("doc_id", F.concat(F.substring("text", F.lit(1), F.col("f.cursor")), F.array_join("f.tail", "")).alias("revised"), F.col("f.done").cast("bigint").alias("n_applied"), F.col("f.skipped").cast("bigint").alias("n_skipped"))


def unified_diff(before: Column, after: Column) -> Column:
    """Line diff of two texts."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), "before", "after", lineterm="")) for x, y in zip(a, b, strict=True)])

    return diff(before, after)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, html: the text with marked spans; by start, longest first, a span that begins inside a marked one is left
    out and does not extend it (K04)."""
    spans = issues.filter("end > start").groupBy(F.col("doc_id").alias("d")).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg"), "severity", "rule_id"))).alias("spans"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(spans, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("cursor"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["neg"]
        piece = F.concat(acc["out"], escape_html(F.substring("text", acc["cursor"] + 1, s["start"] - acc["cursor"])), F.lit('<mark class="'), F.lower(s["severity"]), F.lit('">'), escape_html(F.substring("text", s["start"] + 1, end - s["start"])), F.lit("</mark>"))
        return F.when(s["start"] < acc["cursor"], acc).otherwise(F.struct(piece.alias("out"), end.alias("cursor")))

    empty = F.array().cast("array<struct<start:int,neg:int,severity:string,rule_id:string>>")
    out = rows.withColumn("f", F.aggregate(F.coalesce("spans", empty), start, step))
    return out.select("doc_id", F.concat("f.out", escape_html(F.substring("text", F.col("f.cursor") + 1, F.length("text")))).alias("html"))
