"""Sinks: reports, histories, snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.operators.revise import escape_html, highlight
from proofloom.schema import weight
from proofloom.sources.files import docx_bytes, pdf_bytes

ISSUE_FIELDS = ("issue_id", "engine", "category", "severity", "rule_id", "message", "start", "end", "original", "suggestion", "explain", "confidence")


def issue_lines() -> Column:
    """One line of text for an issue."""
    return F.format_string("[%s] %s: %s (%d-%d) %s", "severity", "rule_id", "message", "start", "end", "original")


def json_reports(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, json: score, gate and ordered issues of each document."""
    rows = issues.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-weight()).alias("w"), "start", F.struct(*ISSUE_FIELDS).alias("issue")))), lambda x: x["issue"]).alias("issues"))
    return scores.join(rows, "doc_id", "left").select("doc_id", F.to_json(F.struct("doc_id", "overall", "gate", "n_fatal", "n_major", "n_minor", "n_info", F.coalesce("issues", F.array().cast(rows.schema["issues"].dataType)).alias("issues"))).alias("json"))


def markdown_reports(scores: DataFrame, dims: DataFrame, issues: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, markdown: heading, gate, dimensions, counts, summary, findings, advice."""
    d = dims.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("| %s | %.1f |", "dimension", "score"))), "\n").alias("dims"))
    i = issues.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-weight()).alias("w"), "start", F.concat(F.lit("- "), issue_lines()).alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("explain") != "", F.concat(F.lit("- "), "explain")))), "\n").alias("advice"))
    rows = scores.join(d, "doc_id", "left").join(i, "doc_id", "left").join(summaries, "doc_id", "left")
    text = F.concat_ws("\n\n", F.format_string("# Audit of %s", F.col("doc_id").cast("string")), F.format_string("## 1 Gate\n\n%s at %.1f", "gate", "overall"), F.concat(F.lit("## 2 Dimensions\n\n| dimension | score |\n|---|---|\n"), F.coalesce("dims", F.lit(""))), F.format_string("## 3 Counts\n\nfatal %d, major %d, minor %d, info %d", "n_fatal", "n_major", "n_minor", "n_info"), F.concat(F.lit("## 4 Summary\n\n"), F.coalesce("summary", F.lit("nothing grave"))), F.concat(F.lit("## 5 Findings\n\n"), F.coalesce("lines", F.lit("none"))), F.concat(F.lit("## 6 Advice\n\n"), F.coalesce("advice", F.lit("none"))), F.lit("## 7 Note\n\nMade by rules."))
    return rows.select("doc_id", text.alias("markdown"))


def sections(scores: DataFrame, dims: DataFrame, issues: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, gate, overall, counts, and the parts that reports share: dims, lines and advice as arrays, summary."""
    d = dims.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("dimension", "score"))).alias("dims"))
    line = F.struct((-weight()).alias("w"), "start", issue_lines().alias("line"))
    i = issues.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"), F.array_sort(F.collect_set(F.when(F.col("explain") != "", F.col("explain")))).alias("advice"), F.array_sort(F.collect_set(F.struct("rule_id", "source"))).alias("rules"))
    empty = F.array().cast("array<string>")
    rows = scores.join(d, "doc_id", "left").join(i, "doc_id", "left").join(summaries, "doc_id", "left")
    return rows.withColumn("lines", F.coalesce("lines", empty)).withColumn("advice", F.coalesce("advice", empty)).withColumn("summary", F.coalesce("summary", F.lit("nothing grave")))


def html_reports(scores: DataFrame, docs: DataFrame, issues: DataFrame, dims: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, html: eight sections: gate, dimensions, counts, summary, findings, advice, rules, manuscript."""
    marked = highlight(docs, issues).withColumnRenamed("html", "body")
    rows = sections(scores, dims, issues, summaries).join(marked, "doc_id")
    items = lambda c: F.concat(F.lit("<ul>"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("<li>"), escape_html(x), F.lit("</li>"))), ""), F.lit("</ul>"))
    table = F.concat(F.lit("<table>"), F.array_join(F.transform(F.coalesce("dims", F.array().cast("array<struct<dimension:string,score:double>>")), lambda x: F.format_string("<tr><td>%s</td><td>%.1f</td></tr>", x["dimension"], x["score"])), ""), F.lit("</table>"))
    rules = F.transform(F.coalesce("rules", F.array().cast("array<struct<rule_id:string,source:string>>")), lambda x: F.concat(x["rule_id"], F.lit(": "), x["source"]))
    parts = {
        "Gate": F.format_string("<p class=\"gate\">%s %.1f</p>", "gate", "overall"), "Dimensions": table, "Counts": F.format_string("<p>fatal %d, major %d, minor %d, info %d</p>", "n_fatal", "n_major", "n_minor", "n_info"),
        "Summary": F.concat(F.lit("<p>"), escape_html(F.col("summary")), F.lit("</p>")), "Findings": items(F.col("lines")), "Advice": items(F.col("advice")), "Rules": items(rules),
        "Manuscript": F.concat(F.lit("<pre>"), "body", F.lit("</pre>")),
    }
    whole = [F.concat(F.lit(f"<section><h2>{n} {name}</h2>"), part, F.lit("</section>")) for n, (name, part) in enumerate(parts.items(), 1)]
    head = F.format_string("<!DOCTYPE html><html><head><meta charset=\"utf-8\"></head><body><h1>Audit of %s</h1>", escape_html(F.col("doc_id").cast("string")))
    return rows.select("doc_id", F.concat(head, *whole, F.lit("</body></html>")).alias("html"))


def file_reports(markdown: DataFrame, kind: str) -> DataFrame:
    """doc_id, content: reports (doc_id, markdown) as Word (docx) or PDF files."""
    make = {"docx": docx_bytes, "pdf": pdf_bytes}[kind]

    @F.pandas_udf("binary")
    def content(texts: pd.Series) -> pd.Series:
        return pd.Series([make(t.split("\n")) for t in texts])

    return markdown.select("doc_id", content("markdown").alias("content"))


def write_reports(reports: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each format in a folder of its name: doc_id and the report as Parquet rows, from which `report_of` picks one."""
    for name, df in reports.items():
        df.select("doc_id", F.col(df.columns[1]).alias("report")).write.mode(mode).parquet(f"{path}/{name}")


def report_of(spark, path: str, fmt: str, doc_id) -> str | bytes | None:
    """The written report of one document."""
    row = spark.read.parquet(f"{path}/{fmt}").filter(F.col("doc_id") == doc_id).first()
    return row and row["report"]


def append_history(rows: DataFrame, path: str) -> None:
    """Append to a history of JSON lines."""
    rows.write.mode("append").json(path)


def export_snapshot(terms: DataFrame, path: str) -> None:
    """A rule set as JSON lines."""
    terms.write.mode("overwrite").json(path)


def write_pending(found: DataFrame, path: str) -> None:
    """Candidates that wait for approval."""
    found.write.mode("append").parquet(path)


def exit_code(gates: list[str]) -> int:
    """0 if all passed, else 1; callers return 2 for input that cannot be read."""
    return int(any(g != "PASS" for g in gates))
