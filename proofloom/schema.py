"""Columns of the fact table of issues and small expressions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.rules import SEVERITY_ORDER, SEVERITY_SCORE

ISSUE_COLUMNS = ("issue_id", "doc_id", "engine", "category", "severity", "rule_id", "message", "start", "end", "original", "suggestion", "explain", "source", "confidence")


def by_severity(table: dict, severity: Column | None = None) -> Column:
    severity = F.col("severity") if severity is None else severity
    out = None
    for name, value in table.items():
        out = F.when(severity == name, F.lit(value)) if out is None else out.when(severity == name, F.lit(value))
    return out


def weight() -> Column:
    """Ordering weight of an issue's severity."""
    return by_severity(SEVERITY_ORDER)


def penalty() -> Column:
    """Scoring weight of an issue's severity: informational issues count half."""
    return by_severity(SEVERITY_SCORE)


def issue_id(rule: Column, start: Column, end: Column) -> Column:
    return F.concat(rule, F.lit("#"), F.substring(F.md5(F.concat_ws("|", rule, start.cast("string"), end.cast("string"))), 1, 10))


def fingerprint() -> Column:
    """Identity for removing repeats: rule, span and original."""
    return F.substring(F.md5(F.concat_ws("|", "rule_id", F.col("start").cast("string"), F.col("end").cast("string"), "original")), 1, 12)


ISSUE_TYPE = "struct<rule_id:string,category:string,severity:string,message:string,start:int,end:int,original:string,suggestion:string,explain:string,source:string,confidence:double>"


def issue(rule_id: Column | str, start: Column | int, end: Column | int, category: Column | str, severity: Column | str = "MINOR", message: Column | str = "", original: Column | str = "", suggestion: Column | str = "", explain: Column | str = "", source: Column | str = "rule", confidence: Column | float = 0.8) -> Column:
    """One issue as a struct of ISSUE_TYPE; what is no column is a literal."""
    given = {"rule_id": rule_id, "category": category, "severity": severity, "message": message, "start": start, "end": end, "original": original, "suggestion": suggestion, "explain": explain, "source": source, "confidence": confidence}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in given.items()]).cast(ISSUE_TYPE)


def no_issues() -> Column:
    return F.array().cast(f"array<{ISSUE_TYPE}>")


def issues_where(condition: Column, found: Column) -> Column:
    """An array with the issue if the condition holds."""
    return F.when(condition, F.array(found)).otherwise(no_issues())


def entries(rows: DataFrame, array: Column, *keys: str) -> DataFrame:
    """keys and the fields of each entry of an array of structs. The array becomes a column first and is exploded by an outer
    explode: of an inner one the optimizer would infer a filter on its size, compute it twice, and lose Python functions in
    it."""
    keys = keys or ("doc_id",)
    made = rows.select(*keys, array.alias("entry_")).select(*keys, F.explode_outer("entry_").alias("x"))
    return made.filter("x IS NOT NULL").select(*keys, "x.*")


def explode_issues(rows: DataFrame, engine: str, issues: Column) -> DataFrame:
    """rows with doc_id, and an array of issues for each: the fact table."""
    x = entries(rows, issues)
    made = {"issue_id": issue_id(F.col("rule_id"), F.col("start"), F.col("end")), "engine": F.lit(engine)}
    return x.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in ISSUE_COLUMNS])


def make_issues(hits: DataFrame, engine: str, **given: Column | str | float) -> DataFrame:
    """hits with doc_id, start, end and any issue columns, completed to ISSUE_COLUMNS. Strings given are literals."""
    defaults: dict[str, Column] = {"engine": F.lit(engine), "category": F.lit("language"), "severity": F.lit("MINOR"), "message": F.lit(""), "original": F.lit(""), "suggestion": F.lit(""), "explain": F.lit(""), "source": F.lit("rule"), "confidence": F.lit(0.8)}
    out = {c: (F.col(c) if c in hits.columns else d) for c, d in defaults.items()}
    out |= {k: (v if isinstance(v, Column) else F.lit(v)) for k, v in given.items()}
    rule = out.pop("rule_id", F.col("rule_id") if "rule_id" in hits.columns else F.lit("rule"))
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    columns = {"issue_id": issue_id(rule, start, end), "doc_id": F.col("doc_id"), "rule_id": rule, "start": start, "end": end} | out
    columns["confidence"] = columns["confidence"].cast("double")
    return hits.select(*[columns[c].alias(c) for c in ISSUE_COLUMNS])
