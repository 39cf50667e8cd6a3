"""Dimension scores, gate, counts, summaries, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.functions.offsets import let
from proofloom.rules import DIMENSION_OF, DIMENSIONS, SEVERITY_ORDER, SEVERITY_SCORE
from proofloom.schema import by_severity, penalty, weight

SEVERITIES = list(SEVERITY_ORDER)


def dimension_of(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in DIMENSION_OF.items() for x in kv])[category]


def dimension_scores(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, dimension, penalty, score and severity counts: every document has every dimension."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES]
    sums = issues.groupBy("doc_id", dimension_of(F.col("category")).alias("dimension")).agg(F.sum(penalty()).alias("penalty"), *counts)
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(s).alias("scale"), F.lit(w).alias("weight")) for d, (s, w) in DIMENSIONS.items()])
    grid = docs.select("doc_id", F.explode(dims).alias("d")).select(F.col("doc_id").alias("id"), "d.*")
    zeros = {c: 0 for c in ("penalty", *(f"n_{s.lower()}" for s in SEVERITIES))}
    rows = grid.join(sums, F.col("id").eqNullSafe(F.col("doc_id")) & (grid["dimension"] == sums["dimension"]), "left").drop(sums["dimension"], sums["doc_id"]).withColumnRenamed("id", "doc_id").fillna(zeros)
    return rows.withColumn("score", 100 * F.exp(-F.col("penalty") / F.col("scale")))


def _is(severity: str):
    return lambda x: x["severity"] == severity


def _adding(name: str):
    return lambda total, x: total + x[name]


def score_array(issues: Column) -> Column:
    """Array of (dimension, penalty, score, n_fatal, n_major, n_minor, n_info) of one document's issues, all dimensions
    (O17)."""
    def of(name: str, scale: float, share: float) -> Column:
        def told(own: Column) -> Column:
            counts = [F.size(F.filter(own, _is(s))).cast("bigint").alias(f"n_{s.lower()}") for s in SEVERITIES]
            lost = F.aggregate(own, F.lit(0.0), lambda a, x: a + by_severity(SEVERITY_SCORE, x["severity"]))
            return let(F.struct(lost.alias("x")), lambda p: F.struct(F.lit(name).alias("dimension"), p["x"].alias("penalty"), (100 * F.exp(-p["x"] / scale)).alias("score"), F.lit(share).alias("weight"), *counts))

        kinds = [k for k, d in DIMENSION_OF.items() if d == name]
        return let(F.filter(issues, lambda x: x["category"].isin(*kinds)), told)

    return F.array(*[of(d, scale, w) for d, (scale, w) in DIMENSIONS.items()])


def overall(dims: Column) -> Column:
    """(overall, n_fatal, n_major, n_minor, n_info, gate) of an array of dimensions."""
    total = F.aggregate(dims, F.lit(0).cast("decimal(20,3)"), lambda a, d: (a + F.round(d["score"], 1).cast("decimal(10,1)") * d["weight"].cast("decimal(4,2)")).cast("decimal(20,3)")).cast("double")
    counts = {f"n_{s.lower()}": F.aggregate(dims, F.lit(0).cast("bigint"), _adding(f"n_{s.lower()}")) for s in SEVERITIES}
    told = F.struct(total.alias("overall"), *[c.alias(k) for k, c in counts.items()])
    return let(told, lambda x: x.withField("gate", gate(x["n_fatal"], x["n_major"], x["overall"])))


def document_scores(dims: DataFrame) -> DataFrame:
    """doc_id, overall (weighted mean of scores rounded to one place), counts, gate."""
    counts = [F.sum(f"n_{s.lower()}").alias(f"n_{s.lower()}") for s in SEVERITIES]
    rows = dims.groupBy("doc_id").agg(F.sum(F.round("score", 1).cast("decimal(10,1)") * F.col("weight").cast("decimal(4,2)")).cast("double").alias("overall"), *counts)
    return rows.withColumn("gate", gate(F.col("n_fatal"), F.col("n_major"), F.col("overall")))


def gate(fatal: Column, major: Column, overall: Column) -> Column:
    return F.when(fatal > 0, "BLOCK").when((overall < 75) | (major > 5), "REVIEW").otherwise("PASS")


def summaries(issues: DataFrame, top: int = 8) -> DataFrame:
    """doc_id, summary: the gravest findings, at most `top`, in order."""
    grave = issues.filter(F.col("severity").isin("FATAL", "MAJOR"))
    items = F.slice(F.array_sort(F.collect_list(F.struct((-weight()).alias("w"), "start", "rule_id", "message"))), 1, top)
    return grave.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda x: F.concat(x["rule_id"], F.lit(": "), x["message"])), "; ").alias("summary"))


def severity_pivot(issues: DataFrame, by: str = "category") -> DataFrame:
    """Counts of severities as columns, one row per `by`."""
    return issues.groupBy(by).pivot("severity", SEVERITIES).count().fillna(0)


def score_rollup(issues: DataFrame) -> DataFrame:
    """Counts by dimension and severity with subtotals and the grand total, named ALL."""
    rows = issues.select(dimension_of(F.col("category")).alias("dimension"), "severity").rollup("dimension", "severity").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("dimension", F.lit("ALL")).alias("dimension"), F.coalesce("severity", F.lit("ALL")).alias("severity"), "n")


def node_trace(issues: DataFrame) -> DataFrame:
    """engine, n, and a line of severity counts of each engine."""
    rows = issues.groupBy("engine").agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return rows.select("engine", "n", F.format_string("FATAL %d, MAJOR %d, MINOR %d, INFO %d", *SEVERITIES).alias("line"))


def browse(issues: DataFrame, severities: tuple[str, ...] = (), categories: tuple[str, ...] = (), order: str = "severity") -> DataFrame:
    """Issues filtered by severity and category, gravest first or in text order."""
    out = issues
    if severities:
        out = out.filter(F.col("severity").isin(*severities))
    if categories:
        out = out.filter(F.col("category").isin(*categories))
    keys = (F.desc(weight()), "doc_id", "start") if order == "severity" else ("doc_id", "start", "end")
    return out.orderBy(*keys)


def latest(history: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return history.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def trend(history: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """History with the change of `value` since the row before of its key."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return history.withColumn("change", F.col(value) - F.lag(value).over(w))
