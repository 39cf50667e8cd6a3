"""The audit: intake, routing, engines, resolution, review, scores, revision.

All that belongs to one document is made in its row: sentences, paragraphs and references once, each engine's issues as an
array, then resolution, exemption of references, annotation, review and scores as expressions over these arrays. So the plan
is one scan without a shuffle or a join, no text moves, and rows with equal or missing ids stay apart.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.offsets import quickly
from proofloom.operators import academic, logic, norm, resolve, revise, score, similarity, style, terms
from proofloom.operators.corpus import FingerprintStore, with_matches
from proofloom.operators.parse import TEXT, any_of, body_text, paragraph_array, reference_array, reference_offset, sentence_array, window_array
from proofloom.rules import LATIN, Pack
from proofloom.schema import ISSUE_COLUMNS, entries, issue_id, no_issues
from proofloom.sources import sinks

Corpus = DataFrame | FingerprintStore | Sequence[tuple[str, str]]
ENGINES = ("term", "norm", "logic", "academic", "style")
#: The checks of each engine; a subset turns the others off, and they then never enter the plan.
CHECKS = {"term": terms.CHECKS, "norm": norm.CHECKS, "logic": logic.CHECKS, "academic": (*academic.CHECKS, "duplicates"), "style": style.CHECKS}


def intake_struct(text: Column, pack: Pack = LATIN) -> Column:
    """Struct of n_chars, digit_density, n_refs, quote_ratio, is_academic, doc_type."""
    n = F.length(text)
    ratio = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)).cast("double") / F.when(n > 0, n), F.lit(0.0))
    refs = F.regexp_count(text, F.lit(r"\[\d{1,3}\]"))
    academic_like = (refs >= 2) | text.rlike(pack.reference_head)
    facts = F.struct(n.cast("bigint").alias("n_chars"), ratio(r"\d").alias("digit_density"), refs.cast("bigint").alias("n_refs"), ratio('["“”]').alias("quote_ratio"), academic_like.alias("is_academic"))
    kind = lambda x: F.when(x["is_academic"], "paper").when(x["digit_density"] > 0.05, "report").when(x["n_chars"] < 400, "note").otherwise("article")
    return F.element_at(F.transform(F.array(facts), lambda x: x.withField("doc_type", kind(x))), 1)


def intake(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id and the intake profile."""
    return docs.select("doc_id", intake_struct(TEXT(), pack).alias("x")).select("doc_id", "x.*")


def route(profile: Column, engine: str) -> Column:
    """Whether an engine looks at a document of this profile."""
    return {
        "term": F.lit(True), "norm": F.lit(True), "logic": profile["n_chars"] >= 40, "academic": profile["is_academic"] | (profile["digit_density"] > 0),
        "style": profile["n_chars"] >= 100,
    }[engine]


def routes(profile: DataFrame) -> DataFrame:
    """doc_id and a boolean run_<engine> for each engine."""
    x = F.struct("n_chars", "is_academic", "digit_density")
    return profile.select("doc_id", *[route(x, e).alias(f"run_{e}") for e in ENGINES])


def style_targets(spark: SparkSession, pack: Pack = LATIN) -> DataFrame:
    return spark.createDataFrame([("default", *m) for m in pack.metrics], "preset string, metric string, lo double, hi double")


def parsed(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, text, sents, paras, refs, ref_start, body, windows, profile: what the engines read, made once per document."""
    rows = docs.select("doc_id", TEXT().alias("text"), sentence_array(TEXT(), pack).alias("sents"), paragraph_array(TEXT(), pack).alias("paras"), intake_struct(TEXT(), pack).alias("profile"))
    rows = rows.withColumn("refs", reference_array(F.col("paras"))).withColumn("windows", window_array(F.col("sents")))
    rows = rows.withColumn("ref_start", reference_offset(F.col("refs")))
    return rows.withColumn("body", body_text(F.col("text"), F.col("ref_start")))


def _with_engine(name: str):
    return lambda x: x.withField("engine", F.lit(name))


def engine_array(engine: str, pack: Pack, checks: Sequence[str]) -> Column:
    """An engine's raw issues over a row of `parsed`."""
    c = {n: F.col(n) for n in ("text", "sents", "paras", "refs", "body", "windows")}
    if engine == "term":
        return F.col("term_issues")
    if engine == "norm":
        return norm.norm_array(c["text"], c["body"], c["sents"], c["paras"], pack, checks)
    if engine == "logic":
        return logic.logic_array(c["windows"], c["paras"], pack, checks)
    if engine == "academic":
        found = academic.academic_array(c["text"], c["body"], c["sents"], c["paras"], c["refs"], pack, checks)
        return F.concat(found, F.col("duplicates")) if "duplicates" in checks else found
    return style.style_array(c["text"], c["sents"], c["paras"], pack, checks)


@quickly
def audited(docs: DataFrame, pack: Pack = LATIN, engines: Sequence[str] = ENGINES, checks: Mapping[str, Sequence[str]] = CHECKS, corpus: Corpus = (), least: float = 0.6, rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, raw (number of issues by engine before resolution), suppressed, found (resolved
    issues), issues (reviewed, without repeats, reportable), dimensions, and the document's scores. corpus: texts published before,
    as a table (source, text) or a FingerprintStore of any size, or as pairs that come with the plan."""
    checks = {**CHECKS, **checks}
    rows = parsed(docs, pack)
    run = lambda e: route(F.col("profile"), e)
    if "term" in engines:
        rows = terms.with_terms(rows, pack, checks["term"])
    else:
        rows = rows.withColumn("suppressed", F.lit(0))
    if "academic" in engines and "duplicates" in checks["academic"]:
        if isinstance(corpus, DataFrame):
            corpus = FingerprintStore.of(corpus)
        if isinstance(corpus, FingerprintStore):
            rows = similarity.with_duplicates(with_matches(rows, docs, corpus, "matches_", pack), found="matches_")
        else:
            rows = similarity.with_duplicates(rows, list(corpus))
    made = {e: F.when(run(e), engine_array(e, pack, checks[e])).otherwise(no_issues()) for e in engines}
    rows = rows.select("doc_id", "text", "paras", "ref_start", "suppressed", *[made[e].alias(f"raw_{e}") for e in engines])
    raw = F.array(*[F.struct(F.lit(e).alias("engine"), F.size(f"raw_{e}").alias("n")) for e in engines])
    rows = rows.withColumns({f"kept_{e}": resolve.resolve_array(F.col(f"raw_{e}")) for e in engines})
    kept = {e: F.col(f"kept_{e}") for e in engines}
    if "norm" in kept:
        kept["norm"] = norm.outside_references(kept["norm"], F.col("ref_start"))
    named = [F.transform(kept[e], _with_engine(e)) for e in engines]
    rows = rows.select("doc_id", "text", "paras", "suppressed", raw.alias("raw"), F.concat(*named).alias("found"))
    rows = rows.withColumn("found", resolve.annotate_array(F.col("found"), F.col("text"), F.col("paras")))
    rows = rows.withColumn("reviewed", resolve.critic_array(F.col("found"), F.col("text"), rounds) if rounds else F.col("found"))
    rows = rows.select("doc_id", "suppressed", "raw", "found", resolve.reportable_array(resolve.dedup_array(F.col("reviewed")), least).alias("issues"))
    rows = rows.withColumn("dimensions", score.score_array(F.col("issues")))
    return rows.withColumn("score", score.overall(F.col("dimensions")))


@dataclass(frozen=True)
class Report:
    """The tables of an audit; each is lazy. release() gives up what the executors hold. metrics() waits for the first action
    and has what it counted (`trace_metrics`): numbers of the run itself, without another one."""

    issues: DataFrame
    dimensions: DataFrame
    scores: DataFrame
    trace: DataFrame
    rows: DataFrame | None = field(default=None, repr=False)
    seen: Observation | None = field(default=None, repr=False)

    def metrics(self) -> dict[str, int]:
        return {} if self.seen is None else dict(self.seen.get)

    def release(self) -> None:
        if self.rows is not None:
            self.rows.unpersist()


def issue_rows(rows: DataFrame, column: str = "issues", extra: Sequence[str] = ()) -> DataFrame:
    """The fact table of an array of annotated issues, with line, paragraph and sentence."""
    x = entries(rows, F.col(column))
    return x.withColumn("issue_id", issue_id(F.col("rule_id"), F.col("start"), F.col("end"))).select(*ISSUE_COLUMNS, "line", "paragraph", "sentence", *extra)


def raw_issues(docs: DataFrame, pack: Pack = LATIN, engines: Sequence[str] = ENGINES, checks: Mapping[str, Sequence[str]] = CHECKS) -> DataFrame:
    """Resolved and annotated issues of the engines, each over the documents routed to it."""
    return issue_rows(audited(docs, pack, engines, checks), "found")


def audit(docs: DataFrame, pack: Pack = LATIN, engines: Sequence[str] = ENGINES, least: float = 0.6, rounds: int = 2, keep: bool = True, checks: Mapping[str, Sequence[str]] = CHECKS, corpus: Corpus = ()) -> Report:
    """Find, resolve, review, deduplicate, score. rounds 0 leaves the review out; keep holds the documents' issues, without
    their texts, on executors' disks until release(), where a lost part is made anew."""
    rows, seen = observed(audited(docs, pack, engines, checks, corpus, least, rounds), engines)
    if keep:
        rows = rows.persist(StorageLevel.DISK_ONLY)  # four tables are made of it
    dims = entries(rows, F.col("dimensions"))
    found = entries(rows, F.col("found"))
    return Report(issue_rows(rows), dims, rows.select("doc_id", "score.*"), score.node_trace(found), rows, seen)


def judged(report: Report, verdicts: DataFrame, least: float = 0.92, top: int = 12) -> Report:
    """The report after the verdicts (doc_id, issue_id, accept) of a judge: what it refuses of the issues that it was asked about
    falls to INFO and is marked `refused`; dimensions, scores and gate follow (O10). A verdict counts for every row of its
    id; issues, refused ones too, stay. Verdicts are read more than once: pass them written, not as calls still to be made."""
    same = F.col("doc_id").eqNullSafe(F.col("d_"))
    asked = resolve.verdict_targets(report.issues, least, top).select(F.col("doc_id").alias("d_"), F.col("issue_id").alias("i_"))
    heard = verdicts.filter("NOT accept").join(asked, same & (F.col("issue_id") == F.col("i_")), "left_semi")
    refused = heard.groupBy(F.col("doc_id").alias("d_")).agg(F.collect_set("issue_id").alias("refused_"))  # of one document's issues

    def told(x: Column) -> Column:
        no = F.coalesce(F.array_contains("refused_", issue_id(x["rule_id"], x["start"], x["end"])), F.lit(False))
        return x.withField("severity", F.when(no, "INFO").otherwise(x["severity"])).withField("refused", no)

    rows = report.rows.join(refused, same, "left").withColumn("issues", F.transform("issues", told)).drop("d_", "refused_")
    rows = rows.withColumn("dimensions", score.score_array(F.col("issues"))).withColumn("score", score.overall(F.col("dimensions")))
    issues = issue_rows(rows, extra=("refused",))
    return Report(issues, entries(rows, F.col("dimensions")), rows.select("doc_id", "score.*"), report.trace, report.rows, report.seen)


def trace_metrics(engines: Sequence[str]) -> list[Column]:
    """Metrics over rows of `audited`: documents, each engine's issues before and after resolution, and the term engine's by
    level (O22, T19)."""
    found = lambda keep: F.coalesce(F.sum(F.size(F.filter("found", keep))), F.lit(0))
    of_engine = lambda e: lambda x: x["engine"] == e
    of_level = lambda name: lambda x: (x["engine"] == "term") & (F.split_part(x["rule_id"], F.lit("-"), F.lit(1)) == name)
    out = [F.count("*").alias("documents")]
    for n, e in enumerate(engines):
        out.append(F.coalesce(F.sum(F.get("raw", F.lit(n))["n"]), F.lit(0)).alias(f"raw_{e}"))
        out.append(found(of_engine(e)).alias(f"found_{e}"))
    for name in terms.LEVELS if "term" in engines else ():
        out.append(found(of_level(name)).alias(f"level_{name}"))
    return out


def observed(rows: DataFrame, engines: Sequence[str] = ENGINES) -> tuple[DataFrame, Observation]:
    """rows of `audited` that count themselves while an action runs; the observation's `get` has the metrics afterwards."""
    seen = Observation(f"audit-{uuid.uuid4().hex}")
    return rows.observe(seen, *trace_metrics(engines)), seen


def trace_of(metrics: Mapping[str, int], engines: Sequence[str], elapsed_ms: int) -> list[dict]:
    """One entry per engine of a run's metrics; the engines share the run's time."""
    return [{"node": e, "n": int(metrics[f"found_{e}"]), "raw": int(metrics[f"raw_{e}"]), "elapsed_ms": elapsed_ms, "error": ""} for e in engines]


def traced(docs: DataFrame, pack: Pack = LATIN, engines: Sequence[str] = ENGINES, checks: Mapping[str, Sequence[str]] = CHECKS) -> list[dict]:
    """One entry per engine: n, raw, elapsed_ms, error, all of one run that counts itself. Only if that run fails does each
    engine run alone, so that the one that fails is known and does not stop the others (O22, O29)."""
    began = time.monotonic()
    passed = lambda: int(1000 * (time.monotonic() - began))
    try:
        rows, seen = observed(audited(docs, pack, engines, checks, rounds=0), engines)
        rows.write.format("noop").mode("overwrite").save()
        return trace_of(seen.get, engines, passed())
    except Exception as x:  # noqa: BLE001  it is reported in the trace
        if len(engines) == 1:
            return [{"node": engines[0], "n": 0, "raw": 0, "elapsed_ms": passed(), "error": f"{type(x).__name__}: {str(x).splitlines()[0][:200]}"}]
    return [entry for e in engines for entry in traced(docs, pack, (e,), checks)]


def revise_texts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    return revise.apply_edits(docs, revise.edits_of(issues))


def render(report: Report, docs: DataFrame, fmt: str = "json") -> DataFrame:
    """doc_id and the report of each document in a format."""
    if fmt == "json":
        return sinks.json_reports(report.scores, report.issues)
    if fmt == "markdown":
        return sinks.markdown_reports(report.scores, report.dimensions, report.issues, score.summaries(report.issues))
    if fmt == "html":
        return sinks.html_reports(report.scores, docs, report.issues, report.dimensions, score.summaries(report.issues))
    if fmt in ("docx", "pdf"):
        return sinks.file_reports(render(report, docs, "markdown"), fmt)
    raise ValueError(f"unknown format {fmt}")


def describe(pack: Pack = LATIN) -> Mapping[str, object]:
    """Sizes of the pack and the steps of the plan."""
    return {"pack": pack.name, "terms": len(pack.terms), "language_rules": len(pack.language), "banned_rules": len(pack.banned), "engines": ENGINES, "steps": ("intake", "route", *ENGINES, "resolve", "review", "deduplicate", "score", "revise", "report")}


def mermaid(pack: Pack = LATIN) -> str:
    steps = describe(pack)["steps"]
    return "graph TD\n" + "\n".join(f"  {a} --> {b}" for a, b in zip(steps, steps[1:], strict=False))


def mentions(docs: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Documents that hold one of the words."""
    return docs.filter(TEXT().rlike(any_of(words)))
