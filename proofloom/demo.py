"""A scripted tour of the engine over a small text of its own."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from proofloom.operators import lifecycle, score
from proofloom.plans import audit
from proofloom.rules import LATIN
from proofloom.sources import sinks

TEXT = """# A small report

1. Results
The parts are 240 units, 150 units and 50 units, a total of 430 units. The the share is 108% of all, and 1,200 units were lost!!
3. Outlook
A thetion stands here, and token = "0123456789abcdef0123" should not, of course, and the wonders of it. See figure 4.

References
[1] A, B, C, D. A title[Q]. Place: House, 2090: 1–3.
[2] E. A title[J]. 2020: 4-5.
"""


def run(spark: SparkSession, out: str | None = None, show: bool = True) -> dict[str, int]:
    """Ten stages; the number of rows of each."""
    docs = spark.createDataFrame([(1, TEXT), (2, "A calm text.")], "doc_id bigint, text string")
    report = audit.audit(docs)
    sums = score.summaries(report.issues)
    stages = {
        "pack": spark.createDataFrame([(k, str(v)) for k, v in audit.describe(LATIN).items()], "name string, value string"),
        "intake": audit.intake(docs), "routes": audit.routes(audit.intake(docs)), "issues": report.issues.select("doc_id", "severity", "rule_id", "line", "original"), "trace": report.trace,
        "scores": report.scores, "summaries": sums, "revised": audit.revise_texts(docs, report.issues).select("doc_id", "n_applied", "n_skipped"),
        "candidates": lifecycle.candidates(docs, LATIN.cues), "report": sinks.sections(report.scores, report.dimensions, report.issues, sums).select("doc_id", F.size("lines").alias("findings")),
    }
    counts = {}
    for name, rows in stages.items():
        if show:
            print(f"== {name}")
            rows.show(20, truncate=60)
        counts[name] = rows.count()
    if out:
        sinks.write_reports({f: audit.render(report, docs, f) for f in ("json", "markdown", "html")}, out)
    report.release()
    return counts
