"""Numbers that an audit counts while it runs."""

from pyspark.sql import functions as F

from proofloom.operators import terms
from proofloom.plans import audit
from proofloom.rules import LATIN, Pack, Rule


def test_metrics_of_the_run_itself(docs):
    d = docs('bad!! token = "0123456789abcdef0123" word%%% here, by thering men.', "The the theration.", None)
    report = audit.audit(d, engines=("term", "norm"))
    counted = report.issues.count()
    got = report.metrics()
    found = report.trace.select("engine", "n").collect()
    assert got["documents"] == 3 and {r["engine"]: r["n"] for r in found} == {e: got[f"found_{e}"] for e in ("term", "norm")} and counted > 2
    levels = terms.level_counts(audit.issue_rows(report.rows, "found")).agg(*[F.sum(k).alias(k) for k in terms.LEVELS]).first()
    assert {k: got[f"level_{k}"] for k in terms.LEVELS} == levels.asDict() and got["level_term"] > 0
    report.release()
    trace = audit.traced(d, engines=("term", "norm"))
    assert {t["node"]: t["n"] for t in trace} == {e: got[f"found_{e}"] for e in ("term", "norm")}


def test_an_engine_that_fails_is_named(docs):
    broken = Pack("b", ".", "", "^#", "^$x", ("not",), language=(Rule("r", "(", "MINOR"),), words=LATIN.words)
    trace = {t["node"]: t for t in audit.traced(docs("some text."), broken, ("norm", "style"))}
    assert trace["norm"]["error"] and not trace["style"]["error"] and trace["norm"]["n"] == 0
