"""Reports after a judge's verdicts, and rewritten texts of any length."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from proofloom import models
from proofloom.api import Proofloom
from proofloom.plans import audit
from proofloom.rules import LATIN


@pytest.fixture
def server():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def _say(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._say({})

        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
            calls.append(text)
            said = json.dumps({"is_valid": "found: a@b.org" not in text, "reason": "x"}) if "JSON" in text else "" if "MUTE" in text else text.split("\n\n", 1)[1].upper()
            self._say({"choices": [{"message": {"content": said}}]})

        def log_message(self, *a):
            pass

    web = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield {"url": f"http://127.0.0.1:{web.server_port}"}, calls
    web.shutdown()


TEXT = "mail a@b.org now, and c@d.org too, from 10.1.2.3 as well."


def test_a_refused_issue_stays_marked_and_scores_follow(spark, server):
    settings, calls = server
    docs = spark.createDataFrame([(1, TEXT), (1, "other c@d.org here, nothing else stands in it."), (None, TEXT), (2, None)], "doc_id bigint, text string")
    loom = Proofloom(spark, LATIN, {"model": settings})
    report = loom.audit(docs, engines=("term",))
    after = loom.judged(report)
    issues = after.issues.collect()
    assert len(issues) == report.issues.count()
    assert {r["original"] for r in issues if r["refused"]} == {"a@b.org"} and all(r["severity"] == "INFO" for r in issues if r["refused"])
    asked = len(calls)
    before = sorted((r["doc_id"] or 0, r["n_major"], r["n_info"]) for r in report.scores.collect())
    then = sorted((r["doc_id"] or 0, r["n_major"], r["n_info"]) for r in after.scores.collect())
    # both rows that hold the issue lose a grave one, the others nothing
    assert sum(a[1] for a in before) - sum(a[1] for a in then) == 2 == sum(a[2] for a in then) - sum(a[2] for a in before)
    assert after.scores.count() == 4 and after.dimensions.count() == report.dimensions.count()
    assert len(calls) == asked  # what was asked is not asked again
    report.release()


def test_without_a_model_the_report_is_as_it_was(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id bigint, text string")
    report = audit.audit(docs, engines=("term",), keep=False)
    after = audit.judged(report, spark.createDataFrame([], "doc_id bigint, issue_id string, accept boolean, note string"))
    assert after.scores.collect() == report.scores.collect() and after.issues.filter("refused").count() == 0


def test_parts_join_to_the_text():
    for text in ("", "a", "one\ntwo\n\nthree", "x" * 25 + "\ny", "é\r\n" * 9):
        for longest in (1, 4, 10, 100):
            parts = models.parts_of(text, longest)
            assert "".join(parts) == text and all(len(p) <= longest for p in parts)


def test_long_texts_are_rewritten_in_parts(spark, server):
    settings, calls = server
    long = "".join(f"line {i} of it\n" for i in range(30)) + "MUTE this line\nand the end"
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "MUTE"), (None, "short"), (5, "no plan")], "doc_id bigint, text string")
    plans = spark.createDataFrame([(i, "split") for i in (1, 2, 3, 4, None)], "doc_id bigint, plan string")
    got = {r["doc_id"]: r["rewritten"] for r in models.rewrites(docs, plans, settings, longest=40).collect()}
    assert set(got) == {1, None} and got[None] == "SHORT" and all(len(c.split("\n\n", 1)[1]) <= 40 for c in calls)
    assert got[1].upper() == long.upper() and "LINE 7 OF IT\n" in got[1] and "MUTE this line\n" in got[1]
