import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from proofloom import api, demo, models
from proofloom.operators import lifecycle
from proofloom.plans import audit
from proofloom.rules import LATIN, ZH
from proofloom.sources import packs, readers, sinks
from proofloom.streaming import audit_stream
from tests.conftest import SF


def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes("数据".encode("gbk"))
    (tmp_path / "c.docx").write_bytes(sinks.docx_bytes(["one", "", "two <x>"]))
    (tmp_path / "d.docx").write_bytes(b"broken")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in readers.any_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "héllo" and rows["b.txt"]["text"] == "数据" and rows["c.docx"]["text"] == "one\ntwo <x>"
    assert rows["d.docx"]["error"] and rows["d.docx"]["text"] == ""
    assert sinks.pdf_bytes(["line (1)"] * 60).startswith(b"%PDF-1.4")


def test_text_files_and_corpus(spark, tmp_path):
    (tmp_path / "x.md").write_text("# Head\n" + "long enough paragraph of the corpus " * 2 + "\nshort\n")
    assert readers.text_files(spark, str(tmp_path)).count() == 1
    assert [r["pid"] for r in readers.corpus(spark, str(tmp_path)).collect()] == ["x#1"]


def test_settings_keep_kinds(tmp_path):
    given = {"PROOFLOOM_A__N": "7", "PROOFLOOM_A__ON": "false", "PROOFLOOM_A__X": "bad", "OTHER": "1", "PROOFLOOM_NEW__KEY": "text"}
    out = readers.settings({"a": {"n": 1, "on": True, "x": 0.5}, "e": {}}, environ=given)
    assert out == {"a": {"n": 7, "on": False, "x": "bad"}, "e": {}, "new": {"key": "text"}}
    (tmp_path / "s.json").write_text(json.dumps({"a": {"x": 2.5, "more": {"y": 1}}}))
    assert readers.settings({"a": {"n": 1, "x": 0.5}}, str(tmp_path / "s.json"), {"PROOFLOOM_A__MORE__Y": "3"}) == {"a": {"n": 1, "x": 2.5, "more": {"y": 3}}}


TERMS = {"entries": [{"id": "a", "term": "right words", "severity": "FATAL", "variants": ["wrong words"], "explain": "why"}, {"id": "b", "term": "old", "variants": ["elder"]}, {"id": "o", "type": "ordering", "order": ["x", "y"], "pattern": "[xy, ]{3,}"}, {"id": "s", "type": "semantic", "term": "t", "semantic_seeds": ["a seed"]}]}
RESOURCES = {
    "logic": {"absolute_claims": ["必然"], "quantity_claim_map": {"多数": {"min_ratio": 0.5, "advice": "share"}, "个别": {"max_ratio": 0.05}}, "argument_markers": {"claim": ["本文认为"]}},
    "language": {"words": [{"pattern": "按排", "fix": "安排"}, {"pattern": r"(\w)\1{3,}", "fix": r"\1", "severity": "INFO"}, {"pattern": "do not.*?this", "fix": "Say it otherwise, please"}, {"pattern": "(", "fix": "x"}], "note": "no list"},
    "style": {"presets": {"plain": {"avoid": ["very"]}}, "metrics": [{"name": "平均句长", "target": {"plain": [3, 9]}}]},
}


def test_packs_from_files(spark, docs, tmp_path):
    files = {}
    for name, data in (("terms", TERMS), ("ledger", {"entries": [{"id": "b", "term": "new", "variants": ["elder", "wrong words"]}]}), ("banned", {"rules": [{"id": "z", "pattern": "secret", "severity": "FATAL", "message": "no"}, {"id": "bad", "pattern": "("}]}), ("resources", RESOURCES), ("references", {"known_publishers": ["House"]})):
        files[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(data, ensure_ascii=False))
    for base in (LATIN, ZH):
        pack = packs.load_pack(**files, base=base, preset="plain")
        assert {t.id: t.term for t in pack.terms} == {"a": "right words", "b": "new", "o": "", "s": "t"} and [r.id for r in pack.banned] == ["z"]
        assert [(r.replacement, r.advice) for r in pack.language] == [("安排", ""), ("$1", ""), (None, "Say it otherwise, please")]
        assert pack.quantifiers == (("多数", 50.0, 100.0, "share"), ("个别", 0.0, 5.0, "")) and pack.metrics == (("mean_sentence", 3.0, 9.0),) and pack.publishers == ("House",)
        assert pack.words["avoid"] == ("very",) and pack.words["vague"] == base.words["vague"]
        found = {(r["rule_id"], r["original"], r["suggestion"]) for r in audit.raw_issues(docs("按排 the elder secret wrong words aaaaa", "y, x"), pack, ("term", "norm")).collect()}
        assert {("term-b", "elder", "new"), ("term-b", "wrong words", "new"), ("z", "secret", ""), ("lang-words-000", "按排", "安排"), ("lang-words-001", "aaaaa", "a"), ("order-o", "y, x", "x, y")} <= found
    assert packs.load_pack(str(tmp_path / "none.yaml"), base=LATIN).terms == LATIN.terms
    table = readers.rule_table(spark, str(tmp_path / "rows.json"), "id string, term string, variants array<string>")
    assert packs.pack_of_tables(LATIN, table).terms == LATIN.terms
    (tmp_path / "rows.json").write_text('{"id": "q", "term": "good", "variants": ["bad"]}')
    assert [t.id for t in packs.pack_of_tables(LATIN, readers.rule_table(spark, str(tmp_path / "rows.json"), "id string, term string, variants array<string>")).terms] == ["q"]
    terms = packs.TermSet(pack)
    assert [t.id for t in terms.semantic()] == ["s"] and [t.id for t in terms.ordering()] == ["o"] and terms.by_id["b"].term == "new" and "elder" in terms.names()
    assert terms.rows(spark).filter("id = 'a'").first()["variants"] == ["wrong words"]
    env = {f"PROOFLOOM_FILES__{k.upper()}": v for k, v in files.items()} | {"PROOFLOOM_PRESET": "plain", "PROOFLOOM_PACK": "zh"}
    assert api.Proofloom.of_settings(spark, environ=env).pack == pack


class Answers(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def _say(self, data, status=200):
        body = data if isinstance(data, bytes) else json.dumps(data).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        said = {"/models": {}, "/api/tags": {}, "/page": b"<p>use the&nbsp;wonders of old</p><script>the notthis</script>", "/terms": {"data": [{"term": "given term"}, {"severity": "x"}]}}
        self._say(said.get(self.path, b"no"), 200 if self.path in said else 404)

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("embeddings"):
            v = [3.0, 4.0]
            return self._say({"embedding": v} if "prompt" in asked else {"data": [{"embedding": v}]})
        text = asked["messages"][-1]["content"]
        said = "Sure: ```json\n" + json.dumps({"is_valid": "keep" in text, "reason": "r"}) + "\n```" if "JSON" in text else text.upper()
        return self._say({"choices": [{"message": {"content": said}}], "message": {"content": said}})


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_models_and_their_stand_in(spark, docs, server):
    for wire in models.WIRES:
        client = models.connect({"url": server, "wire": wire})
        assert client.chat([{"role": "user", "content": "hi"}]) == "HI" and client.stats()["calls"] == 1 and client.embed("x").tolist() == [0.6, 0.8]
    off = models.connect({"url": "http://127.0.0.1:9"})
    assert off.chat([], True) == "{}" and off.stats()["model"] == "rules" and len(off.embed("abc")) == 256 and models.connect(None).stats()["calls"] == 0
    with pytest.raises(models.ModelError):
        models.connect({"url": "http://127.0.0.1:9", "required": True})
    assert models.loose_json('x ```{"a": 1}``` y') == {"a": 1} and models.loose_json("{a") == models.loose_json(None) == {}
    rows = [(1, "i1", "r", "keep", "m", "e"), (1, "i2", "r", "drop", "m", "e")]
    asked = spark.createDataFrame(rows, "doc_id bigint, issue_id string, rule_id string, original string, message string, explain string")
    assert {r["issue_id"]: r["accept"] for r in models.verdicts(asked, {"url": server}).collect()} == {"i1": True, "i2": False}
    assert models.verdicts(asked, None).count() == 0
    plans = spark.createDataFrame([(0, "split")], "doc_id bigint, plan string")
    assert models.rewrites(docs("a text", "b"), plans, {"url": server}).first()["rewritten"].endswith("A TEXT")


def test_update_from_sources(spark, tmp_path, server):
    (tmp_path / "s.txt").write_text("We praise the wonders and the wonders of kingdoms.")
    sources = [{"id": "f", "type": "file", "path": str(tmp_path / "s.txt")}, {"id": "n", "type": "file", "path": str(tmp_path / "none")}, {"id": "u", "type": "url_text", "url": f"{server}/page"}, {"id": "j", "type": "json_api", "url": f"{server}/terms"}, {"id": "x", "type": "url_text", "url": f"{server}/gone"}, {"id": "off", "type": "url_text", "url": "bad", "enabled": False}]
    found = {r["term"]: r for r in readers.source_candidates(spark, sources, LATIN.cues).collect()}
    assert set(found) == {"wonders", "kingdoms", "given term", ""} and "404" in found[""]["reason"] and found["given term"]["confidence"] == 0.9
    loom, path = api.Proofloom(spark, LATIN), str(tmp_path / "versions")
    fresh = loom.update_terms(sources, path, "v1", approved=True)
    assert {r["term"] for r in fresh.collect()} == {"wonders", "kingdoms", "given term"}
    now = lifecycle.current(spark, path)
    assert now.filter("id = 't1'").first()["version"] == "v1" and now.count() == len(LATIN.terms) + 3
    loom.update_terms(sources, path, "v2")
    assert {r["version"] for r in lifecycle.current(spark, path).collect()} == {"v1"}
    lifecycle.promote(spark, path, "v2")
    assert {r["version"] for r in lifecycle.current(spark, path).collect()} == {"v2"}
    with pytest.raises(ValueError):
        lifecycle.promote(spark, path, "v3")
    assert api.main(["terms", "approve", "--path", path, "--ids", found and fresh.first()["id"]]) == 0
    assert spark.read.parquet(f"{path}/ledger").first()["status"] == "approved"


def test_reports_of_every_kind(spark, tmp_path):
    counts = demo.run(spark, str(tmp_path / "out"), show=False)
    assert counts["issues"] > 10 and counts["candidates"] > 0 and len(counts) == 10
    html = sinks.report_of(spark, str(tmp_path / "out"), "html", 1)
    assert [html.count(f"<h2>{n} ") for n in range(1, 9)] == [1] * 8 and "<mark" in html and "BLOCK" in html
    assert json.loads(sinks.report_of(spark, str(tmp_path / "out"), "json", 1))["gate"] == "BLOCK" and sinks.report_of(spark, str(tmp_path / "out"), "json", 99) is None
    marks = spark.createDataFrame([(1, "# A\nline"), (2, "中文 (x)\\")], "doc_id int, markdown string")
    words = {r["doc_id"]: bytes(r["content"]) for r in sinks.file_reports(marks, "docx").collect()}
    assert readers.docx_text(words[1]) == "A\nline" and readers.docx_text(words[2]) == "中文 (x)\\"
    pages = {r["doc_id"]: bytes(r["content"]) for r in sinks.file_reports(marks, "pdf").collect()}
    assert b"(line) Tj" in pages[1] and "中文 (x)\\".encode("utf-16-be").hex().encode() in pages[2]


def test_term_answers_and_rule_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"term": "x"}, {"severity": "MAJOR"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"term": "y", "confidence": 0.9}]))
    rows = {r["term"]: r for r in readers.term_api(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x", "y"} and rows["x"]["confidence"] == 0.6 and rows["y"]["severity"] == "MINOR"
    assert readers.rule_table(spark, str(tmp_path / "none"), "id string").count() == 0


def test_stream_of_documents(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(20).write.parquet(str(src))
    q = audit_stream.audit_stream(audit_stream.stream_documents(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(300)
    assert audit_stream.latest_scores(spark.read.parquet(str(tmp_path / "out"))).count() == 20


def test_command_line(capsys):
    assert api.main(["info"]) == 0 and "engines" in capsys.readouterr().out
    assert api.main(["graph"]) == 0 and "graph TD" in capsys.readouterr().out
    assert sinks.exit_code(["PASS", "REVIEW"]) == 1
