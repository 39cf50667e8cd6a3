"""Reports as files: their content, and the sink's two phases."""

import io
import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofloom.api import Proofloom
from proofloom.sources import files, readers

REPORT = ["# Audit of 7", "", "## 1 Gate", "", "BLOCK at 40.0", "| dimension | score |", "|---|---|", "| logic | 90.1 |", "| style | 80.0 |", "", "- [FATAL] x: y <b> & \x01"]


def test_word_has_headings_tables_and_colours():
    raw = files.docx_bytes(REPORT)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = z.read("word/document.xml").decode()
        assert "Heading1" in z.read("word/styles.xml").decode() and z.testzip() is None
    assert xml.count("<w:tr>") == 3 and xml.count("<w:tbl>") == 1 and 'w:val="Heading2"' in xml and 'w:val="B00020"' in xml
    assert readers.docx_text(raw) == "Audit of 7\n1 Gate\nBLOCK at 40.0\n[FATAL] x: y <b> & \ndimension score\nlogic 90.1\nstyle 80.0"
    assert files.docx_bytes(REPORT) == raw and readers.docx_text(files.docx_bytes([])) == ""


@pytest.mark.parametrize("text", ["word " * 200, "x" * 700, "WWW MMM " * 60, "数据集成" * 90, "ab 数据 " * 80, ""])
def test_lines_fit_the_page(text):
    wide = any(ord(c) > 255 for c in text)
    lines = files.wrapped(text, 10, wide)
    assert all(files.advance(x, wide) <= (files.WIDTH - 2 * files.EDGE) / 10 for x in lines)
    assert "".join(lines).replace(" ", "") == text.replace(" ", "")
    raw = files.pdf_bytes([text] * 30)
    start = int(re.search(rb"startxref\n(\d+)", raw)[1])
    assert raw[start : start + 4] == b"xref" and len(re.findall(rb"/Type /Page /", raw)) >= (1 if not text else len(lines) * 30 // 58)
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", raw)]
    assert all(raw[p:].startswith(f"{n} 0 obj".encode()) for n, p in enumerate(places, 1))


def written(path):
    return sorted(p.name for p in Path(path).glob("part-*/*"))


def test_files_are_there_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "# One"), (2, None), (1, "again"), (None, "x"), (4, "a/b")], "doc_id int, markdown string").repartition(3)
    files.write_files(rows, path, "docx")
    got = written(path)
    assert len(got) == 5 and "2.docx" in got and "None.docx" in got and sum(n.startswith("1") for n in got) == 2
    assert not list(Path(path).glob("_staged/*")) and len(list(Path(path).glob("_committed-*.json"))) == 1
    spoiled = rows.withColumn("markdown", F.when(F.col("doc_id") == 4, F.expr("raise_error('lost')")).otherwise(F.col("markdown")))
    with pytest.raises(Exception, match="lost"):
        files.write_files(spoiled, path, "docx")
    assert written(path) == got and not list(Path(path).glob("_staged/*"))
    files.write_files(rows.limit(2), path, "docx")
    assert len(written(path)) == 7
    files.write_files(rows.limit(1), path, "docx", mode="overwrite")
    assert len(written(path)) == 1
    files.write_files(rows.limit(0), path, "pdf", mode="overwrite")
    assert written(path) == []


def test_reports_of_an_audit_as_files(spark, docs, tmp_path):
    d = docs('token = "0123456789abcdef0123" stands here.', "Calm prose.")
    loom = Proofloom(spark)
    report = loom.audit(d, engines=("term", "norm"))
    loom.export_files(report, d, str(tmp_path), ("docx", "pdf", "html"))
    report.release()
    assert [len(written(tmp_path / f)) for f in ("docx", "pdf", "html")] == [2, 2, 2]
    first = next(Path(tmp_path / "docx").glob("part-*/0.docx")).read_bytes()
    assert "BLOCK" in readers.docx_text(first)
