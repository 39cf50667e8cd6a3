"""Sources of documents and rules."""

from __future__ import annotations

import io
import os
import re
import urllib.request
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.offsets import strip
from proofloom.operators.parse import doc_key, html_strip, paragraphs
from proofloom.rules import LATIN, Pack
from proofloom.sources.packs import read_data

_SCHEMA = "path string, text string, error string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id, text, source_path: each file is one document; its id is of its path and text."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(doc_key(F.concat(F.input_file_name(), F.lit("\n"), "value")).alias("doc_id"), F.col("value").alias("text"), F.input_file_name().alias("source_path"))


def from_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents of any table with a text column; the id is of the text."""
    return df.select(doc_key(F.coalesce(text, F.lit(""))).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def docx_text(raw: bytes) -> str:
    """Paragraphs, then table rows with their cells joined by a blank; blank lines go."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    joined = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    lines = [joined(p) for p in body.findall(f"{_WORD}p")]
    for table in body.findall(f"{_WORD}tbl"):
        lines += [" ".join(joined(c).strip() for c in row.findall(f"{_WORD}tc")) for row in table.findall(f"{_WORD}tr")]
    return "\n".join(x for x in lines if x.strip())


def pdf_text(raw: bytes) -> str:
    """Page texts (S04); needs pypdf."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


def decoded(raw: bytes) -> str:
    """UTF-8, with or without a mark, else GBK, else what UTF-8 can read."""
    for encoding in ("utf-8-sig", "gbk"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore")


def any_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of files of any kind, by their extension (S03-S05). One file is one row of one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {".docx": docx_text, ".pdf": pdf_text}
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((name, kinds.get(os.path.splitext(name)[1].lower(), decoded)(bytes(raw)), None))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    rows.append((name, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, _SCHEMA)


def corpus(spark: SparkSession, path: str, pack: Pack = LATIN, least: int = 40) -> DataFrame:
    """pid, source, para_idx, text: paragraphs of .md and .txt files that are no headings and long enough."""
    files = spark.read.option("pathGlobFilter", "*.{md,txt}").option("recursiveFileLookup", "true").text(path, wholetext=True)
    docs = files.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    paras = paragraphs(docs, pack).filter((~F.col("is_heading")) & (F.length(strip(F.col("text"))) >= least))
    stem = F.regexp_replace(F.regexp_extract("doc_id", r"([^/]+)$", 1), r"\.(md|txt)$", "")
    return paras.select(F.concat(stem, F.lit("#"), F.col("para_idx").cast("string")).alias("pid"), F.col("doc_id").alias("source"), "para_idx", "text")


def rule_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A rule table of JSON lines; a missing path is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


#: How the text of a variable becomes a value, by the kind of the value that it replaces.
TRUE = frozenset(("1", "true", "yes", "on"))
CONVERTERS: dict[type, Callable[[str], object]] = {bool: lambda text: text.strip().lower() in TRUE, int: int, float: float}


def _leaves(tree: Mapping, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    for key, value in tree.items():
        yield from _leaves(value, (*path, key)) if isinstance(value, Mapping) and value else [((*path, key), value)]


def _converted(text: str, old: object) -> object:
    try:
        return CONVERTERS.get(type(old), str)(text)
    except ValueError:
        return text


def settings(defaults: Mapping, path: str | None = None, environ: Mapping[str, str] | None = None, prefix: str = "PROOFLOOM_") -> dict:
    """Nested settings: defaults, over them those of a JSON or YAML file, over them variables PREFIX_A__B, which keep the kind
    of what they replace; a number that cannot be read stays text (S09, S14)."""
    flat = dict(_leaves(defaults)) | dict(_leaves(read_data(path)))
    given = os.environ if environ is None else environ
    named = {tuple(k.removeprefix(prefix).lower().split("__")): v for k, v in given.items() if k.startswith(prefix)}
    flat |= {place: _converted(text, flat.get(place)) for place, text in named.items()}
    out: dict = {}
    for place, value in flat.items():
        reduce(lambda node, key: node.setdefault(key, {}), place[:-1], out)[place[-1]] = value
    return out


def fetched(spark: SparkSession, sources: Sequence[Mapping], timeout: float = 20.0) -> DataFrame:
    """id, type, ref, text, error of sources {id, type, url or path, enabled}: web addresses are read in tasks, one row each;
    one that fails is a row with its reason (S10-S13)."""
    rows = [(s.get("id") or "unknown", s.get("type"), s.get("url") or s.get("path")) for s in sources if s.get("enabled", True)]
    web = spark.createDataFrame([r for r in rows if r[1] != "file"], "id string, type string, ref string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, kind, ref in batch.itertuples(index=False):
                try:
                    with urllib.request.urlopen(ref, timeout=timeout) as answer:
                        out.append((name, kind, ref, answer.read().decode("utf-8", "ignore"), None))
                except Exception as e:  # noqa: BLE001  a source that fails does not stop an update
                    out.append((name, kind, ref, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "type", "ref", "text", "error"])

    schema = "id string, type string, ref string, text string, error string"
    out = [web.repartition(max(1, min(64, len(rows)))).mapInPandas(read, schema)]
    for name, kind, ref in rows:
        if kind == "file":
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ref)
            there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
            if there:
                text = spark.read.text(ref, wholetext=True)
                out.append(text.select(F.lit(name).alias("id"), F.lit(kind).alias("type"), F.lit(ref).alias("ref"), F.col("value").alias("text"), F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, out)


def source_candidates(spark: SparkSession, sources: Sequence[Mapping], cues: Sequence[str], **options) -> DataFrame:
    """term, confidence, severity, variants, source, reason: candidates of all sources; files and pages by cue patterns, JSON
    answers as they are; a failed source is a row without a term (S10-S13, U04)."""
    from proofloom.operators.lifecycle import candidates

    rows = fetched(spark, sources)
    pages = rows.filter("error IS NULL AND type != 'json_api'").select(F.col("id").alias("doc_id"), F.when(F.col("type") == "url_text", html_strip(F.col("text"))).otherwise(F.col("text")).alias("text"))
    none = F.array().cast("array<string>")
    cued = candidates(pages, cues, **options).select("term", "confidence", F.lit("MAJOR").alias("severity"), none.alias("variants"), F.lit("text").alias("source"), F.lit("").alias("reason"))
    given = parsed_terms(rows.filter("error IS NULL AND type = 'json_api'"), "text", "MAJOR", 0.9).select("term", "confidence", "severity", "variants", F.lit("api").alias("source"), F.lit("").alias("reason"))
    failed = rows.filter("error IS NOT NULL").select(F.lit("").alias("term"), F.lit(0.0).alias("confidence"), F.lit("MAJOR").alias("severity"), none.alias("variants"), F.col("id").alias("source"), F.col("error").alias("reason"))
    return cued.unionByName(given).unionByName(failed)


def landed_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Texts of pages that were fetched before: their markup stripped."""
    return pages.withColumn("text", html_strip(F.coalesce(html, F.lit("")))).drop(html)


def parsed_terms(rows: DataFrame, answer: str, severity: str = "MINOR", confidence: float = 0.6) -> DataFrame:
    """Terms of JSON answers, a list or {data: [...]}: rows without a term go, the rest get defaults."""
    fields = "term string, severity string, type string, variants array<string>, confidence double"
    found = F.coalesce(F.from_json(answer, f"struct<data:array<struct<{_typed(fields)}>>>")["data"], F.from_json(answer, f"array<struct<{_typed(fields)}>>"))
    out = rows.select(F.explode(found).alias("x")).select("x.*").filter("term IS NOT NULL AND term != ''")
    return out.select("term", F.coalesce("severity", F.lit(severity)).alias("severity"), F.coalesce("type", F.lit("literal")).alias("type"), F.coalesce("variants", F.array().cast("array<string>")).alias("variants"), F.coalesce("confidence", F.lit(confidence)).alias("confidence"))


def term_api(spark: SparkSession, path: str) -> DataFrame:
    """Terms of JSON answers that were saved as files."""
    return parsed_terms(spark.read.text(path, wholetext=True), "value")


def _typed(fields: str) -> str:
    return ",".join(re.sub(r"^(\w+) ", r"\1:", f.strip()) for f in fields.split(", "))


def failed_source(spark: SparkSession, source: str, reason: str) -> DataFrame:
    """The row that stands for a source that failed; updates filter it out."""
    return spark.createDataFrame([("", source, reason, 0.0)], "term string, source string, reason string, confidence double")
