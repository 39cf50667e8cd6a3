"""Library facade and command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom import demo, models
from proofloom.operators import lifecycle, resolve
from proofloom.plans import audit
from proofloom.rules import EN, PACKS, Pack
from proofloom.sources import files, packs, readers, sinks
from proofloom.sources.tables import written


DEFAULTS = {"pack": "en", "preset": "", "files": {"terms": "", "banned": "", "ledger": "", "resources": "", "references": ""}, "engines": ",".join(audit.ENGINES), "least": 0.6, "rounds": 2, "model": {"url": "", "model": "local-model", "wire": "openai_compatible", "key": ""}}


class Proofloom:
    """One session, one rule pack, and settings."""

    def __init__(self, spark: SparkSession, pack: Pack = EN, settings: Mapping | None = None):
        self.spark, self.pack, self.settings = spark, pack, {**DEFAULTS, **(settings or {})}

    @classmethod
    def of_settings(cls, spark: SparkSession, path: str | None = None, environ: Mapping[str, str] | None = None) -> Proofloom:
        """From a settings file and the environment: the pack named, with the rule files named."""
        found = readers.settings(DEFAULTS, path, environ)
        pack, files = PACKS[found["pack"]], {k: v for k, v in found["files"].items() if v}
        return cls(spark, packs.load_pack(**files, base=pack, preset=found["preset"] or None) if files else pack, found)

    def info(self) -> dict:
        return dict(audit.describe(self.pack))

    def audit(self, docs: DataFrame, **options) -> audit.Report:
        given = {"engines": tuple(self.settings["engines"].split(",")), "least": self.settings["least"], "rounds": self.settings["rounds"]}
        return audit.audit(docs, self.pack, **(given | options))

    def audit_files(self, path: str, **options) -> audit.Report:
        return self.audit(readers.text_files(self.spark, path), **options)

    def audit_text(self, text: str, **options) -> audit.Report:
        return self.audit(readers.from_texts(self.spark.createDataFrame([(text,)], "text string")), **options)

    def judged(self, report: audit.Report) -> audit.Report:
        """The report after a model's verdicts, its scores and gate made anew; without a model, as it is (O10). Each issue is asked
        about once: the verdicts are written before they are used."""
        given = models.verdicts(resolve.verdict_targets(report.issues), self.settings["model"])
        return audit.judged(report, written(given, "verdicts"))

    def render(self, report: audit.Report, docs: DataFrame, fmt: str = "json") -> DataFrame:
        return audit.render(report, docs, fmt)

    def export(self, report: audit.Report, docs: DataFrame, path: str, formats: tuple[str, ...] = ("json", "markdown")) -> None:
        sinks.write_reports({f: self.render(report, docs, f) for f in formats}, path)

    def export_files(self, report: audit.Report, docs: DataFrame, path: str, formats: tuple[str, ...] = ("docx", "pdf")) -> None:
        """One file a document and format, in a folder of the format's name."""
        for f in formats:
            source = {"docx": "markdown", "pdf": "markdown", "md": "markdown"}.get(f, f)
            files.write_files(self.render(report, docs, source), f"{path}/{f}", f)

    def update_terms(self, sources: Sequence[Mapping] | DataFrame, path: str | None = None, version: str = "next", approved: bool = False, known: DataFrame | None = None) -> DataFrame:
        """New candidates of sources ({id, type, path or url}) or of documents. With a path, the pack's terms and the candidates
        are staged there as a version, which becomes the current one if approved (U04, V05)."""
        known = packs.TermSet(self.pack).rows(self.spark) if known is None else known
        found = lifecycle.candidates(sources, self.pack.cues) if isinstance(sources, DataFrame) else readers.source_candidates(self.spark, sources, self.pack.cues)
        fresh = lifecycle.run_update(found, known)
        if path:
            fresh = written(fresh, "fresh")  # sources are read once
            sinks.write_pending(fresh, f"{path}/pending")
            lifecycle.stage(known.unionByName(fresh.select("id", "term", "confidence"), allowMissingColumns=True), path, version)
            if approved:
                lifecycle.promote(self.spark, path, version)
        return fresh

    def approve(self, pending: DataFrame, ledger: DataFrame, ids=None) -> DataFrame:
        return lifecycle.approve(pending, ledger, ids)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("proofloom")
    p.add_argument("--settings", help="settings file, JSON or YAML")
    p.add_argument("--pack", choices=sorted(PACKS), help="instead of the one in the settings")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    sub.add_parser("graph")
    for name in ("audit", "demo"):
        a = sub.add_parser(name)
        a.add_argument("path", nargs="?" if name == "demo" else None)
        a.add_argument("--out")
        a.add_argument("--formats", default="json,markdown")
    t = sub.add_parser("terms")
    t.add_argument("action", choices=["show", "update", "approve"])
    t.add_argument("--path", help="folder of versions, pending candidates and the ledger")
    t.add_argument("--source", action="append", default=[], help="a file or address to take candidates from")
    t.add_argument("--ids", nargs="*")
    t.add_argument("--auto-promote", action="store_true")
    return p


def _terms(loom: Proofloom, args: argparse.Namespace) -> int:
    if args.action == "show":
        packs.TermSet(loom.pack).rows(loom.spark).select("id", "term", "type", "severity", "variants").show(50, truncate=False)
        return 0
    if args.action == "update":
        given = [{"id": s, "type": "url_text" if "://" in s else "file", "url" if "://" in s else "path": s} for s in args.source]
        loom.update_terms(given, args.path, "next", args.auto_promote).orderBy(F.desc("confidence"), "term").show(50, truncate=False)
        return 0
    pending = loom.spark.read.parquet(f"{args.path}/pending")
    print(f"approved {lifecycle.approve_into(loom.spark, pending, f'{args.path}/ledger', args.ids)}")
    return 0


def main(argv: list[str] | None = None) -> int:
    """Exit code 0 if every document passed, 1 if one did not, 2 if the input cannot be read."""
    args = parser().parse_args(argv)
    if args.command in ("info", "graph"):
        pack = PACKS[args.pack or "en"]
        print(json.dumps(dict(audit.describe(pack)), default=list) if args.command == "info" else audit.mermaid(pack))
        return 0
    spark = SparkSession.builder.appName("proofloom").getOrCreate()
    loom = Proofloom.of_settings(spark, args.settings)
    if args.pack:
        loom.pack = PACKS[args.pack]
    if args.command == "terms":
        return _terms(loom, args)
    if args.command == "demo":
        demo.run(spark, args.out)
        return 0
    try:
        docs = readers.text_files(spark, args.path)
    except Exception as e:  # noqa: BLE001
        print(f"cannot read {args.path}: {e}", file=sys.stderr)
        return 2
    report = loom.audit(docs)
    if args.out:
        loom.export(report, docs, args.out, tuple(args.formats.split(",")))
    gates = report.scores.groupBy("gate").count().collect()
    for r in gates:
        print(r["gate"], r["count"])
    report.release()
    return sinks.exit_code([r["gate"] for r in gates])


if __name__ == "__main__":
    sys.exit(main())
