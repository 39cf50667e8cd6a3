"""The whole audit of the smallest documents against plain Python over the engines' raw findings."""

import math
from collections import defaultdict

from proofloom.operators import academic, logic, norm, parse, similarity, style, terms
from proofloom.operators.parse import TEXT, paragraph_array
from proofloom.plans import audit, catalog
from proofloom.schema import explode_issues
from pyspark.sql import functions as F
from tests.conftest import SF

WEIGHT = {"FATAL": 100, "MAJOR": 20, "MINOR": 5, "INFO": 1}
LOSS = {"FATAL": 100.0, "MAJOR": 20.0, "MINOR": 5.0, "INFO": 0.5}
OF = {"term": "terminology", "political": "terminology", "language": "language", "format": "language", "logic": "logic", "data": "academic", "duplicate": "academic", "reference": "academic", "style": "style"}
SCALE = {"terminology": (150, "0.35"), "language": (130, "0.18"), "logic": (200, "0.17"), "academic": (200, "0.25"), "style": (120, "0.05")}


def clash(a, b):
    if a["start"] == a["end"] or b["start"] == b["end"]:
        return a["start"] == b["start"]
    return a["start"] < b["end"] and b["start"] < a["end"]


def resolved(items):
    kept = []
    for x in sorted(items, key=lambda x: (-WEIGHT[x["severity"]], x["start"] - x["end"], x["rule_id"], x["start"], x["message"])):
        if not any(clash(x, k) for k in kept):
            kept.append(x)
    return kept


def reviewed(items, text):
    out = []
    for x in items:
        cut, own = text[x["start"] : x["end"]].strip(" "), x["original"].strip(" ")
        no_change = x["suggestion"] and x["suggestion"] == x["original"]
        empty = x["end"] <= x["start"] and x["category"] not in ("format", "reference", "style", "logic")
        drift = x["end"] > x["start"] and x["original"] and cut not in own and own not in cut
        if not (no_change or empty or x["start"] < 0 or x["end"] > len(text) or drift):
            out.append(x)
    best = {}
    for x in out:
        key = ("", x["rule_id"]) if x["start"] == x["end"] else (x["start"], x["end"])
        rank = (WEIGHT[x["severity"]], x["confidence"], len(x["suggestion"]))
        if key not in best or rank > best[key][0]:
            best[key] = (rank, x)
    out = [x for _, x in best.values()]
    if any(x["severity"] in ("FATAL", "MAJOR") for x in out):
        out = [x for x in out if x["severity"] in ("FATAL", "MAJOR") or x["confidence"] >= 0.6]
    seen = {}
    for x in sorted(out, key=lambda x: (-WEIGHT[x["severity"]], -x["confidence"])):
        seen.setdefault((x["rule_id"], x["start"], x["end"], x["original"]), x)
    return [x for x in seen.values() if x["severity"] != "INFO" or x["confidence"] >= 0.6]


def test_audit_report_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    profiles = {r["doc_id"]: r for r in audit.intake(docs).collect()}
    refs = {r["doc_id"]: r["ref_start"] for r in parse.reference_start(docs).collect()}
    twins = similarity.with_duplicates(docs.select("doc_id", paragraph_array(TEXT()).alias("paras")))
    made = {"term": terms.term_issues(docs), "norm": norm.norm_issues(docs), "logic": logic.logic_issues(docs), "academic": academic.academic_issues(docs).unionByName(explode_issues(twins, "academic", F.col("duplicates"))), "style": style.style_issues(docs)}
    runs = {"term": lambda p: True, "norm": lambda p: True, "logic": lambda p: p["n_chars"] >= 40, "academic": lambda p: p["is_academic"] or p["digit_density"] > 0, "style": lambda p: p["n_chars"] >= 100}
    raw = defaultdict(list)
    for engine, rows in made.items():
        for r in rows.collect():
            if runs[engine](profiles[r["doc_id"]]):
                raw[r["doc_id"], engine].append(r.asDict())
    want = {}
    for doc, text in texts.items():
        found = []
        for engine in made:
            kept = resolved(raw[doc, engine])
            if engine == "norm":
                kept = [x for x in kept if refs[doc] < 0 or x["start"] < refs[doc]]
            for x in kept:
                if x["end"] > x["start"] and x["end"] <= len(text):
                    x = x | {"original": text[x["start"] : x["end"]]}
                found.append(x)
        final = reviewed(found, text)
        lost = defaultdict(float)
        for x in final:
            lost[OF[x["category"]]] += LOSS[x["severity"]]
        overall = sum(round(100 * math.exp(-lost[d] / s), 1) * float(w) for d, (s, w) in SCALE.items())
        counts = tuple(sum(x["severity"] == s for x in final) for s in WEIGHT)
        gate = "BLOCK" if counts[0] else "REVIEW" if round(overall, 6) < 75 or counts[1] > 5 else "PASS"
        want[doc] = (round(overall, 3), *counts, gate)
    got = {r["doc_id"]: (round(r["overall"], 3), r["n_fatal"], r["n_major"], r["n_minor"], r["n_info"], r["gate"]) for r in catalog.flagship(spark, SF).collect()}
    differ = {d: (got[d], want[d]) for d in want if got[d][1:] != want[d][1:] or abs(got[d][0] - want[d][0]) > 0.051}
    assert not differ and len(got) == len(texts) and len({g[-1] for g in got.values()}) > 1
