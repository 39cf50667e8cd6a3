"""Reference items of several kinds and scripts, whole, faulty and odd."""

import pytest
from pyspark.sql import functions as F

from proofloom.operators import citations

CASES = [
    ("[1] Miller A, Jones B. On rivers[J]. Water Studies, 2019, 45(3): 12-20.", {"num": 1, "authors": ["Miller A", "Jones B"], "title": "On rivers", "kind": "J", "container": "Water Studies", "year": 2019, "volume": "45", "issue": "3", "pages": "12-20", "rest": "", "missing": []}),
    ("[2] 王小明. 河流之书[M]. 上海: 水利出版社, 2021: 33-35.", {"authors": ["王小明"], "title": "河流之书", "kind": "M", "place": "上海", "publisher": "水利出版社", "year": 2021, "pages": "33-35", "missing": [], "rest": ""}),
    ("3. Lee C, et al. A thesis[D]. Lyon: Rhone University, 2001.", {"num": 3, "authors": ["Lee C"], "et_al": True, "place": "Lyon", "publisher": "Rhone University", "year": 2001, "pages": None, "missing": []}),
    ("[4] 钱一, 孙二, 周三, 等. 新闻[N]. 晚报, 2020-05-06(4).", {"authors": ["钱一", "孙二", "周三"], "et_al": True, "container": "晚报", "date": "2020-05-06", "issue": "4", "year": 2020, "rest": "", "missing": []}),
    ("[5] Board. Page of notes[EB/OL]. (2018-01-02)[2019-03-04]. https://example.org/a/b.html.", {"kind": "EB", "carrier": "OL", "url": "https://example.org/a/b.html", "date": "2018-01-02", "missing": []}),
    ("[6] Doe J. With a number[J]. Letters, 2010: 5. doi: 10.1234/ab.c-1.", {"doi": "10.1234/ab.c-1", "pages": "5", "container": "Letters", "year": 2010}),
    ("[7] Doe J. No place[M]. 1999.", {"missing": ["place", "publisher"], "year": 1999}),
    ("[8] Doe J. Odd kind[Q]. Somewhere, 1999.", {"kind": "Q", "missing": None}),
    ("just some words", {"authors": ["just some words"], "title": None, "kind": None, "missing": None, "num": None}),
    ("", {"authors": [], "title": None, "rest": ""}),
    (None, {"authors": [], "title": None, "rest": ""}),
]


def test_items(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", citations.reference_fields(F.col("t")).alias("x")).collect()
    for r in rows:
        want = CASES[r["i"]][1]
        got = {k: r["x"][k] for k in want}
        assert got == want, CASES[r["i"]][0]


def test_very_long_items_and_tables(spark):
    long = "[1] " + ", ".join(f"Name{i} A" for i in range(3000)) + ". T[J]. S, 2000, 1: 2."
    refs = spark.createDataFrame([(1, 1, long), (1, 1, long), (None, None, None)], "doc_id int, num int, text string")
    got = citations.parsed_references(refs).collect()
    assert [len(r["authors"]) for r in got] == [3000, 3000, 0] and got[0]["pages"] == "2"
    assert citations.parsed_references(refs.limit(0)).count() == 0
