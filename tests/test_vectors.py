"""Model vectors over tables, against a server of the test's own that counts and sometimes refuses."""

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.functions.hashing import cosine, hashed_vector
from proofloom.operators import terms
from proofloom.operators.vectors import VectorStore


def _vector(text):
    return [float(len(text)), float(text.count("a")), 1.0]


@pytest.fixture
def server():
    seen = {"calls": 0, "texts": [], "refuse": set(), "fail_first": 0}

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status, body):
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._say(200, {})

        def do_POST(self):
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            given = [given] if isinstance(given, str) else given
            seen["calls"] += 1
            if seen["fail_first"] > 0 or seen["refuse"] & set(given):
                seen["fail_first"] -= 1
                return self._say(500, {})
            seen["texts"] += given
            # answers in reverse order, with their numbers
            return self._say(200, {"data": [{"index": i, "embedding": _vector(t)} for i, t in reversed(list(enumerate(given)))]})

        def log_message(self, *a):
            pass

    web = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", seen
    web.shutdown()


PACE = {"rate": 1e6, "wait": 0.01, "batch": 4}


def test_each_text_is_asked_once_and_kept(spark, server):
    url, seen = server
    store = VectorStore(spark, f"vec_{uuid.uuid4().hex}", {"url": url, "model": "m"})
    rows = spark.createDataFrame([(i, None if i == 7 else "a" * (i % 5) + "b", "x") for i in range(40)], "id int, text string, vec string")
    assert store.add(rows, tasks=2, waves=3, **PACE) == 5
    assert sorted(seen["texts"]) == sorted("a" * i + "b" for i in range(5))
    calls = seen["calls"]
    assert store.add(rows, tasks=2, **PACE) == 0 and seen["calls"] == calls
    got = {r["id"]: r["vec"] for r in store.of(rows).collect()}
    assert len(got) == 40 and got[7] is None
    for i, v in got.items():
        if i != 7:
            want = np.array(_vector("a" * (i % 5) + "b"))
            assert np.allclose(v, want / np.linalg.norm(want))


def test_calls_are_tried_again_and_a_refused_text_costs_no_other(spark, server):
    url, seen = server
    seen["fail_first"] = 1
    seen["refuse"] = {"bad"}
    store = VectorStore(spark, f"vec_{uuid.uuid4().hex}", {"url": url, "model": "m"})
    texts = spark.createDataFrame([(t,) for t in ("bad", "one", "two", "three", "", "🙂")], "text string")
    assert store.add(texts, tasks=1, **PACE) == 5
    assert {r["text"] for r in store.of(texts).filter("vec IS NULL").collect()} == {"bad"}
    seen["refuse"] = set()
    assert store.add(texts, tasks=1, **PACE) == 1  # asked for again, and alone
    assert seen["texts"].count("one") == 1


def test_models_do_not_mix_and_the_offline_one_hashes(spark, server):
    url, _ = server
    table = f"vec_{uuid.uuid4().hex}"
    texts = spark.createDataFrame([("hello there",), ("",)], "text string")
    online, offline = VectorStore(spark, table, {"url": url, "model": "m"}), VectorStore(spark, table)
    assert online.add(texts, **PACE) == 2 and offline.add(texts) == 2
    assert len(online.of(texts).first()["vec"]) == 3
    got = {r["text"]: r["vec"] for r in offline.of(texts).collect()}
    assert np.allclose(got["hello there"], hashed_vector("hello there")) and not any(got[""])
    assert offline.add(texts.limit(0)) == 0 and offline.of(texts.limit(0)).count() == 0


def test_seeds_in_blocks_are_as_all_at_once(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 6)))] + [(98, [0.0] * 6), (99, None)], "key int, vec array<double>")
    made = rng.normal(size=(60, 6))
    made[7] = made[31]  # a tie
    s = spark.createDataFrame([(f"t{i % 3}", i, x.tolist()) for i, x in enumerate(made)], "term string, seed int, vec array<double>")
    rows = lambda df: sorted((r["key"], r["term"], r["seed"], round(r["score"], 9)) for r in df.collect())
    whole = rows(terms.semantic_hits(v, s, 0.3))
    assert whole and whole == rows(terms.semantic_hits(v, s, 0.3, seeds_limit=16))
    assert not {98, 99} & {r[0] for r in whole}


def test_cosine_of_zero_and_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None]
