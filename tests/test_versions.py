"""Versions and the ledger under several writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from proofloom import api
from proofloom.operators import lifecycle


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"term {i}", 0.9, "pending") for i in ids], "id string, term string, confidence double, status string")


def test_readers_see_one_version_or_the_other(spark, tmp_path):
    path = str(tmp_path / "terms")
    with pytest.raises(ValueError):
        lifecycle.current(spark, path)
    for n in range(3):
        lifecycle.stage(rows(spark, *"abc"[: n + 1]), path, f"v{n}")
    lifecycle.promote(spark, path, "v0")
    seen = []

    def read(_):
        got = lifecycle.current(spark, path).collect()
        seen.append((got[0]["version"], len(got)))

    with ThreadPoolExecutor(4) as pool:
        done = [pool.submit(lifecycle.promote, spark, path, f"v{n}") for n in (1, 2, 1, 2)]
        list(pool.map(read, range(6)))
        numbers = sorted(d.result() for d in done)
    assert numbers == [2, 3, 4, 5] and set(seen) <= {("v0", 1), ("v1", 2), ("v2", 3)}
    assert [n for n, _ in lifecycle.CommitLog(spark, f"{path}/log").entries()] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        lifecycle.promote(spark, path, "none")


def test_nothing_is_approved_twice(spark, tmp_path, monkeypatch, capsys):
    path = str(tmp_path / "ledger")
    with ThreadPoolExecutor(3) as pool:
        told = [pool.submit(lifecycle.approve_into, spark, rows(spark, *ids), path) for ids in ("abc", "bcd", "cde")]
        assert sum(t.result() for t in told) == 5
    held = lifecycle.ledger(spark, path)
    assert sorted(r["id"] for r in held.collect()) == list("abcde") and {r["status"] for r in held.collect()} == {"approved"}
    assert lifecycle.approve_into(spark, rows(spark, "a", "a", "f", None), path, ["a", "f"]) == 1
    assert lifecycle.approve_into(spark, rows(spark, "a"), path) == 0 and lifecycle.ledger(spark, path).count() == 6
    rows(spark, "x", "y").write.parquet(str(tmp_path / "pending"))
    monkeypatch.setattr(api.SparkSession.builder, "getOrCreate", lambda: spark, raising=False)
    for want in ("approved 2", "approved 0"):
        assert api.main(["terms", "approve", "--path", str(tmp_path)]) == 0
        assert want in capsys.readouterr().out
    assert lifecycle.ledger(spark, path).count() == 8
