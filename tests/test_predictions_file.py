"""Predictions through a file: what is written is compressed, rows meet without their tables, and no row is shuffled twice over."""

import os

from gridscore.operators import upsert
from gridscore.plans import q_imports

SF = "/root/testdata/sf0.001"


def test_written_predictions_are_compressed_and_meet_without_tables(spark, tmp_path, monkeypatch):
    at, seen, real = str(tmp_path / "p"), [], upsert.latest
    monkeypatch.setattr(q_imports, "scratch", lambda *_: at)
    monkeypatch.setattr(upsert, "latest", lambda df, *a: seen.append(df) or real(df, *a))
    out = q_imports.q_predictions_file(spark, SF).collect()
    names = [f for f in os.listdir(at) if f.startswith("part-")]
    assert names and all(f.endswith(".json.gz") for f in names)
    assert seen[0].count() > sum(r["rows"] for r in out) > 0 and "html" not in seen[0].columns


def test_the_last_row_is_its_own_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "b"), ("b", None, "y")], "k string, seq int, v string")
    last = upsert.latest(df, ["k"], "seq")
    assert sorted(map(tuple, last.collect())) == [("a", 2, "b"), ("b", None, "y")]
    assert "max_by" not in last._jdf.queryExecution().optimizedPlan().toString()
