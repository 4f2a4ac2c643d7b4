"""Upserts into bucketed tables: equal to the plain upsert, no exchange on the old side, and a death between steps."""

import random
import re

import pytest

from gridscore.operators import keyed, upsert

KEYS = ["dataset", "run_id"]
SCHEMA = "dataset string, run_id string, seq int, v int"


def rows(rng, n, seq):
    return [(rng.choice("de"), str(rng.randint(0, 30)), seq + k, rng.randint(0, 99)) for k in range(n)]


def as_set(df):
    return sorted(map(tuple, df.select("dataset", "run_id", "seq", "v").collect()))


def test_rounds_of_upserts(spark, monkeypatch):
    rng = random.Random(3)
    plain = upsert.latest(spark.createDataFrame(rows(rng, 60, 0), SCHEMA), KEYS, "seq")
    want = as_set(plain)
    keyed.create_keyed(plain, "keyed_runs", KEYS, 4)
    assert as_set(spark.table("keyed_runs")) == want
    for k in range(1, 4):
        new = spark.createDataFrame([*rows(rng, 20, 100 * k), (None, "x", 1, 1)], SCHEMA)
        want = as_set(upsert.upsert(spark.createDataFrame(want, SCHEMA), new.dropna(subset=KEYS), KEYS, "seq"))
        if k == 2:  # the driver dies before the view moves: readers see the old table, and the next run makes the version anew
            before, real = as_set(spark.table("keyed_runs")), spark.sql
            with monkeypatch.context() as m:
                m.setattr(type(spark), "sql", lambda self, q, *a, **o: (_ for _ in ()).throw(RuntimeError("died")) if "VIEW" in q else real(q, *a, **o))
                with pytest.raises(RuntimeError):
                    keyed.upsert_keyed(spark, "keyed_runs", new, KEYS, "seq", 4)
            assert as_set(spark.table("keyed_runs")) == before
        keyed.upsert_keyed(spark, "keyed_runs", new, KEYS, "seq", 4)
        assert as_set(spark.table("keyed_runs")) == want
    assert len(keyed._versions(spark, "keyed_runs")) == 2


def test_no_exchange_on_the_old_side(spark):
    old = spark.range(2000).selectExpr("'d' AS dataset", "cast(id AS string) AS run_id", "1 AS seq", "cast(id AS int) AS v")
    keyed.create_keyed(old, "keyed_plan", KEYS, 4)
    new = spark.createDataFrame([("d", "5", 2, 0), ("d", "x", 2, 1)], SCHEMA)
    out = keyed.upserted(spark, "keyed_plan", new, KEYS, "seq", 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("keyed_plan")
    above = plan[:scan].splitlines()
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line)[0])
    at, path = depth(above[-1]), []
    for line in reversed(above[:-1]):
        if depth(line) < at:
            path.append(line.strip())
            at = depth(line)
    assert any("SortMergeJoin" in x for x in path) and not any("Exchange" in x for x in path[: [i for i, x in enumerate(path) if "SortMergeJoin" in x][0]])
    assert {(r.run_id, r.v) for r in out.where("run_id IN ('5', 'x', '6')").collect()} == {("5", 0), ("x", 1), ("6", 6)} and out.count() == 2001
