"""The quality classifier's rules and its column against plain evaluation."""

import math
import random

import numpy as np

from gridscore.llm import quality_classifier as Q


def learned(seed=3, n=600):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(Q.STATISTICS)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7) | (x[:, 5] > 0.9)).astype(float)
    flip = rng.random(n) < 0.05
    return x, np.where(flip, 1 - y, y), Q.RuleEnsemble(x, np.where(flip, 1 - y, y))


def plain(model, row):
    z = model.intercept
    for weight, rule in zip(model.weights.tolist(), model.rules):
        if all((row[f] > t) == up for f, up, t in rule):
            z += weight
    return 1 / (1 + math.exp(-z))


def test_score_and_column_are_the_rules(spark):
    x, y, model = learned()
    assert 0 < len(model.rules) < 400 and all(1 <= len(r) <= 3 for r in model.rules)
    want = [plain(model, row) for row in x]
    assert np.allclose(model.score(x), want, atol=1e-12)
    assert np.mean((np.array(want) > 0.5) == y) > 0.9
    names = Q.STATISTICS
    df = spark.createDataFrame([(k, dict(zip(names, map(float, row)))) for k, row in enumerate(x)], "k int, s struct<" + ",".join(f"{n}:double" for n in names) + ">")
    got = {r.k: r.p for r in df.select("k", model.column(df["s"]).alias("p")).collect()}
    assert all(abs(got[k] - w) < 1e-9 for k, w in enumerate(want))


def test_rows_that_come_to_the_driver_are_bounded(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k % 40, " ".join(rng.choices(["a", "bb", "ccc"], k=20))) for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 40, k % 2) for k in range(400)], "doc_id long, quality int")
    seen = []
    own = Q.RuleEnsemble
    try:
        Q.RuleEnsemble = lambda x, y, **o: seen.append(len(y)) or own(x, y, **o)
        Q.fit(docs, labels, max_rows=500)
    finally:
        Q.RuleEnsemble = own
    assert seen == [500]


def test_own_columns_stay(spark):
    df = spark.createDataFrame([(1, "some words", "mine", 7)], "doc_id long, text string, __y string, weights int")
    out = Q.score(df, learned()[2])
    assert out.columns == [*df.columns, "score"] and out.first()["__y"] == "mine"
