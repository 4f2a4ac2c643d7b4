"""Pairs that are read and compared as texts score as shredded pairs do."""

import random

import pytest
from pyspark.sql import functions as F

from gridscore.operators import compared, scoring, shred, treedist


def _pairs():
    rng = random.Random(5)
    texts = ["", "1", "12.0", "1,200", "Ab", "aB ", " x  y", "é1", "É１", "ﬁ", "<b>x</b>", "&amp;", "&lt;1"]
    row = lambda plain: "<tr>" + "".join(f"<{t}{'' if plain else rng.choice(['', ' colspan=2', ' rowspan=2'])}>{rng.choice(texts[:10] if plain else texts)}</{t}>" for t in [rng.choice(("td", "td", "th")) for _ in range(rng.randint(0, 3))]) + "</tr>"
    out = []
    for k in range(300):
        rows = [row(k % 3) for _ in range(rng.randint(0, 5))]
        other = [r for r in rows if rng.random() < 0.8] if k % 2 else [row(k % 3) if rng.random() < 0.3 else r for r in rows]
        table = lambda x: rng.choice(("<table>", "<html><body><table>")) + "".join(x) + "</table>"
        gt = rng.choice((table(rows), table(rows), table(rows), "", "none", None))
        html = rng.choice((table(other), table(other), table(other), gt, "", None))
        out.append((f"d{k % 2}", "r", str(k), html, gt, rng.random() < 0.9, rng.random() < 0.9, "i", 1.0, None))
    return out


@pytest.mark.parametrize("mode", ["chars", "tokens"])
def test_texts_score_as_shredded_pairs(spark, mode):
    df = spark.createDataFrame(_pairs(), "dataset string, run_id string, sample_id string, html string, gt_html string, run_ok boolean, conversion_ok boolean, image string, seconds double, error string")
    df = df.withColumn("html", F.when(F.col("conversion_ok"), F.col("html")))
    want = scoring.score_pairs(shred.shred_tables(shred.shred_tables(df, "html", "p"), "gt_html", "g").drop("html", "gt_html"), mode)
    got = scoring.score_texts(df, mode)
    rows = lambda x: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.drop("error").collect())
    assert got.columns == want.columns and rows(got) == rows(want)


def test_rows_left_out_and_small_renames_need_no_tree_distance():
    table = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    whole = [[str(10 * r + c) for c in range(5)] for r in range(6)]
    for other in (whole[:-1], whole[:2] + whole[4:], [["x", *whole[0][1:]], *whole[1:]], whole):
        a, b = table(other), table(whole)
        _, hard, text, bare, *_ = compared.compare(a, b)
        x, y = (shred.nodes_of(shred.parse(t)) for t in (a, b))
        assert not hard and abs(text - treedist.tree_distance(x, y)) < 1e-9 and bare == treedist.tree_distance(x, y, True)
    assert compared.compare(table([["a"], ["b", "c"]]), table(whole))[1]


def test_pairs_are_stored_without_trees(spark, monkeypatch):
    stored, real = [], treedist.store
    monkeypatch.setattr(treedist, "store", lambda df, path: stored.append(df) or real(df, path))
    samples = spark.createDataFrame([("d", "1", "i", "<table><tr><td>1</td></tr></table>")], "dataset string, sample_id string, image string, gt_html string")
    assert scoring.score_runs(samples, scoring.self_check(samples)).first().teds == 1.0
    assert stored and not any("array" in t for df in stored for _, t in df.dtypes)


def test_the_last_prediction_counts_without_a_shuffle_of_its_own(spark):
    from gridscore.operators.upsert import latest, latest_here

    rng = random.Random(2)
    rows = [(str(rng.randrange(4)), rng.choice("ab"), rng.choice((None, 1, 2)), rng.choice((None, "x", "y"))) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string, r string, seq int, v string").repartition(3, "s")
    got = latest_here(df, ["s", "r"], "seq")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(repr, got.collect())) == sorted(map(repr, latest(df, ["s", "r"], "seq").collect()))
