"""Queries that read predictions more than once make them once."""

import os

from pyspark.sql import functions as F

from gridscore.operators import scoring
from gridscore.plans import q_scores
from gridscore.sources import files

SF = "/root/testdata/sf0.001"


def _reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_counters_read_what_is_stored_without_tables(spark, monkeypatch):
    stored, real = [], q_scores.store
    monkeypatch.setattr(q_scores, "store", lambda df, path: stored.append(df) or real(df, path))
    out = q_scores.q_counters(spark, SF)
    assert len(stored) == 1 and _reads(out) == 0 and out.count() > 0
    assert {len(r["html"]) for r in stored[0].select("html").distinct().collect()} == {0, 5}


def test_scores_carry_what_the_viewer_shows(spark, tmp_path):
    html = "<table><tr><td>1</td></tr></table>"
    samples = spark.createDataFrame([("d", str(k), f"{k}.png", html) for k in range(4)], "dataset string, sample_id string, image string, gt_html string")
    rows = [("d", "r", "0", 1, html, True, True, 1.0, None, "doc"), ("d", "r", "1", 1, "", None, None, None, "x", None), ("d", "r", "2", 1, html, False, True, 0.5, None, ""), ("d", "q", "3", 1, html, True, None, 2.0, None, "doc")]
    told = spark.createDataFrame(rows, "dataset string, run_id string, sample_id string, seq int, html string, run_ok boolean, conversion_ok boolean, seconds double, error string, preprocess_profile string")
    told = told.withColumns({"backend_tag": F.lit("b"), "prompt_id": F.lit("p"), "long_image_side": F.lit(7)})
    want = files.viewer_payload(samples, scoring.score_runs(samples, told), told)
    got = files.viewer_rows(scoring.score_runs(samples, told.withColumn("told", F.struct(*files.SHOWN)), carry=("told",)), "told")
    rows = lambda df: sorted(map(repr, df.select(*sorted(want.columns)).collect()))
    assert rows(got) == rows(want) and got.count() == 8
    files.write_viewer(got, str(tmp_path / "v"))
    names = [f for _, _, fs in os.walk(tmp_path / "v") for f in fs if f.startswith("part-")]
    assert names and all(f.endswith(".json.gz") for f in names)
    back = spark.read.schema(got.schema).json(str(tmp_path / "v"))
    assert rows(back) == rows(want)


def test_the_payload_converts_predictions_once(spark, monkeypatch):
    seen, real = [], files.write_viewer
    monkeypatch.setattr(files, "write_viewer", lambda df, at: seen.append(df) or real(df, at))
    assert q_scores.q_payload(spark, SF).count() > 0
    assert _reads(seen[0]) == 0  # scores are stored once, with what is shown


def test_both_passes_read_samples_that_are_stored(spark, monkeypatch):
    seen, real = [], scoring.score_runs
    monkeypatch.setattr(scoring, "score_runs", lambda samples, *a, **k: seen.append(samples) or real(samples, *a, **k))
    assert q_scores.q_rescore(spark, SF).count() == 25
    assert len(seen) == 2 and not any("lineitem" in f for df in seen for f in df.inputFiles())


def test_texts_of_new_pairs_move_and_trees_do_not(spark, tmp_path, monkeypatch):
    seen, real = [], scoring.tree_scores
    monkeypatch.setattr(scoring, "tree_scores", lambda df, *a: seen.append(df) or real(df, *a))
    samples = spark.createDataFrame([("d", str(k), "i", f"<table><tr><td>{k}</td></tr></table>") for k in range(3)], "dataset string, sample_id string, image string, gt_html string")
    told = scoring.self_check(samples).union(scoring.self_check(samples.withColumn("gt_html", F.concat("gt_html", F.lit(" "))), "r"))
    out = scoring.score_runs(samples, told, shredded=str(tmp_path))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.rfind("ArrowEvalPython") < plan.find("Exchange")
    assert seen[0].count() == 6 and [r.teds for r in out.collect()] == [1.0] * 6
