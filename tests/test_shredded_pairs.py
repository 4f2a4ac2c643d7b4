"""Predictions beside their truth: texts are shuffled, not trees, and a text that repeats the truth's is not shredded again."""

from gridscore.operators import scoring, shred


def test_texts_are_shuffled_and_repeats_are_shredded_once(spark):
    html = lambda x: f"<table><tr><td>{x}</td></tr></table>"
    truth = spark.createDataFrame([("d", str(k), html(k)) for k in range(6)], "dataset string, sample_id string, gt_html string")
    texts = [html(0), html("x"), None, "", f"<div>{html(4)}", "no table"]
    told = spark.createDataFrame([("d", "r", str(k), t) for k, t in enumerate(texts)], "dataset string, run_id string, sample_id string, html string")
    pairs = scoring.shredded_pairs(told, truth)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("ArrowEvalPython") < plan.rfind("Exchange hashpartitioning")
    got = {r.sample_id: r for r in pairs.collect()}
    for kind, df, column, key in (("p", told, "html", "sample_id"), ("g", truth, "gt_html", "sample_id")):
        for r in shred.shred_tables(df, column, "t").collect():
            assert got[r[key]][kind] == r.t
