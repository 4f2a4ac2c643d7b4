"""Truth and predictions of the same samples read one exchange of lines, and what is missing is found without a shuffle by run."""

import re

from gridscore.operators import scoring
from gridscore.plans import derive

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_truth_and_predictions_share_an_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        truth = derive.keyed_samples(spark, SF)
        told = derive.predictions(spark, SF, truth).where("conversion_ok").select("dataset", "run_id", "sample_id", "html").repartition(4, "dataset", "sample_id")
        plan = _plan(scoring.text_pairs(told, truth.select("dataset", "sample_id", "gt_html"), placed=True))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange" in plan
    assert len(re.findall(r"- Exchange hashpartitioning", plan)) == 3  # lines by order, samples as they are, predictions


def test_missing_rows_need_no_shuffle_by_run(spark):
    samples = spark.createDataFrame([("d", str(i), "i", "<table></table>") for i in range(4)], "dataset string, sample_id string, image string, gt_html string")
    keys = [("d", "a", "0"), ("d", "a", "1"), ("d", "b", "1"), ("d", "b", "1"), ("d", None, "2"), ("e", "a", "3")]
    predictions = spark.createDataFrame(keys, "dataset string, run_id string, sample_id string")
    runs = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "a")], "dataset string, run_id string")
    missing = scoring._missing(samples, predictions, runs)
    assert sorted((r.run_id, r.sample_id) for r in missing.collect()) == [("a", "2"), ("a", "3"), ("b", "0"), ("b", "2"), ("b", "3")]
    assert not re.search(r"hashpartitioning\([^)]*run_id", _plan(missing))
