"""Cells and numbers of pairs of texts are those of their grids, and samples are not shuffled a second time."""

import re

from pyspark.sql import functions as F

from gridscore.operators import metrics, scoring, shred
from gridscore.plans import q_scores
from tests.test_compared import _pairs

SF = "/root/testdata/sf0.001"


def test_counts_are_those_of_grids(spark):
    df = spark.createDataFrame([(i, p[3], p[4]) for i, p in enumerate(_pairs())], "k int, html string, gt_html string")
    grids = shred.shred_grids(shred.shred_grids(df, "html", "p"), "gt_html", "g")
    want = grids.select("k", metrics.cell_f1(F.col("p"), F.col("g")).alias("cells"), metrics.numeric_accuracy(F.col("p"), F.col("g")).alias("numbers"))
    assert sorted(scoring.cell_pairs(df).select("k", "cells", "numbers").collect()) == sorted(want.collect())


def test_truth_and_predictions_read_one_exchange_and_no_grid(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [q(spark, SF)._jdf.queryExecution().executedPlan().toString() for q in (q_scores.q_cell_f1, q_scores.q_numeric)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for plan in plans:
        assert "ReusedExchange" in plan and "nodes" not in plan
        assert len(re.findall(r"- Exchange hashpartitioning", plan)) == 3  # lines by order, samples as they are, predictions
