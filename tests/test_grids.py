"""Grids and counts of elements without trees are those of shredded tables."""

import random

from pyspark.sql import functions as F

from gridscore.operators import shred


def test_grids_and_counts_are_those_of_shredded_tables(spark):
    rng = random.Random(8)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", '<td colspan="2">', "</td>", "<th>", "</th>", "a ", "&amp;", "<br>", "x  y", "<thead>"]
    texts = [None, "", "none", "<table></table>", "<p><table><tr><td>a &lt;</td><th> b  c</th></tr><tr></tr></table>"]
    texts += ["<table>" + "".join(rng.choice(bits) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, html string")
    got = shred.count_elements(shred.shred_grids(df, "html", "grid"), "html", "n").join(shred.shred_tables(df.select("k", "html"), "html", "t").select("k", "t"), "k")
    assert got.where(~(F.col("grid").eqNullSafe(F.col("t.grid")) & F.col("n").eqNullSafe(F.col("t.n_elements")))).count() == 0 and got.count() == len(texts)
    assert got.where(F.size("grid") > 0).count() > 100


def test_queries_of_cells_make_no_trees(spark):
    from gridscore.plans import q_imports, q_scores

    d = "/root/testdata/sf0.001"
    for df in (q_scores.q_grid_cells(spark, d), q_scores.q_cells_by_mode(5)[0](spark, d), q_imports.q_jsonl(spark, d)):
        assert "leftmost" not in df._jdf.queryExecution().analyzed().toString() + df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() > 1000
