"""Trees of any tables are compared as texts: distances that are plain to see are those of the program, the rest is hard and gets them from it."""

import random

from pyspark.sql import functions as F

from gridscore.operators import compared, shred, treedist
from gridscore.plans import q_spans

GROUPS = ("thead", "tbody", "tfoot")


def _pairs():
    rng = random.Random(9)
    cell = lambda: f"<td{rng.choice(['', '', ' colspan=' + chr(34) + '2' + chr(34)])}>{rng.choice(['a', 'b1', '', '<b>x</b>y', 'long text', '&amp;', '<p>q</p>'])}</td>"
    row = lambda: "<tr>" + "".join(cell() for _ in range(rng.randint(0, 3))) + "</tr>"
    out = [("", "<table></table>"), ("none", "<table></table>"), (None, None)]
    for _ in range(300):
        rows = [row() for _ in range(rng.randint(0, 4))]
        k = rng.randint(0, len(rows))
        full = "<table><thead>" + "".join(rows[:k]) + "</thead><tbody>" + "".join(rows[k:]) + "</tbody>" + rng.choice(("", "<tfoot></tfoot>")) + "</table>"
        other = [r.replace("long", "lone") if rng.random() < 0.3 else r for r in rows if rng.random() < 0.9]
        bare = "<table>" + "".join(other) + "</table>"
        out += [(full, bare), (bare, full), (full, full.replace("long", "lone"))]
    return out


def test_distances_are_those_of_the_program():
    seen = 0
    for a, b in _pairs():
        for ignore in ((), GROUPS, ("b",)):
            there, hard, text, bare, n = compared.compare_tree_texts(a or "", b or "", ignore)
            x, y = shred.parse(a), shred.parse(b)
            assert there == (x is not None and y is not None)
            if not there:
                continue
            for t in (x, y):
                shred.unwrap(t, ignore)
            assert n == max(sum(1 for _ in x.all()), sum(1 for _ in y.all()), 1)
            x, y = shred.nodes_of(x), shred.nodes_of(y)
            bared = [[{**k, "content": None, "size": 0} for k in t] for t in (x, y)]
            assert text is None or abs(text - treedist.tree_distance(x, y)) < 1e-9, (a, b, ignore)
            assert bare is None or bare == treedist.tree_distance(*bared, True), (a, b, ignore)
            assert hard == (text is None or bare is None)
            seen += not hard
    assert seen > 700


def test_scores_are_those_of_shredded_pairs(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_pairs()[:200])], "k int, html string, gt_html string")
    for ignore in ((), GROUPS):
        trees = shred.shred_tables(shred.shred_tables(df, "html", "p", ignore), "gt_html", "g", ignore).select("k", "p", "g")
        want = {r.k: (round(r.teds, 9), round(r.teds_s, 9)) for r in treedist.tree_scores(trees).collect()}
        got = treedist.text_scores(df.withColumn("__c", compared.compare_trees(F.col("html"), F.col("gt_html"), ignore)), "__c", ignore_nodes=ignore)
        assert {r.k: (round(r.teds, 9), round(r.teds_s, 9)) for r in got.collect()} == want


def test_tables_are_rendered_once_and_no_tree_is_stored(spark, monkeypatch):
    stored, real = [], treedist.store
    monkeypatch.setattr(treedist, "store", lambda df, path: stored.append(df) or real(df, path))
    out = q_spans.q_ignored_tags(spark, "/root/testdata/sf0.001")
    assert len(stored) == 2 and not any("array" in t for df in stored for _, t in df.dtypes)
    assert stored[0]._jdf.queryExecution().optimizedPlan().toString().count("lineitem") <= 1 and out.where("teds_ignoring <> 1 OR teds_s_ignoring <> 1").isEmpty()
