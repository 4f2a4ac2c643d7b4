"""Scores, rankings, tree distance and streams."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridscore.operators import scoring
from gridscore.operators.shred import nodes_of, parse
from gridscore.operators.treedist import tree_distance
from tests.test_treedist import rename as rename_cost

SAMPLES = "dataset string, sample_id string, image string, gt_html string"
PREDICTIONS = "dataset string, run_id string, sample_id string, seq long, html string, run_ok boolean, conversion_ok boolean, seconds double, error string"
GT = "<table><tr><td>Name</td><td>1,000</td></tr><tr><td>b</td><td></td></tr></table>"


def test_score_rules(spark):
    samples = spark.createDataFrame([("d", s, f"{s}.png", GT) for s in "abcdef"] + [("d", "words", "w.png", "<table><tr><td>x</td></tr></table>")], SAMPLES)
    rows = [
        ("d", "r", "a", 1, "", False, False, None, "old"), ("d", "r", "a", 2, GT, True, True, 2.0, None),  # the last counts
        ("d", "r", "b", 1, GT.replace("1,000", "1000.0").replace("Name", "NAME"), True, True, 4.0, None),
        ("d", "r", "c", 1, "", True, False, 1.0, "no_table_html"),
        ("d", "r", "d", 1, GT, False, True, 1.0, None),  # the number score needs the conversion only
        ("d", "r", "e", 1, "<table><tr><td>Name</td></tr></table>", True, True, None, None),
        ("d", "r", "words", 1, "<table><tr><td>x</td></tr></table>", True, True, 1.0, None),
        ("d", "r", "nobody", 1, GT, True, True, 1.0, None),  # no such sample
    ]
    out = {r.sample_id: r for r in scoring.score_runs(samples, spark.createDataFrame(rows, PREDICTIONS)).collect()}
    assert len(out) == 7 and tuple(out["a"].asDict()) == scoring.SCORE_COLUMNS
    assert (out["a"].teds, out["a"].teds_s, out["a"].cell_f1, out["a"].numeric_cell_accuracy) == (1.0, 1.0, 1.0, 1.0)
    assert (out["b"].cell_text_correct, out["b"].numeric_cells_correct, out["b"].teds_s) == (3, 1, 1.0) and out["b"].teds < 1
    assert out["c"].conversion_failure and out["c"].teds == 0 and out["c"].gt_cells_total == 0
    assert out["d"].run_failure and out["d"].teds == 0 and out["d"].cell_f1 == 0 and out["d"].numeric_cell_accuracy == 1.0
    assert (out["e"].cell_precision, out["e"].cell_recall, out["e"].pred_cells_total, out["e"].gt_cells_total) == (1.0, 0.25, 1, 4)
    assert out["f"].run_failure and out["f"].seconds is None and out["f"].numeric_cell_accuracy == 0
    assert out["words"].numeric_cell_accuracy is None
    s = scoring.run_summary(spark.createDataFrame(list(out.values()), scoring.score_runs(samples, spark.createDataFrame(rows, PREDICTIONS)).schema)).first()
    assert (s.tables, s.numeric_cell_accuracy, s.seconds_per_table) == (7, 3 / 4, 9.0 / 5)


# Published results: run, profile, TEDS, numeric, seconds.
GOLDEN = [
    ("r29", None, 0.8949, 0.5303, 49.5979), ("r30", None, 0.8910, 0.7407, 37.5945), ("r31", None, 0.8518, 0.8264, 10.2308), ("r32", None, 0.8324, 0.5972, 174.0756), ("r33", None, 0.8294, 0.6787, 30.7897),
    ("r34", None, 0.8275, 0.3979, 188.4139), ("r35", None, 0.7878, 0.5205, 116.9486), ("r38", None, 0.6998, 0.6690, 6.5743), ("r40", None, 0.6141, 0.8254, 27.3218), ("r43", None, 0.0473, 0.0115, 25.5234),
    ("r54", "doc", 0.9045, 0.6029, 48.9495), ("r55", "table", 0.8959, 0.4955, 46.8302), ("r56", "doc", 0.8870, 0.7986, 19.4372), ("r57", "table", 0.8324, 0.8066, 18.9805), ("r58", "doc", 0.7022, 0.7174, 6.4219),
]


def test_golden_ranking(spark):
    rows = [("d", r, "s", t, t, t, n, True, True, s) for r, _, t, n, s in GOLDEN] + [("d", "gt_self", "s", 1.0, 1.0, 1.0, 1.0, True, True, 0.0)]
    scores = spark.createDataFrame(rows, "dataset string, run_id string, sample_id string, teds double, teds_s double, cell_f1 double, numeric_cell_accuracy double, run_ok boolean, conversion_ok boolean, seconds double")
    names = spark.createDataFrame([(r, p, r) for r, p, *_ in GOLDEN], "run_id string, preprocess_profile string, display_name string")
    board = scoring.leaderboard(scores, names)
    got = {r.run_id: r["rank"] for r in board.collect()}
    base = [r for r, p, *_ in GOLDEN if p is None]
    assert [got[r] for r in base] == list(range(1, len(base) + 1)) and [got[r] for r in ("r54", "r55", "r56", "r57", "r58")] == [1, 2, 3, 4, 5] and "gt_self" not in got
    c = scoring.conclusions(board).first()
    assert tuple(c) == ("r54", "r29", "r54", "r31", "r31")


def test_blank_rules(spark):
    scores = spark.createDataFrame([("d", "r", "a", 1.0, 1.0, 1.0, None, "True", "1", None), ("d", "r", "b", 0.0, 0.0, 0.0, 1.0, "TRUE", "0", 4.0)], "dataset string, run_id string, sample_id string, teds double, teds_s double, cell_f1 double, numeric_cell_accuracy double, run_ok string, conversion_ok string, seconds double")
    names = spark.createDataFrame([("r", "none", "r")], "run_id string, preprocess_profile string, display_name string")
    zero, plain = (scoring.leaderboard(scores, names, blank_as_zero=z).first() for z in (True, False))
    assert (zero.numeric, zero.seconds, plain.numeric, plain.seconds) == (0.5, 2.0, 1.0, 4.0)
    assert zero.run_fail == 0.5 and zero.profile == "none"  # a recorded none is a profile


def brute(a, b, **options):
    """Edit distance of ordered forests, straight from its recurrence."""
    def tree(nodes):
        kids, stack = {}, []
        for i, n in enumerate(nodes):
            kids[i] = []
            while stack and stack[-1] >= n["leftmost"]:
                kids[i].insert(0, stack.pop())
            stack.append(i)
        return kids

    ka, kb = tree(a), tree(b)

    @lru_cache(None)
    def size(f, side):
        return sum(1 + size(tuple((ka, kb)[side][x]), side) for x in f)

    @lru_cache(None)
    def d(f, g):
        if not f or not g:
            return float(size(f, 0) + size(g, 1))
        u, v = f[-1], g[-1]
        return min(d(f[:-1] + tuple(ka[u]), g) + 1, d(f, g[:-1] + tuple(kb[v])) + 1, d(f[:-1], g[:-1]) + d(tuple(ka[u]), tuple(kb[v])) + rename_cost(a[u], b[v], options.get("structure_only", False), options.get("mode", "chars")))

    return d((len(a) - 1,), (len(b) - 1,))


@pytest.mark.parametrize("options", [{}, {"structure_only": True}, {"mode": "tokens"}])
def test_tree_distance(options):
    rng = random.Random(5)

    def page():
        cell = lambda: f"<td{rng.choice(['', ' colspan=2', ' rowspan=2'])}>{rng.choice(['', 'a', 'ab', '<b>x</b>', 'abc'])}</td>"
        rows = "".join("<tr>" + "".join(cell() for _ in range(rng.randint(0, 3))) + "</tr>" for _ in range(rng.randint(1, 3)))
        return f"<table>{'<thead>' + rows + '</thead>' if rng.random() < 0.3 else rows}</table>"

    for _ in range(60):
        a, b = nodes_of(parse(page())), nodes_of(parse(page()))
        assert abs(tree_distance(a, b, **options) - brute(a, b, **options)) < 1e-9


def test_shared_ends_and_shapes():
    from gridscore.operators.treedist import without_shared_ends

    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    page = lambda *rows: nodes_of(parse("<table>" + "".join(rows) + "</table>"))
    long, short = page(row("h", "i"), row(1, 2), row(3, 4), row(5, 6)), page(row("h", "i"), row(1, 2), row(5, 6))
    a, b = without_shared_ends(long, short)
    assert [len(a), len(b)] == [4, 1] and tree_distance(long, short) == tree_distance(short, long) == 3
    # equal rows on both sides of a change count once
    assert tree_distance(page(row("x"), row("x"), row("x")), page(row("x"), row("x"))) == 2
    assert tree_distance(long, long) == 0 and tree_distance(page(), page()) == 0


def test_plain_tables_are_cut_as_parsed(spark):
    """The JVM's path and the parser's give the same tables, grids, trees and note rows."""
    from gridscore.operators import shred

    rng = random.Random(12)
    texts = ["", " ", "a", "x  y", "&amp;", "&lt;b&gt;", "&quot;q&#x27;", "é\u00a0z ", "Source: x", "Note: y", "&amp;lt;", '"raw"', "\ue001", "1\n2", "Table 1. t"]
    cell = lambda: (lambda t: f"<{t}>{rng.choice(texts)}</{t}>")(rng.choice(["td", "td", "th"]))
    page = lambda: rng.choice(["", "<html><body>", "Here: <p>", "<div>x</div><br>"]) + "<table>" + "".join("<tr>" + "".join(cell() for _ in range(rng.randint(0, 4))) + "</tr>" for _ in range(rng.randint(0, 5))) + "</table>" + rng.choice(["", "</body></html>", " and <b>more"])
    df = spark.createDataFrame([(k, page()) for k in range(400)], "k int, html string")
    odd = ["<!-- <table></table> --><table><tr><td>x</td></tr></table>", "<TABLE><tr><td>a</td></tr></TABLE>", "<table><tr><td>a<td>b</tr></table>", "<table><tr><td>&copy;</td></tr></table>", "<table><tr><td><b>x</b></td></tr></table>", "<table><tr><td>open", "", "no table", "<script><table></script><table><tr><td>y</td></tr></table>"]
    df = df.union(spark.createDataFrame([(1000 + k, h) for k, h in enumerate(odd)], df.schema))
    rows = df.withColumn("plain", shred.plain_table(F.col("html")).isNotNull())
    rows = shred.with_first_table(shred.with_first_table(shred.shred_tables(rows, "html", "g"), "html", "f"), "html", "w", notes=None)
    n = 0
    for r in rows.collect():
        table = shred.parse(r.html)
        n += r.plain
        assert r.plain == (r.k < 1000), r.html
        if table is None:
            assert r.g.nodes is None and r.g.grid == [] and r.f is None and r.g.shape is None
            continue
        assert r.w.html == f"<html><body>{table.html()}</body></html>" and r.w.removed == 0
        assert (r.g.grid, r.g.bad_spans) == shred.grid_of(table) and r.g.n_elements == sum(1 for _ in table.all())
        assert [x.asDict() for x in r.g.nodes] == shred.nodes_of(table), r.html
        removed = shred.without_notes(table)
        assert (r.f.html, r.f.removed) == (f"<html><body>{table.html()}</body></html>", removed), r.html
    assert n == 400


def test_large_plain_table(spark):
    from gridscore.operators import shred

    html = "<table>" + "<tr>" + "<td>abc &amp; d</td>" * 20 + "</tr>" + ("<tr>" + "<td>12.5</td>" * 20 + "</tr>") * 3000 + "</table>"
    df = spark.createDataFrame([(html,)], "html string")
    r = shred.shred_tables(df.where(shred.plain_table(F.col("html")).isNotNull()), "html", "g").select(F.size("g.grid").alias("rows"), "g.n_elements").first()
    assert (r["rows"], r.n_elements) == (3001, 3001 * 21)


def test_ignored_tags(spark):
    from gridscore.operators import shred

    df = spark.createDataFrame([("<table><thead><tr><td>a <b>b</b><i>c</i></td></tr></thead></table>",)], "html string")
    r = shred.shred_tables(df, "html", "g", ignore_nodes=("b", "thead")).first().g
    assert [n.tag for n in r.nodes] == ["td", "tr", "table"] and r.nodes[0].content == f"a b{shred.TAG_OPEN}i{shred.TAG_CLOSE}c{shred.TAG_OPEN}/i{shred.TAG_CLOSE}" and r.n_elements == 3


@pytest.mark.parametrize("mode", ["chars", "tokens"])
def test_tree_scores_of_all_kinds_of_pairs(spark, mode):
    """The job's scores are those of the plain distance, for pairs that repeat, differ in shape, or have no table."""
    from gridscore.operators import shred, treedist

    rng = random.Random(21)
    row = lambda: "<tr>" + "".join(f"<td{rng.choice(['', '', ' colspan=2'])}>{rng.choice(['', 'a', 'ab', 'abc', '<b>x</b>'])}</td>" for _ in range(rng.randint(1, 3))) + "</tr>"
    tables = ["<table>" + "".join(row() for _ in range(rng.randint(1, 4))) + "</table>" for _ in range(12)] + ["", "none", "<table></table>"]
    pairs = [(k, rng.choice(tables), rng.choice(tables), rng.random() < 0.9) for k in range(150)]
    df = shred.shred_tables(shred.shred_tables(spark.createDataFrame(pairs, "k int, x string, y string, ok boolean"), "x", "p"), "y", "g")
    got = {r.k: r for r in treedist.tree_scores(df.select("k", "ok", "p", "g"), where=F.col("ok"), mode=mode).collect()}
    for k, x, y, ok in pairs:
        a, b = shred.parse(x), shred.parse(y)
        want = [0.0, 0.0]
        if ok and a is not None and b is not None:
            n = max(sum(1 for _ in a.all()), sum(1 for _ in b.all()), 1)
            na, nb = nodes_of(a), nodes_of(b)
            want = [max(0.0, 1 - tree_distance(na, nb, False, mode) / n), max(0.0, 1 - tree_distance(na, nb, True, mode) / n)]
        assert abs(got[k].teds - want[0]) < 1e-9 and abs(got[k].teds_s - want[1]) < 1e-9, (x, y)


def test_plain_markup_is_read_as_any_other():
    from gridscore.operators.shred import FirstTable

    def fully(html):
        p = FirstTable()
        p.feed(html)
        p.close()
        return p.table

    rng = random.Random(11)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", '<td colspan="2">', "</td>", '<TH rowspan="2" >', "</th>", "a", "&amp;", "&amp", " x ", "<br>", "<br/>", "<td/>", "<b>", "</b>", "<thead>", "</thead>",
            "<caption>", "</caption>", "<!-- c -->", "<", "<i class='q'>", "</i >", "<td colspan=2>", "<title>", "</title>", "\n", '</td x="1">', '<td a="1"b="2">', "<script>", "</script>", "&#65;", "&lt"]
    for _ in range(3000):
        html = rng.choice(["", "<table>"]) + "".join(rng.choice(bits) for _ in range(rng.randint(1, 24)))
        one, two = parse(html), fully(html)
        assert (one is None) == (two is None) and (one is None or one.html() == two.html()), html


def test_upsert_and_stream(spark):
    from gridscore.operators.upsert import fixed_sample, upsert

    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), (None, 2, "z"), ("c", 1, "w")], "k string, v int, note string")
    assert sorted(map(tuple, upsert(old, new, ["k"], "v").collect()), key=str) == sorted([("b", 1, None), ("a", 7, "y"), (None, 2, "z"), ("c", 1, "w")], key=str)
    assert upsert(old.limit(0), new.limit(0), ["k"], "v").collect() == []
    ids = spark.range(50).select(F.col("id").cast("string").alias("sample_id"))
    one, two = ([r.sample_id for r in fixed_sample(ids.repartition(k), 20, 7).collect()] for k in (1, 5))
    assert one == two == sorted(one) and len(set(one)) == 20 and fixed_sample(ids, 99, 7).count() == 50


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and set(entry.oracle_sql()) <= set(entry.queries())
