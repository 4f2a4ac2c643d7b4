"""Scores of pairs of texts are kept beside the shredded tables: a second pass compares no tables."""

from gridscore.operators import scoring


def _html(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_second_scoring_compares_nothing(spark, tmp_path, monkeypatch):
    one, two, odd = _html("ab", "12"), _html("ab", "13", "x"), '<table><tr><td colspan="2">x 7<b>y</b></td></tr><tr><td>1</table>'
    samples = spark.createDataFrame([("d", str(k), "i", h) for k, h in enumerate((one, two, odd, None, one))], "dataset string, sample_id string, image string, gt_html string")
    flags = ((True, True), (False, True), (True, False), (None, None), (True, None))
    rows = [("d", f"r{i}{j}", str(k), 1, h, ran, ok, 1.0, None) for i, (ran, ok) in enumerate(flags) for j, h in enumerate((one, two, odd, None, "")) for k in range(4)]
    predictions = spark.createDataFrame(rows, "dataset string, run_id string, sample_id string, seq int, html string, run_ok boolean, conversion_ok boolean, seconds double, error string")
    compared, real = [], scoring.tree_scores
    monkeypatch.setattr(scoring, "tree_scores", lambda df, *a: compared.append(df) or real(df, *a))
    run = lambda p: sorted(map(repr, scoring.score_runs(samples, p, shredded=str(tmp_path)).collect()))
    plain = lambda p: sorted(map(repr, scoring.score_runs(samples, p).collect()))
    assert run(predictions) == plain(predictions) and len(compared) == 1
    assert run(predictions) == plain(predictions) and len(compared) == 1
    fresh = spark.createDataFrame([("d", "new", "0", 2, _html("ab", "99"), True, True, 1.0, None)], predictions.schema)
    more = predictions.union(fresh)
    assert run(more) == plain(more) and [df.select("p_text", "g_text").count() for df in compared[1:]] == [1]
