"""Tables and responses are shredded and converted once for each text and version of the rules."""

from pyspark.sql import functions as F

from gridscore.operators import ingest, once, scoring


def _html(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def _tables(spark):
    one, two, odd = _html("ab", "12"), _html("ab", "13"), '<table><tr><td colspan="2">x<b>y</b></td></tr><tr><td>1</table>'
    samples = spark.createDataFrame([("d", "1", "i", one), ("d", "2", "i", one), ("d", "3", "i", odd), ("d", "4", "i", None)], "dataset string, sample_id string, image string, gt_html string")
    rows = [("d", r, s, 1, h, True, h is not None, 1.0, None) for r, s, h in (("a", "1", one), ("a", "2", two), ("a", "3", odd), ("b", "1", two), ("b", "2", one), ("b", "4", None))]
    return samples, spark.createDataFrame(rows, "dataset string, run_id string, sample_id string, seq int, html string, run_ok boolean, conversion_ok boolean, seconds double, error string")


def test_second_scoring_shreds_nothing(spark, tmp_path, monkeypatch):
    samples, predictions = _tables(spark)
    plain = sorted(map(tuple, scoring.score_runs(samples, predictions).collect()))
    shredded, real = [], once.shred_tables
    monkeypatch.setattr(once, "shred_tables", lambda df, *a: shredded.append(df) or real(df, *a))
    at = str(tmp_path)

    def run():
        shredded.clear()
        out = sorted(map(tuple, scoring.score_runs(samples, predictions, shredded=at).collect()))
        texts = [r.text for df in shredded for r in df.collect()]  # each side also asks once, without rows, for the columns
        return out, sorted(texts)

    first, texts = run()
    assert first == plain and len(texts) == len(set(texts)) == 4  # three tables and the empty text, each once
    again, texts = run()
    assert again == plain and texts == []
    fresh = spark.createDataFrame([("d", "a", "1", 2, _html("ab", "99"), True, True, 1.0, None)], predictions.schema)
    predictions = predictions.union(fresh)
    more, texts = run()
    assert more == sorted(map(tuple, scoring.score_runs(samples, predictions).collect())) and texts == [_html("ab", "99")]


def test_rules_of_another_version(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([(1, _html("a")), (2, _html("a")), (3, None)], "k int, html string")
    for version in ("1", "2", "1"):
        out = {r.k: r.t.grid for r in once.shredded_once(df, "html", "t", at, version).collect()}
        assert out == {1: [["a"]], 2: [["a"]], 3: []}
    kept = spark.read.parquet(f"{at}/shredded")
    assert {(r.version, r["count"]) for r in kept.groupBy("version").count().collect()} == {(1, 2), (2, 2)}


def test_reconversion_is_kept(spark, tmp_path):
    raw = spark.createDataFrame([("r1", "|a|b|\n|---|---|\n|1|2|"), ("r2", "none"), ("r3", "|a|b|\n|---|---|\n|1|2|")], "raw_path string, value string")
    rows = spark.createDataFrame([(p, "old", False, "old") for p in ("r1", "r2", "r3", "r4")], "raw_path string, html string, conversion_ok boolean, error string")
    plain = sorted(map(tuple, ingest.reconvert(rows, raw).collect()))
    for _ in range(2):
        assert sorted(map(tuple, ingest.reconvert(rows, raw, str(tmp_path)).collect())) == plain
    assert spark.read.parquet(f"{tmp_path}/converted-stripped").count() == 2
    assert spark.createDataFrame([], raw.schema).transform(lambda df: once.converted_once(df, "value", str(tmp_path / "none"))).where(F.lit(True)).collect() == []
