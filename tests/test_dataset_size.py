"""A dataset's lines are compressed, and come back whole."""

from gridscore.sources import files


def test_lines_are_compressed(spark, tmp_path):
    html = "<table>" + "<tr><td>cell</td></tr>" * 50 + "</table>"
    rows = spark.createDataFrame([("d", str(k), f"a/{k}.png", html, {"k": str(k)}) for k in range(200)], "dataset string, sample_id string, image string, gt_html string, meta map<string,string>")
    at = str(tmp_path / "set")
    files.write_dataset(rows, at, "s")
    for part in ("samples", "manifest"):
        own = [f for f in (tmp_path / "set" / part).rglob("part-*")]
        assert own and all(f.name.endswith(".gz") for f in own) and sum(f.stat().st_size for f in own) < 200 * len(html) / 10
    assert {(r.sample_id, r.gt_html) for r in files.read_samples(spark, f"{at}/samples").collect()} == {(str(k), html) for k in range(200)}
    assert {(r.id, r.value) for r in files.read_dataset(spark, at, "d").collect()} == {(str(k), html) for k in range(200)}
