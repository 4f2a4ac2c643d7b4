"""Readers and writers on real files, the shared folder, running counts, ties, patterns and streams."""

import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gridscore.operators import ingest, requests, upsert
from gridscore.operators.ordinal import amount_before
from gridscore.sources import files, imports, shared
from gridscore.streaming import latest as streams


def test_paired_folders(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "gt").mkdir()
    for name in ("a.png", "b.JPEG", "c.gif", "d.bmp", "e.webp"):
        (tmp_path / "images" / name).write_bytes(b"x")
    (tmp_path / "gt" / "a.html").write_bytes(b"<table><tr><td>\xff1</td></tr></table>")
    (tmp_path / "gt" / "b.html").write_text("|x|y|\n|---|---|\n|1|2|")
    (tmp_path / "gt" / "c.html").write_text("<table></table>")
    (tmp_path / "gt" / "d.html").write_text("no table")
    images = files.list_files(spark, str(tmp_path / "images"))
    assert {r.length for r in images.collect()} == {1}
    out = {r.sample_id: r for r in imports.paired_samples(images, files.read_texts(spark, str(tmp_path / "gt")), "p").collect()}
    assert sorted(out) == ["a", "b", "d"] and out["a"].image.endswith("/images/a.png") and out["b"].meta["source_gt"].endswith("/gt/b.html")
    assert out["a"].gt_html == "<html><body><table><tr><td>�1</td></tr></table></body></html>" and out["b"].gt_html.count("<th>") == 2 and out["d"].gt_html == "no table"


def test_manifest_array(spark, tmp_path):
    entries = [{"id": "1", "image": "a.png", "gt": "a.html", "source": "s", "more": 5}, {"id": "2", "image": "b.png", "gt": "b.html"}, {"image": "c.png", "gt": "a.html"}]
    (tmp_path / "manifest.json").write_text(json.dumps(entries, indent=1))
    manifest = files.read_manifest(spark, str(tmp_path / "manifest.json"))
    images = spark.createDataFrame([("a.png",), ("b.png",), ("a.png",)], "image string")
    truths = spark.createDataFrame([("a.html", "<table></table>")], "gt string, value string")
    assert [(r.sample_id, r.gt_html, r.meta["dataset_revision"]) for r in imports.manifest_samples(manifest, images, truths, "d", "r9").collect()] == [("1", "<table></table>", "r9")]
    assert sorted(r.missing for r in imports.manifest_missing(manifest, images, truths).collect()) == ["2", "c.png"]


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"dataset": "d", "run_id": "r", "sample_id": "s", "seq": 1, "run_ok": true}\n\n{"dataset": "d", "run_id": "r", "sample_id": "s", "seq": 2, "html": "x"}\n')
    rows = files.read_predictions(spark, str(tmp_path / "p.jsonl"))
    assert sorted((r.seq, r.run_ok, r.html) for r in rows.collect()) == [(1, True, None), (2, None, "x")]
    assert files.read_predictions(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "s.csv").write_bytes("﻿dataset,model_parser,tables,TEDS ↑,note\nd,r,3,0.5,\n".encode())
    from gridscore.operators.scoring import normalize_summary

    r = normalize_summary(files.read_csv(spark, str(tmp_path / "s.csv"))).first()
    assert (r.dataset, r.run_id, r.tables, r.teds, r.note) == ("d", "r", "3", "0.5", None)


def test_raw_texts_of_a_run(spark, tmp_path):
    (tmp_path / "one.txt").write_text("<table><tr><td>new</td></tr><tr><td>Source: x</td></tr></table>")
    raw = files.read_texts(spark, str(tmp_path)).select(F.col("path").alias("raw_path"), "value")
    at = raw.first().raw_path
    rows = spark.createDataFrame([(at, "old", False, "old"), ("gone", "kept", True, None)], "raw_path string, html string, conversion_ok boolean, error string")
    out = {r.raw_path: (r.html, r.conversion_ok, r.error) for r in ingest.reconvert(rows, raw).collect()}
    assert out == {at: ("<html><body><table><tr><td>new</td></tr></table></body></html>", True, None), "gone": ("kept", True, None)}


def test_scores_replace_their_own_run(spark, tmp_path):
    at = str(tmp_path / "scores")
    df = spark.createDataFrame([("d", "a", "1", 0.1), ("d", "b", "1", 0.2), ("e", "a", "1", 0.3)], "dataset string, run_id string, sample_id string, teds double")
    assert files.read_scores(spark, at, df.schema).count() == 0
    files.write_scores(df, at)
    files.write_scores(spark.createDataFrame([("d", "a", "2", 0.9)], df.schema), at)
    assert sorted(map(tuple, files.read_scores(spark, at, df.schema).select(*df.columns).collect())) == [("d", "a", "2", 0.9), ("d", "b", "1", 0.2), ("e", "a", "1", 0.3)]


def test_datasets_in_one_folder(spark, tmp_path):
    """A second dataset leaves the first; the same one again is replaced."""
    at = str(tmp_path / "data")
    rows = lambda d, *ids: spark.createDataFrame([(d, i, f"x/{i}.png", f"<table>{i}</table>", {"k": "v"}) for i in ids], "dataset string, sample_id string, image string, gt_html string, meta map<string,string>")
    for d, *ids in (("A", "1", "2"), ("B", "1"), ("A", "3")):
        assert files.write_dataset(rows(d, *ids), at, "s").first().sample_count == len(ids)
    assert {(r.dataset, r.sample_id) for r in files.read_samples(spark, f"{at}/samples").collect()} == {("A", "3"), ("B", "1")}


def test_packed_texts(spark, tmp_path):
    """Many texts in few files; names are strings, whatever they look like."""
    at = str(tmp_path / "t")
    names = ["0012", "12", "1e5", "2026-01-01", "true", "a b", "a/b", "x=1"]
    many = spark.range(100_000).select(F.format_string("%07d", "id").alias("name"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("value"))
    files.write_texts(many.union(spark.createDataFrame([(n, f"text of {n}") for n in names], "name string, value string")), at)
    assert len(list((tmp_path / "t").glob("*.parquet"))) <= 20
    back = files.read_packed(spark, at)
    assert {r.path: r.value for r in back.where(F.col("path").isin(*names)).collect()} == {n: f"text of {n}" for n in names}
    assert back.count() == 100_000 + len(names) == back.select("path").distinct().count()
    listed = files.list_packed(spark, at)
    assert {r.path: r.length for r in listed.where("path >= '0099998' AND path <= '0099999'").collect()} == {"0099998": 10, "0099999": 10}
    assert "value" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_by_several_tasks(spark, tmp_path, indent):
    """Objects with brackets, quotes and escapes inside, in splits of a few hundred bytes."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["}", "{", "[", "]", '"', "\\", ",", ":", "é", "a", "\n"]) for _ in range(rng.randint(0, 6)))
    made = lambda k: {"id": str(k), word() + "k": word(), "deep": [{"x": [word(), {"y": word()}]}, word()], "n": 5}
    arrays = {"a.json": [made(k) for k in range(200)], "b.json": [], "c.json": [made(900), 7, "}{", [1], made(901)]}
    (tmp_path / "in").mkdir()
    for name, array in arrays.items():
        (tmp_path / "in" / name).write_text(json.dumps(array, indent=indent, ensure_ascii=rng.random() < 0.5))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        from gridscore.sources.arrays import read_json_array

        assert spark.read.text(str(tmp_path / "in"), lineSep="}").rdd.getNumPartitions() > 10
        rows = read_json_array(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.pos)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(json.loads(r.value))
    assert got == {"a.json": arrays["a.json"], "c.json": [x for x in arrays["c.json"] if isinstance(x, dict)]}
    assert [r.pos for r in rows if r.path.endswith("c.json")] and sorted(r.pos for r in rows if r.path.endswith("a.json")) == list(range(200))


def test_a_dataset_is_read_back(spark, tmp_path):
    """Row for row, with meta that overrides fields, null meta and no truth."""
    at = str(tmp_path / "d")
    rows = [("d", "0012", "x/i.png", "<table>1</table>", {"k": "v", "source": "own"}), ("d", "12", "i2.png", None, None), ("d", "1e5", "z/i3.png", "t", {})]
    df = spark.createDataFrame(rows, "dataset string, sample_id string, image string, gt_html string, meta map<string,string>")
    files.write_dataset(df, at, "html:x")
    back = {r.id: r for r in files.read_dataset(spark, at, "d").collect()}
    assert {k: (r.image, r.gt, r.source, r.value) for k, r in back.items()} == {"0012": ("tables/i.png", "gt/0012.html", "own", "<table>1</table>"), "12": ("tables/i2.png", "gt/12.html", "html:x", ""), "1e5": ("tables/i3.png", "gt/1e5.html", "html:x", "t")}
    assert back["0012"].record == {"id": "0012", "image": "tables/i.png", "gt": "gt/0012.html", "k": "v", "source": "own"}
    samples = imports.manifest_samples(files.read_dataset(spark, at, "d"), spark.createDataFrame([("tables/i.png",)], "image string"), spark.createDataFrame([("gt/0012.html", "T")], "gt string, value string"), "d", None)
    assert [(r.sample_id, r.gt_html, r.meta) for r in samples.collect()] == [("0012", "T", {**back["0012"].record, "dataset_revision": None})]


def test_shared_folder(spark):
    on = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, applicationId="test-app"))
    assert shared.shared_dir(on("local[4]")) == shared.shared_dir(on("local"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(on(master))
    path = shared.new_path(spark, "table")
    assert shared.store(spark.range(3), path).count() == 3
    shared.remove(spark, path)
    assert files.or_empty(lambda: spark.read.parquet(path), spark, "id long").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_amount_before(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randint(0, 5)) for k in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(parts)
    want = lambda own: {k: sum(n for _, j, n in own if j < k) for _, k, _ in own}
    assert {r.k: r.b for r in amount_before(df, ["k"], F.col("n"), "b").collect()} == want(rows)
    grouped = {k: v for g in ("a", "b", None) for k, v in want([r for r in rows if r[0] == g]).items()}
    assert {r.k: r.b for r in amount_before(df, ["k"], F.col("n"), "b", within=["g"]).collect()} == grouped
    assert amount_before(df.limit(0), ["k"], F.col("n"), "b").collect() == []


def test_latest_takes_the_greatest_of_ties(spark):
    rows = [("x", 1, v, {"m": str(v)}) for v in (3, 8, 1, 7)] + [("x", 0, 99, None), (None, 2, 5, None), (None, 2, None, None)]
    df = spark.createDataFrame(rows, "k string, seq int, v int, m map<string,string>").repartition(4)
    assert {(r.k, r.seq, r.v) for r in upsert.latest(df, ["k"], "seq").collect()} == {("x", 1, 8), (None, 2, 5)}


def test_patterns_in_blocks(spark):
    models = spark.createDataFrame([("Qwen3:8b",), ("qwen3:30b",), ("other.x",), ("otherzx",)], "tag string")
    targets = spark.createDataFrame([("a", None, ["qwen*"]), ("b", "otherzx", None), ("c", None, ["other.?", "*8B"]), ("d", None, ["none"]), ("e", None, None)], "id string, model_tag string, model_patterns array<string>")
    want = {"a": ["Qwen3:8b", "qwen3:30b"], "b": ["otherzx"], "c": ["Qwen3:8b", "other.x"], "d": [], "e": []}
    assert {r.id: r.installed for r in requests.match_models(models, targets).collect()} == want
    assert {(r.id, r.tag) for r in requests.installed_models(models, targets).collect()} == {(k, t) for k, ts in want.items() for t in ts}


def test_patterns_by_grams(spark):
    """Against trying all pairs with fnmatch: pieces of every length, ends, classes, brackets that nothing closes, patterns without a letter."""
    import fnmatch

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abAB:.-+$^[]é7") for _ in range(n))
    tags = sorted({word(rng.randint(0, 9)) for _ in range(400)})
    patterns = ["*", "?", "??*", "", "a*", "*b", "*a*", "[ab]*", "[!a]?", "[", "a[", "*[]]", "[!]]*", "[a-b]b*", "*.*", "a?b", "*\\*", "^*", "*$"]
    patterns += ["".join(rng.choice(["*", "?", "[ab]", "[!b.]", word(1), word(2), word(4)]) for _ in range(rng.randint(1, 4))) for _ in range(150)] + [f"*{t[1:-1]}*" for t in tags[::9]] + tags[::7]
    closed = lambda p: all("[" not in x for x in p.split("]")[-1:])
    patterns = [p for p in patterns if "&&" not in p and closed(p) or p in ("[", "a[")]
    want = {(p, t) for p in patterns for t in tags if fnmatch.fnmatchcase(t.lower(), p.lower())}
    met = requests.pattern_matches(spark.createDataFrame([(t,) for t in [*tags, None]], "tag string"), spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string"))
    assert {(r.pattern, r.tag) for r in met.collect()} == want
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "tag string")
    assert requests.pattern_matches(none, spark.createDataFrame([("*",)], "pattern string")).collect() == []


def test_many_patterns(spark):
    """10,000 patterns by 200,000 tags, by counts alone; a nested loop would try two thousand million pairs."""
    tags = spark.range(200_000).select(F.concat(F.lit("model-"), F.col("id").cast("string"), F.lit(":"), (F.col("id") % 7).cast("string"), F.lit("b")).alias("tag"))
    patterns = spark.range(10_000).select(F.concat(F.lit("*-"), (F.col("id") * 17).cast("string"), F.lit(":?B")).alias("pattern"))
    met = requests.pattern_matches(tags, patterns)
    assert met.count() == 10_000


PAGES = [
    ("<table>a<table>b</table>c</table>x<TABLE id=1>d</TABLE >", ["<table>a<table>b</table>c</table>", "<table>b</table>", "<TABLE id=1>d</TABLE >"]),
    ("</table><table>open<table>in</table>", ["<table>open<table>in</table>", "<table>in</table>"]),
    ("<tables><p>none</p>", []),
    (None, []),
]


def test_tables_of_a_page(spark):
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PAGES)], "k int, page string")
    assert {r.k: r.t for r in df.select("k", imports.table_elements(F.col("page")).alias("t")).collect()} == {k: t for k, (_, t) in enumerate(PAGES)}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    at, into = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "dataset string, run_id string, sample_id string, seq int, v int"
    rng = random.Random(4)
    rows = [("d", rng.choice("ab"), str(rng.randint(0, 9)), s, s * 10) for s in rng.sample(range(100), 60)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(at)
    want = {}
    for r in sorted(rows, key=lambda r: r[3]):
        want[r[:3]] = r
    for again in ("c1", "c2"):  # a lost checkpoint: all batches once more
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
        streams.stream_latest(stream, into, str(tmp_path / again), buckets=4).awaitTermination()
        assert {tuple(r) for r in streams.latest_rows(spark, into, stream.schema).select("dataset", "run_id", "sample_id", "seq", "v").collect()} == set(want.values())
    assert len(list((tmp_path / "state" / "rows").glob("gen=*/bucket=*"))) <= 4 * 3


def test_board_of_nothing(spark, tmp_path):
    assert streams.board(spark, str(tmp_path / "none")).collect() == []
