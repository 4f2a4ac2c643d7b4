"""Streams whose driver dies at any point of a batch: readers see the table before it or after it, and a rerun ends the same."""

import random

import pytest
from pyspark.errors.exceptions.captured import StreamingQueryException

from gridscore.streaming import latest as streams
from gridscore.streaming import snapshots

KEYS = ("dataset", "run_id", "sample_id")


def scores(seed, n, first):
    rng = random.Random(seed)
    return [("d", rng.choice("ab"), str(rng.randint(0, 12)), first + k, rng.random(), rng.random(), 0.5, 1, 2, False, False, 1.0) for k in range(n)]


SCHEMA = "dataset string, run_id string, sample_id string, seq int, " + streams.SCORES.removeprefix("dataset string, run_id string, ")


def last(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[3]):
        out[r[:3]] = r
    return out


def seen(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = {tuple(r[k] for k in KEYS): r for r in streams.latest_rows(spark, path, schema).collect()}
    board = {r.run_id: (r.tables, round(r.teds, 9)) for r in streams.board(spark, path).collect()}
    return {k: r.seq for k, r in rows.items()}, board


def wanted(rows):
    own = last(rows)
    board = {}
    for run in sorted({k[1] for k in own}):
        teds = [r[4] for k, r in own.items() if k[1] == run]
        board[run] = (len(teds), round(sum(teds) / len(teds), 9))
    return {k: r[3] for k, r in own.items()}, board


class Died(Exception):
    pass


def dies(*_, **__):
    raise Died


@pytest.mark.parametrize("where", ["while sums are made", "before the pointer", "after the pointer"])
def test_death_in_a_batch(spark, tmp_path, monkeypatch, where):
    source, path, progress = (str(tmp_path / x) for x in ("in", "table", "progress"))
    one, two = scores(1, 40, 0), scores(2, 40, 30)

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        streams.stream_summaries(spark.readStream.schema(SCHEMA).parquet(source), path, progress, buckets=4).awaitTermination()

    add(one)
    run()
    before = seen(spark, path)
    assert before == wanted(one)
    add(two)
    patch = {"while sums are made": (streams, "partial_sums"), "before the pointer": (snapshots, "write_new"), "after the pointer": (snapshots, "sweep")}[where]
    for _ in range(2):  # it may die again where it died before
        with monkeypatch.context() as m:
            m.setattr(*patch, dies)
            with pytest.raises(StreamingQueryException):
                run()
        now = seen(spark, path)
        assert now == (wanted(one + two) if where == "after the pointer" else before)
    run()
    assert seen(spark, path) == wanted(one + two)
    add(scores(3, 5, 200))
    run()
    assert seen(spark, path) == wanted(one + two + scores(3, 5, 200))
    # What dead batches wrote is gone; each folder that is left is told of by a pointer that is kept.
    told = {g for p in snapshots._pointers(spark, path) for gens in snapshots._load(spark, path, p).values() for g in gens.values()}
    assert {x.name.removeprefix("gen=") for t in ("rows", "sums") for x in (tmp_path / "table" / t).iterdir() if x.name.startswith("gen=")} == told


def test_readers_keep_their_files(spark, tmp_path):
    """A reader that began before a change reads what it began with; a second writer of the same change is refused."""
    path = str(tmp_path / "t")
    schema = "k int, v int, bucket int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    snapshots.replace(spark, path, {"rows": rows((1, 1, 0), (2, 1, 1))}, [0, 1])
    own = rows().drop("bucket").schema
    reader = snapshots.read(spark, path, "rows", own)
    snapshots.replace(spark, path, {"rows": rows((1, 2, 0))}, [0])
    assert {(r.k, r.v) for r in reader.collect()} == {(1, 1), (2, 1)}
    assert {(r.k, r.v, r.bucket) for r in snapshots.read(spark, path, "rows", own).collect()} == {(1, 2, 0), (2, 1, 1)}
    assert {(r.k, r.v) for r in snapshots.read(spark, path, "rows", own, [1]).collect()} == {(2, 1)}
    with pytest.raises(FileExistsError):
        snapshots.write_new(spark, f"{path}/pointers/{2:012d}", "{}")
    snapshots.replace(spark, path, {"rows": rows()}, [1])
    assert {(r.k, r.v) for r in snapshots.read(spark, path, "rows", own).collect()} == {(1, 2)}
