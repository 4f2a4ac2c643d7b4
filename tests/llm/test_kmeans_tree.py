"""The k-means tree: recall against brute force, exact cases, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridscore.llm import kmeans_tree

ROWS = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, k=20):
    """{query: [(id, score)]}: everything but the query's own row, sums in order of components."""
    def product(a, b):
        total = 0.0
        for x, y in zip(a, b):  # not sum(), which corrects for rounding
            total += float(np.float32(x)) * float(np.float32(y))
        return total

    out = {}
    for q in (i for i in range(len(ids)) if ids[i] % 20 == 0):
        near = sorted((-product(vectors[q], vectors[j]), ids[j]) for j in range(len(ids)) if j != q)[:k]
        out[ids[q]] = [(i, -s) for s, i in near]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute([i for i, _ in rows], [v.tolist() for _, v in rows])
    out = got(entry.queries()["op12_kmeans_tree"](spark, sf))
    assert out.keys() == want.keys() and all(len(out[q]) == 20 for q in want)
    assert sum(len({i for i, _ in out[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    scores = {i: v for i, v in rows}
    assert all(abs(s - scores[q] @ scores[i]) < 1e-12 for q in out for i, s in out[q])


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_leaves_and_copies(spark, block_rows):
    """Many leaves and blocks; one vector held by a third of the rows, whose ties go to the smallest ids."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 3
    vectors = [(centres[k % 12] + rng.normal(size=8)).astype(np.float32).tolist() for k in range(600)]
    common = [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0]
    vectors = [common if k % 3 == 0 else v for k, v in enumerate(vectors)]
    ids = [7 * k for k in range(600)]
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors)], ROWS).repartition(5)
    out = got(kmeans_tree.search(df, F.col("id") % 20 == 0, leaf_rows=20, block_rows=block_rows, query_rows=block_rows, recall=1.0, sample_queries=1000))
    assert out == brute(ids, vectors)
    part = got(kmeans_tree.search(df, F.col("id") % 20 == 0, leaf_rows=20, block_rows=block_rows))
    want = brute(ids, vectors)
    assert sum(len({i for i, _ in part[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_odd_rows(spark):
    """Nulls, zeros, components that are no numbers, other lengths, repeated rows, equal ids, fewer rows than asked for."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (20, [1.0], None), (40, None, 1), (60, [], 1), (80, [0.0, -0.0], 1), (100, [nan, 1.0], 1), (120, [1.0, None], 1), (140, [inf, 0.0], 1), (None, [5.0, 5.0], 1), (3, [2.0, 1.0], 1), (4, [-1.0, 3.0], 1), (20, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("id", "h", "u", "vec", "leaf", "near", "n", "query_id", "rank", "score")})
    out = kmeans_tree.digest(df).collect()
    of = lambda q: [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q]
    assert of(0) == [(3, 2.0), (20, 1.0), (20, 0.0), (4, -1.0)]
    # id 20 has two vectors: each is a query, and a candidate for the other.
    assert sorted(of(20)) == sorted([(3, 2.0), (0, 1.0), (20, 0.0), (4, -1.0)] + [(4, 6.0), (3, 2.0), (0, 0.0), (20, 0.0)])
    assert {r.query_id for r in out} == {0, 20}
    for none in ([], [(1, [1.0], 1)], [(20, None, 1)]):
        assert kmeans_tree.digest(spark.createDataFrame(none, ROWS)).collect() == []
    assert kmeans_tree.digest(spark.createDataFrame([(20, [1.0], 1)], ROWS)).collect() == []
