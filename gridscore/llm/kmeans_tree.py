"""Nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is put into the leaf that it reaches by nearest centres. A query goes through the
tree best bin first: a priority queue holds the branches seen so far by the inner product with their centre, the best is opened,
until enough leaves are visited. How many are enough is measured: for a bounded set of queries the true neighbours among all rows
are found, and leaf visits are widened until the wanted recall is reached. Neighbouring leaves lie in blocks of bounded size, and large leaves in
several; a block of queries meets a block of rows once and compares only those of visited leaves.

Equal vectors are one point, which keeps as many of its smallest ids as a result can show, so a vector that a third of all rows hold costs
no more than another one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.llm.common import stored

BRANCH, ROUNDS = 8, 8
#: Most bytes of the sample and of the tree's centres on the driver.
SAMPLE_BYTES, TREE_BYTES = 64 << 20, 32 << 20


@dataclass(frozen=True)
class Tree:
    """centers (a row a node, the root first), the range of each node's children (empty: a leaf), and the number of each leaf, depth first."""

    centers: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre on every level."""
        out = np.zeros(len(vectors), np.int64)
        open_nodes = [(0, np.arange(len(vectors)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if self.first[node] == self.last[node]:
                out[rows] = self.leaf[node]
                continue
            near = nearest(vectors[rows], self.centers[self.first[node] : self.last[node]])
            for k in np.unique(near):
                open_nodes.append((self.first[node] + int(k), rows[near == k]))
        return out

    def visit(self, queries: np.ndarray, leaves: int) -> np.ndarray:
        """The first `leaves` leaves of each query in best-bin-first order; -1 where there are no more."""
        worth = -(queries @ self.centers.T)
        out = np.full((len(queries), leaves), -1, np.int64)
        for q, own in enumerate(worth):
            queue, found = [(0.0, 0)], 0
            while queue and found < leaves:
                _, node = heapq.heappop(queue)
                if self.first[node] == self.last[node]:
                    out[q, found] = self.leaf[node]
                    found += 1
                else:
                    for child in range(self.first[node], self.last[node]):
                        heapq.heappush(queue, (own[child], child))
        return out


def nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(1)[None, :] - 2 * (vectors @ centers.T), axis=1)


def _split(vectors: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """The cluster of each row by Lloyd's rounds from distinct starting rows."""
    centers = vectors[random.choice(len(vectors), BRANCH, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(vectors, centers)
        centers = np.stack([vectors[near == k].mean(0) if (near == k).any() else centers[k] for k in range(len(centers))])
    return nearest(vectors, centers)


def fit_tree(sample: np.ndarray, leaf_rows: int, seed: int = 0) -> Tree:
    """A tree whose leaves hold up to leaf_rows rows of the sample (more where rows cannot be told apart); an empty sample gives one leaf."""
    random = np.random.default_rng(seed)
    centers, first, last, leaf = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [0], [0], [-1]
    queue = [(0, np.arange(len(sample)))]
    for node, rows in queue:
        near = _split(sample[rows], random) if len(rows) > max(leaf_rows, BRANCH) else np.zeros(len(rows), np.int64)
        parts = np.unique(near)
        if len(parts) < 2:
            continue
        first[node], last[node] = len(centers), len(centers) + len(parts)
        for k in parts:
            queue.append((len(centers), rows[near == k]))
            centers.append(sample[rows[near == k]].mean(0))
            first.append(0), last.append(0), leaf.append(-1)
    stack, leaves = [0], 0
    while stack:
        node = stack.pop()
        stack.extend(range(last[node] - 1, first[node] - 1, -1))
        if first[node] == last[node]:
            leaf[node], leaves = leaves, leaves + 1
    return Tree(np.stack(centers), np.array(first), np.array(last), np.array(leaf))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Arrays of one length as rows of doubles."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of components, so that equal pairs give equal sums wherever they stand."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best(fast: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best vectors, ties to smaller ids. fast: their inner products but for rounding, or -inf; it
    picks with room for rounding, exact sums decide."""
    floor = np.full(len(queries), -np.inf)
    if fast.shape[1] > k:
        room = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
        floor = np.partition(fast, fast.shape[1] - k, axis=1)[:, fast.shape[1] - k] - room
    q, v = np.nonzero((fast >= floor[:, None]) & (fast > -np.inf))
    score = products(queries[q], vectors[v])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], v[kept], score[kept]


def _leaf_rows(tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow over points: each with its leaf."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(tree.value.leaf_of(matrix(b["vec"]))))

    return run


def _visits(tree, visits: int, block_of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow over query points: a row for each block of leaves that a point visits, with the leaves."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                seen = np.sort(tree.value.visit(matrix(b["vec"]), visits), axis=1)
                row, at = np.nonzero(seen >= 0)
                leaf = seen[row, at]
                block = block_of.value[leaf]
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(leaf)), pa.int32()), pa.array(leaf))
                own = b.take(pa.array(row[starts]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(block[starts]), lists], [*own.schema.names, "block", "leaves"])

    return run


def _truth(queries, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow over points with leaves: (q, leaf, id, score), the k best points of each query within a batch."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                vectors = matrix(b["vec"])
                q, v, score = best(queries.value @ vectors.T, queries.value, vectors, b["id"].to_numpy(), k)
                v = pa.array(v)
                yield pa.RecordBatch.from_arrays([pa.array(q), b["leaf"].take(v), b["id"].take(v), pa.array(score)], ["q", "leaf", "id", "score"])

    return run


FOUND = "qh long, qu long, id long, ids array<long>, own boolean, score double"


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best points of a block for each query of a block of queries, among the leaves that the query visits."""
    schema = pa.schema([("qh", pa.int64()), ("qu", pa.int64()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("own", pa.bool_()), ("score", pa.float64())])

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        if not queries.num_rows or not points.num_rows:
            return schema.empty_table()
        points = points.sort_by("leaf")
        asked, given = matrix(queries["vec"]), matrix(points["vec"])
        leaf, lists = points["leaf"].to_numpy(), queries["leaves"].combine_chunks()
        visits = {}
        for row, own in zip(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())).tolist(), lists.flatten().to_pylist()):
            visits.setdefault(own, []).append(row)
        fast = np.full((len(asked), len(given)), -np.inf)
        for own, rows in visits.items():
            lo, hi = np.searchsorted(leaf, [own, own + 1])
            fast[rows, lo:hi] = asked[rows] @ given[lo:hi].T
        q, v, score = best(fast, asked, given, points["id"].to_numpy(), k)
        a, b = queries.select(["h", "u"]).take(pa.array(q)), points.select(["h", "u", "id", "ids"]).take(pa.array(v))
        own = (a["h"].to_numpy() == b["h"].to_numpy()) & (a["u"].to_numpy() == b["u"].to_numpy())
        return pa.Table.from_arrays([a["h"], a["u"], b["id"], b["ids"], pa.array(own), pa.array(score)], schema=schema)

    return run


def vectors_of(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, h, u): the rows that take part, repeated ones once, and 128 bits of hash of their vectors.

    Rows without id, and vectors that are null, empty, zero or hold null or non-finite components, take no part. Vectors shorter than the
    longest are filled up with zeros.
    """
    kind = rows.schema[vec_col].dataType.elementType
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    own = own.where(F.coalesce(sound, F.lit(False))).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0).cast(kind)))  # no -0
    sizes = own.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        own = own.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast(kind), F.lit(sizes["b"]) - F.size("vec"))))
    return own.distinct().withColumn("h", F.xxhash64("vec")).withColumn("u", F.xxhash64(F.lit(1), "vec"))


def points_of(vectors: DataFrame, ids: int) -> DataFrame:
    """(vec, h, u, id, ids): a row for each distinct vector, with its smallest ids in order, `ids` of them at most, and the first of these."""
    nth = F.row_number().over(Window.partitionBy("h", "u", "vec").orderBy("id"))  # tasks keep their first rows before they meet
    kept = vectors.withColumn("nth", nth).where(F.col("nth") <= ids).groupBy("h", "u", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return kept.withColumn("id", F.col("ids")[0])


def sampled(points: DataFrame, rows: int) -> np.ndarray:
    """The vectors of the `rows` points of least hash, on the driver."""
    got = points.orderBy("u", "h").limit(rows).select("vec").toArrow()
    return matrix(got["vec"])


def calibrated_visits(tree: Tree, indexed: DataFrame, queries: DataFrame, k: int, recall: float, sample: int) -> tuple[int, float]:
    """How many leaves to visit, and the recall at that: the least number that finds the wanted share of the true k best points (a query's own
    left out) of `sample` query points, which are compared with all rows."""
    asked = sampled(queries, sample)
    told = indexed.sparkSession.sparkContext.broadcast(asked)
    met = indexed.select("vec", "id", "leaf").mapInArrow(_truth(told, k + 1), "q long, leaf long, id long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    truth = met.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("q", "leaf").toPandas()  # k + 1 rows for each sampled query
    order = tree.visit(asked, tree.leaves)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(tree.leaves)[None, :], axis=1)
    needed = rank[truth["q"].to_numpy(), truth["leaf"].to_numpy()]
    reached = np.cumsum(np.bincount(needed, minlength=tree.leaves)) / max(len(needed), 1)
    visits = 1
    while visits < tree.leaves and reached[visits - 1] < recall:
        visits += 1
    return visits, float(reached[visits - 1])


def search(
    rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95, leaf_rows: int = 256,
    sample_rows: int = 20_000, sample_queries: int = 128, block_rows: int = 8192, query_rows: int = 1024, seed: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, nearest first, ties to smaller ids; all other rows where there are no more than k.

    is_query is a condition on the id, named `id`. A query's own row, with its id and vector, is no candidate; rows of its id with another
    vector are, and so are rows of other ids with its vector. Scores are inner products in double precision. See vectors_of for what takes part;
    an empty table gives an empty one. sample_rows bounds the sample of the tree (and SAMPLE_BYTES), whose leaves are at most a fourth of
    that; beyond sample_rows / 4 * leaf_rows points leaves grow with the table. A task compares query_rows queries with block_rows points at a time,
    and each query has one result of k + 1 points from a block.
    """
    spark = rows.sparkSession
    vectors = stored(vectors_of(rows, id_col, vec_col), "vectors")
    points = stored(points_of(vectors, k + 1), "points")
    kind = points.schema["vec"].dataType.simpleString()
    wanted = vectors.where(is_query).select("id", "h", "u")
    counts = stored(wanted.groupBy("h", "u").agg(F.count("*").alias("n")), "wanted")
    total = counts.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = points.join(counts.select("h", "u").hint("merge"), ["h", "u"]).select("h", "u", "vec")
    asking = stored(asking, "queries")

    n = points.count()
    dims = points.select(F.size("vec").alias("d")).first()["d"]
    held = max(BRANCH, min(sample_rows, SAMPLE_BYTES // (8 * dims)))
    leaves = max(1, min(n // leaf_rows, held // 4, TREE_BYTES // (10 * dims)))
    sample = sampled(points, held)
    tree = fit_tree(sample, max(1, len(sample) // leaves), seed)
    shared = spark.sparkContext.broadcast(tree)

    indexed = stored(points.mapInArrow(_leaf_rows(shared), f"h long, u long, vec {kind}, ids array<long>, id long, leaf long"), "index")
    visits, _ = calibrated_visits(tree, indexed, asking, k, recall, sample_queries)

    # Blocks of about block_rows points, of neighbouring leaves or of a part of one leaf; each has its visitors in blocks. At most a row a leaf here.
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    block_of = np.zeros(tree.leaves, np.int64)
    held = 0
    for i in range(tree.leaves):
        fits = i == 0 or held + sizes[i] <= block_rows
        block_of[i] = 0 if i == 0 else block_of[i - 1] + (not fits)
        held = held + sizes[i] if fits else sizes[i]
    told = spark.sparkContext.broadcast(block_of)
    visiting = stored(asking.mapInArrow(_visits(shared, visits, told), f"h long, u long, vec {kind}, block long, leaves array<long>"), "visits")
    parts = np.maximum(1, -(-np.bincount(block_of, weights=sizes).astype(np.int64) // block_rows))
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(parts)], "block long, np long")
    asked_by = visiting.groupBy("block").agg(F.ceil(F.count("*") / query_rows).alias("nq"))
    blocks = stored(pieces.join(asked_by.hint("merge"), "block"), "blocks")
    where = spark.createDataFrame([(i, int(b)) for i, b in enumerate(block_of)], "leaf long, block long")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asked = visiting.join(F.broadcast(blocks), "block").withColumn("qb", F.pmod("u", "nq")).withColumn("pb", upto("np")).drop("np", "nq")
    given = indexed.join(F.broadcast(where), "leaf").join(F.broadcast(blocks), "block").withColumn("pb", F.pmod("u", "np")).withColumn("qb", upto("nq")).drop("np", "nq")
    keys = ["block", "qb", "pb"]
    met = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(_search(k + 1), FOUND)

    nth = F.row_number().over(Window.partitionBy("qh", "qu").orderBy(F.desc("score"), "id"))
    flat = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"), F.col("own").alias("own")))))
    top = met.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy(F.col("qh").alias("h"), F.col("qu").alias("u")).agg(F.slice(F.array_sort(flat), 1, k + 1).alias("near"))
    top = stored(top, "near")

    # Vectors that many queries share meet them by a broadcast; there are at most a thousand.
    heavy = F.col("n") > max(1000, total // 1000)
    hot = counts.where(heavy).select("h", "u").join(top.hint("merge"), ["h", "u"]).withColumnRenamed("near", "hot")
    some = wanted.join(F.broadcast(hot), ["h", "u"], "left")
    rest = some.where("hot IS NULL").drop("hot").join(top.hint("merge"), ["h", "u"])
    each = some.where("hot IS NOT NULL").withColumnRenamed("hot", "near").unionByName(rest)
    own = F.filter("near", lambda x: ~(x["own"] & (x["id"] == F.col("id"))))
    listed = each.select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of every row whose vec_id is divisible by 20 (see search)."""
    return search(embeddings, F.col("id") % 20 == 0)
