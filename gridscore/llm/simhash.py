"""SimHash near-duplicates with a byte-position inverted index and count filtering.

A fingerprint has eight bytes, so two that differ in at most three bits share at least five positional
bytes, and among those at least three in one half of the fingerprint. Postings are therefore keyed by three
positional bytes of a half (eight keys per distinct fingerprint). In a posting list the positional bytes shared
by two fingerprints are tallied; pairs with at least five are verified by counting bits. A posting list that is too
long is keyed anew by two more of the other five bytes, which no pair with five shared bytes can miss. (A list of one byte
would hold a 256th of all fingerprints, so bytes are combined.)
Long lists are searched from fingerprint to fingerprint for a spanning forest instead of all pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.common import replaced, stored, text_hash

MAX_BITS, LEAST_BYTES = 3, 5
#: Lists up to this size are compared by offset in bulk; longer ones are searched.
BULK = 16


def fingerprint_of(text: bytes | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles (XXH64, seed 42); no words: 0."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    shingles = zip(w, w[1:], w[2:]) if len(w) > 2 else [w]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t.as_py()) for t in texts], pa.int64())


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _key(fp: Column, number: int, at: tuple[int, ...]) -> Column:
    """One long: the number of the byte combination above the bytes themselves."""
    out = F.lit(number).cast("long")
    for i in at:
        out = out * 256 + _byte(fp, i)
    return out


TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _finer(fp: Column, number: int) -> Column:
    at = TRIPLES[number]
    rest = [i for i in range(8) if i not in at]
    return F.array(*[_key(fp, 100 + 10 * number + k, at + two) for k, two in enumerate(combinations(rest, 2))])


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of equal positional bytes first, then the bits of the pairs that reach it."""
    x = a ^ b
    near = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST_BYTES
    near[near] = np.bitwise_count(x[near]) <= MAX_BITS
    return near


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what a posting list joins: each fingerprint is compared with those not yet reached."""
    out, left = [], np.arange(len(fps))
    stack: list[int] = []
    while len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
        u = stack.pop()
        hit = linked(fps[left], np.full(len(left), fps[u], np.uint64)) if len(left) else np.zeros(0, bool)
        for v in left[hit].tolist():
            out.append((u, v))
            stack.append(v)
        left = left[~hit]
    return out


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints linked inside whole posting lists, which are sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    size = np.repeat(sizes, sizes)
    a, b = [], []
    for d in range(1, min(BULK, int(sizes.max()))):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & (size[d:] <= BULK))
        i = i[linked(fps[i], fps[i + d])]
        a.append(fps[i])
        b.append(fps[i + d])
    for s, n in zip(starts[sizes > BULK].tolist(), sizes[sizes > BULK].tolist()):
        pairs = np.array(forest(fps[s : s + n]), np.int64).reshape(-1, 2) + s
        a.append(fps[pairs[:, 0]])
        b.append(fps[pairs[:, 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _scan(batches):
    """mapInArrow over rows (key, fp) sorted by key; a list that is cut by a batch waits for the next one."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held = [np.zeros(0, np.int64)] * 2

    def emit(part):
        if len(part[0]):
            u, v = _links(part[0], part[1].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        yield from emit([np.ascontiguousarray(c[:cut]) for c in cols])
        held = [c[cut:] for c in cols]
    yield from emit([np.ascontiguousarray(c) for c in held])


def fingerprint_links(nodes: DataFrame, max_list: int = 2048) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp); connected as the graph of all links is."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = nodes.select("fp", F.posexplode(F.array(*[_key(F.col("fp"), k, at) for k, at in enumerate(TRIPLES)])).alias("number", "key"))
    long_lists = posted.groupBy("key").count().where(F.col("count") > max_list).select("key", F.lit(True).alias("long"))
    sized = posted.join(long_lists.hint("merge"), "key", "left")
    finer = F.lit(None).cast("array<bigint>")
    for k in range(len(TRIPLES)):
        finer = F.when(F.col("number") == k, _finer(F.col("fp"), k)).otherwise(finer)
    keyed = sized.select(F.explode(F.when(F.col("long"), finer).otherwise(F.array("key"))).alias("key"), "fp")
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_scan, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: the smallest node that can be reached, as a signed number.

    Large-star and small-star steps in turn; each step joins links with the minimum of their neighbours, so that no
    neighbourhood is gathered, and its result is stored in place of the last one.
    """
    def tidy(df):
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    edges, at = replaced(tidy(links), "links", None)
    seen = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        edges, at = replaced(tidy(small), "links", at)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component, text_hash): one row per row of docs; the id column keeps its name and may be of any type that can be ordered.

    component: the smallest id reachable over links of at most three differing bits, itself included. Null and empty texts have
    fingerprint 0, which links like any other. Rows with a null id get a fingerprint and a null component and link nothing. Rows
    with equal ids are one document that has several fingerprints only if their texts differ; those don't link by the id.
    Texts of any length are read whole. An empty table gives an empty table.
    """
    fps = stored(docs.select(F.col(id_col).alias("__id"), fingerprint(F.col(text_col).cast("binary")).alias("fp"), text_hash(F.col(text_col))), "fingerprints")
    nodes = stored(fps.where("__id IS NOT NULL").groupBy("fp").agg(F.min("__id").alias("least")), "nodes")
    found = components(fingerprint_links(nodes.select("fp")))
    classes = stored(nodes.join(found.hint("merge"), nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "classes")
    roots = classes.groupBy("root").agg(F.min("least").alias("component"))
    named = classes.join(roots.hint("merge"), "root").select(F.col("fp").alias("__fp"), "component")
    joined = fps.join(named.hint("merge"), fps["fp"] == F.col("__fp"), "left")
    return joined.select(F.col("__id").alias(id_col), "fp", F.when(F.col("__id").isNotNull(), F.col("component")).alias("component"), F.col("__t").alias("text_hash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component: of the rows of its smallest id the one of least fingerprint and text hash; of rows that are equal in
    both, the least by its other columns. Rows with a null id stay.

    An id whose texts differ may lose some and keep others: each row goes by its own component.
    """
    heads = near_duplicates(docs, id_col, text_col).where(F.col(id_col) == F.col("component"))
    heads = heads.groupBy("component").agg(F.min(F.struct("fp", "text_hash")).alias("__head")).select(F.col("component").alias("__id"), F.col("__head.text_hash").alias("__h"))
    own = docs.withColumn("__t", text_hash(F.col(text_col)))
    met = own.where(F.col(id_col).isNotNull()).join(heads.hint("merge"), (own[id_col] == F.col("__id")) & (own["__t"] == F.col("__h")))
    rest = [F.to_json(F.struct(*[c for c in docs.columns if c != text_col]))]
    nth = F.row_number().over(Window.partitionBy("__id", "__h").orderBy(*rest))
    return met.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint as 16 hex digits, and component_id; rows as in near_duplicates."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
