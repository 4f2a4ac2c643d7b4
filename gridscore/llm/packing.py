"""Packing into length buckets that minimise padding.

The global histogram of lengths, which has at most max_len + 1 rows, is counted with map-side combining; dynamic
programming over it chooses the bucket boundaries with the least padding. Batches under a token budget form inside
each bucket. A bucket is dealt into shards by a hash, as many as its share of the histogram asks for, so no task
holds a whole bucket; a shard fills its batches in order and only its last one may be short. Every piece says which
characters of its document it holds, so a batch can be turned back into text.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.common import stored

#: The length unit of the query: runs of word characters, and single other characters.
PIECE = r"\w+|[^\w\s]"


def piece_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PIECE)).cast("long")


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most `buckets` upper bounds (inclusive, ascending) of least total padding; the last is the greatest length.

    Ties: the lower boundary. Lengths of zero pad like any other.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], np.float64)
    n = np.concatenate([[0.0], np.cumsum(counts)])
    t = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    m, k = len(lengths), min(buckets, len(lengths))
    best = n[1:] * lengths - t[1:]  # one bucket that ends at j
    back = np.zeros((k, m), np.int64)
    for b in range(1, k):
        new = best.copy()
        for j in range(b, m):
            i = np.arange(b - 1, j)  # the bucket before ends at i
            cost = best[i] + (n[j + 1] - n[i + 1]) * lengths[j] - (t[j + 1] - t[i + 1])
            at = int(cost.argmin())
            if cost[at] < new[j]:
                new[j], back[b, j] = cost[at], i[at] + 1
        best = new
    out, j = [], m - 1
    for b in range(k - 1, -1, -1):
        out.append(int(lengths[j]))
        i = int(back[b, j])
        if i == 0 and b:
            continue  # this many buckets gained nothing: one fewer ends here as well
        j = i - 1
        if j < 0:
            break
    return sorted(set(out))


def _cutter(max_len: int, schema: pa.Schema):
    """mapInArrow over (id, chars, units, long): `starts` in place of `long`, where the pieces of a long text begin, in code points; a null text has one piece."""
    unit = re.compile(PIECE, re.ASCII)

    def run(batches):
        for batch in batches:
            starts = []
            for t in batch.column(3):
                more = islice(unit.finditer(t.as_py()), max_len, None, max_len) if t.is_valid else ()
                starts.append([0, *(m.start() for m in more)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(starts, pa.list_(pa.int64()))], schema=schema)

    return run


def split_long(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096) -> DataFrame:
    """(id, piece, start, stop, n_tokens): characters [start, stop) of the text, which hold n_tokens units.

    A text of more than max_len units is cut into pieces of max_len and a rest; what stands between two units belongs to the piece
    before. The pieces of a text, joined, are the text. Null and empty texts are one piece of no characters. Only texts that are cut go to Python.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    sized = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("__chars"), piece_count(F.col(text_col)).alias("__len"), F.col(text_col).alias("__text"))
    long = sized.select("__id", "__chars", "__len", F.when(F.col("__len") > max_len, F.col("__text")).alias("__long"))
    arrow = pa.schema([("__id", to_arrow_type(kind)), ("__chars", pa.int64()), ("__len", pa.int64()), ("__starts", pa.list_(pa.int64()))])
    schema = T.StructType([T.StructField("__id", kind), T.StructField("__chars", T.LongType()), T.StructField("__len", T.LongType()), T.StructField("__starts", T.ArrayType(T.LongType()))])
    rows = long.mapInArrow(_cutter(max_len, arrow), schema).select("__id", "__chars", "__len", "__starts", F.posexplode("__starts").alias("piece", "start"))
    stop = F.coalesce(F.get("__starts", F.col("piece") + 1), F.col("__chars"))
    return rows.select(F.col("__id").alias(id_col), F.col("piece").cast("long").alias("piece"), "start", stop.alias("stop"), F.least(F.lit(max_len), F.col("__len") - F.col("piece") * max_len).cast("long").alias("n_tokens"))


def pack(rows: DataFrame, id_col: str = "doc_id", max_len: int = 4096, buckets: int = 16, budget: int = 65536, shard_rows: int = 20_000) -> DataFrame:
    """rows (id, piece, n_tokens and any others) with bucket_len, batch ("bucket-shard-number") and slot, each row once.

    A batch of bucket b holds up to budget // b rows (at least one), each padded to b. Null or negative lengths count as 0. Equal
    rows go to the same shard and are placed next to each other. Empty tables give empty tables.
    """
    histogram = {int(r.n_tokens): int(r["count"]) for r in rows.groupBy("n_tokens").count().collect()}  # at most max_len + 1 rows
    bounds = optimal_boundaries(histogram, buckets)
    bucket = F.lit(None).cast("long")
    shards, room = F.lit(1), F.lit(1)
    for low, b in reversed(list(zip([-1, *bounds], bounds))):
        count = sum(n for k, n in histogram.items() if low < k <= b)
        inside = F.col("n_tokens") <= b
        bucket = F.when(inside, F.lit(b).cast("long")).otherwise(bucket)
        shards = F.when(inside, F.lit(-(-count // shard_rows))).otherwise(shards)
        room = F.when(inside, F.lit(max(1, budget // max(1, b)))).otherwise(room)
    dealt = rows.withColumn("bucket_len", bucket).withColumn("__room", room).withColumn("__shard", F.pmod(F.xxhash64(id_col, "piece"), shards))
    nth = F.row_number().over(Window.partitionBy("bucket_len", "__shard").orderBy(id_col, "piece")) - 1
    return (
        dealt.withColumn("__nth", nth)
        .withColumn("batch", F.concat_ws("-", "bucket_len", "__shard", F.floor(F.col("__nth") / F.col("__room"))))
        .withColumn("slot", (F.col("__nth") % F.col("__room")).cast("long"))
        .drop("__room", "__shard", "__nth")
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096, **options) -> DataFrame:
    """(id, piece, start, stop, n_tokens, bucket_len, batch, slot) of every document's pieces; the pieces are stored, so that texts are read once.

    Other columns of docs take no part. Texts of any length are packed whole.
    """
    return pack(stored(split_long(docs, id_col, text_col, max_len), "pieces"), id_col, max_len, **options)


def piece_texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """packed with `piece_text`, the characters of each piece. Ids must be unique in docs."""
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    part = F.substring(F.col("__text"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return packed.join(texts.hint("merge"), packed[id_col].eqNullSafe(F.col("__id")), "left").withColumn("piece_text", part).drop("__id", "__text")


def digest(docs: DataFrame) -> DataFrame:
    """The pieces of all documents in their batches; rows as in pack_documents."""
    return pack_documents(docs.select("doc_id", "text"))
