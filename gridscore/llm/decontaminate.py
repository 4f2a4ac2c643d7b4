"""Benchmark decontamination with a distributed positional inverted index.

1. Index. A task lays its documents out in shards, one after the other, and writes every word's postings: the places
   where it stands in the shard. The index is a table (shard, term, places) in the shared folder, beside a row for each document.
2. Search. The benchmark is the stated query set; it is taken in blocks of bounded size. A block's terms pick their
   lists by a join, and the lists of a shard meet in one task. For each window the offset-adjusted lists of its
   rarest terms give the candidate places, and the other terms' places are intersected from the rarest up. All terms in place is
   an exact match, `near_terms` or more a proximity match.

As many of a window's rarest terms give candidates as may be missing, and one more, so no match depends on how
documents fall into shards. Texts are read once; only postings of the benchmark's terms are shuffled.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.common import stored, text_key

#: Byte by byte: A-Z lower-cased; what is not in a word becomes a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Free places before each document of a shard, more than a match may have terms missing: no match reaches over them.
GAP = 64
#: The list under this term holds the places where a shard's documents begin, and the end of the last.
BEGINS = ""


def words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Index(NamedTuple):
    """postings: shard, term, places. documents: shard, nth, n_words, the id, and __t, __u (128 bits of the text's hash)."""

    postings: DataFrame
    documents: DataFrame


def _shard_rows(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, the ends of their lists, the places, and the words by document."""
    split = [words(t or b"") for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    terms = sorted(set().union(*split))
    number = {t: k for k, t in enumerate(terms)}
    ids = np.fromiter((number[w] for ws in split for w in ws), np.uint16 if len(terms) < 1 << 16 else np.int32, int(sizes.sum()))
    begins = np.cumsum(np.concatenate([[0], sizes])) + GAP * np.arange(1, len(texts) + 2)
    order = np.argsort(ids, kind="stable")
    place = order + GAP * (np.searchsorted(np.cumsum(sizes), order, side="right") + 1)
    ends = np.cumsum(np.concatenate([[len(begins)], np.bincount(ids, minlength=len(terms))[: len(terms)]]))
    return [BEGINS.encode(), *terms], ends, np.concatenate([begins, place]).astype(np.int32), sizes


def _indexer(id_type: pa.DataType, shard_bytes: int):
    doc = pa.struct([("nth", pa.int32()), ("n_words", pa.int64()), ("id", id_type), ("__t", pa.int64()), ("__u", pa.int64())])
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("doc", doc)])

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), shard_bytes, side="right")))
                part = batch.slice(lo, hi - lo)
                terms, ends, places, n_words = _shard_rows(part.column(3).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(places))
                n, m = len(terms), part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(terms, pa.string()), lists, pa.nulls(n, doc)], schema=schema)
                own = pa.StructArray.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array(n_words), part.column(0), part.column(1), part.column(2)], fields=list(doc))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard)), pa.nulls(m, pa.string()), pa.nulls(m, lists.type), own], schema=schema)
                shard, lo = shard + 1, hi

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 2_000_000) -> Index:
    """The stored index of all words of all texts. A shard holds documents of up to shard_bytes in sum; a longer text has one of its own.

    Null texts have no words. Rows with equal or null ids are documents of their own. An empty table gives an empty index.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), F.col(text_col).cast("binary").alias("text"))
    doc = T.StructType([T.StructField("nth", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("id", kind), T.StructField("__t", T.LongType()), T.StructField("__u", T.LongType())])
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("doc", doc)])
    table = stored(rows.mapInArrow(_indexer(to_arrow_type(kind), shard_bytes), schema), "postings")
    return Index(table.where("term IS NOT NULL").select("shard", "term", "places"), table.where("doc IS NOT NULL").select("shard", "doc.*"))


class Windows:
    """The windows of a block of benchmark items, as numbers of terms, by length."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.vocab: dict[bytes, int] = {}
        self.size = size
        by_length: dict[int, list] = {}
        self.items = []
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            if not ids:
                continue
            n = min(size, len(ids))
            by_length.setdefault(n, []).extend((len(self.items), ids[i : i + n]) for i in range(len(ids) - n + 1))
            self.items.append(name)
        self.groups = [(np.array([k for k, _ in rows], np.int32), np.array([ids for _, ids in rows], np.int32)) for _, rows in sorted(by_length.items())]

    def matches(self, stream: np.ndarray, near_terms: int, at_once: int = 1 << 18):
        """Yields (item, start, length, terms in place) arrays, each window and place once. stream: the term's number at each place, -1 for others.

        A place with enough terms has one of the window's `missing_most + 1` rarest in place, so these give the candidates; each
        yields the places where no rarer one stands.
        """
        there_at = np.flatnonzero(stream >= 0)
        places = there_at[np.argsort(stream[there_at], kind="stable")]
        counts = np.bincount(stream[places], minlength=max(1, len(self.vocab)))
        first = np.concatenate([[0], np.cumsum(counts)])
        padded = np.concatenate([stream, np.full(self.size, -1, np.int32)])
        for item, terms in self.groups:
            size, rows = terms.shape[1], np.arange(len(terms))
            missing_most = size - max(1, min(near_terms, size))
            there = counts[terms]
            order = np.argsort(there, axis=1, kind="stable")  # one order for the candidates and the rest, so that no term is left out
            for rank in range(missing_most + 1):
                column = order[:, rank]
                anchor = terms[rows, column]
                times = counts[anchor]
                live = np.flatnonzero(times)
                if not len(live):
                    continue
                edges = np.cumsum(times[live])
                for lo in range(0, int(edges[-1]), at_once):  # blocks of (window, posting), so that memory is bounded
                    k = np.arange(lo, min(lo + at_once, int(edges[-1])))
                    row = np.searchsorted(edges, k, side="right")
                    w = live[row]
                    start = places[first[anchor[w]] + k - (edges[row] - times[w])] - column[w]  # the list, adjusted by the term's offset
                    for j in range(rank):
                        col = order[w, j]
                        new = padded[start + col] != terms[w, col]
                        w, start = w[new], start[new]
                    missing = np.full(len(w), rank, np.int16)
                    for j in range(rank + 1, size):
                        col = order[w, j]
                        missing += padded[start + col] != terms[w, col]
                        alive = missing <= missing_most
                        w, start, missing = w[alive], start[alive], missing[alive]
                    yield item[w], start, size, size - missing


EXACT = "array<struct<item:string,start:bigint,stop:bigint>>"
NEAR = "array<struct<item:string,start:bigint,stop:bigint,in_place:int>>"
FOUND = f"shard long, nth int, exact {EXACT}, near {NEAR}"


def _joined_runs(doc: np.ndarray, item: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Windows of one item that follow each other in a document, word by word, as one run: doc, item, start, stop."""
    order = np.lexsort((start, item, doc))
    doc, item, start, size = doc[order], item[order], start[order], size[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc))[: len(head)] - 1
    return [doc[head], item[head], start[head], start[tail] + size[tail]]


def _lists(doc: np.ndarray, docs: np.ndarray, columns: list[tuple[str, pa.Array]]) -> pa.Array:
    """One list of structs for each of docs, from rows sorted by doc."""
    ends = np.searchsorted(doc, docs, side="right")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays([c for _, c in columns], [n for n, _ in columns]))


def _resolver(held, near_terms: int):
    """mapInArrow over (shard, term, places) sorted by shard: the matches of each document that has any."""
    span = [("item", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]
    schema = pa.schema([("shard", pa.int64()), ("nth", pa.int32()), ("exact", pa.list_(pa.struct(span))), ("near", pa.list_(pa.struct([*span, ("in_place", pa.int32())])))])

    def search(shard: int, parts: list[tuple[list[str], pa.Array]], windows: Windows):
        begins, lists = np.zeros(0, np.int64), []
        for terms, places in parts:
            offsets, flat = places.offsets.to_numpy(), places.flatten().to_numpy()
            offsets = offsets - offsets[0]
            for k, t in enumerate(terms):
                own = flat[offsets[k] : offsets[k + 1]]
                if t == BEGINS:
                    begins = own.astype(np.int64)
                elif (number := windows.vocab.get(t.encode())) is not None:
                    lists.append((number, own))
        if not lists:
            return None
        stream = np.full(int(begins[-1]), -1, np.int32)
        for number, own in lists:
            stream[own] = number
        rows = [(i, s, np.full(len(i), n), p) for i, s, n, p in windows.matches(stream, near_terms) if len(i)]
        if not rows:
            return None
        item, start, size, in_place = (np.concatenate(c) for c in zip(*rows))
        doc = np.searchsorted(begins[:-1] - GAP, start, side="right") - 1  # a match with first words missing starts before its document
        start = start - begins[doc]
        whole = in_place == size
        names = np.array(windows.items, object)
        d, i, a, z = _joined_runs(doc[whole], item[whole], start[whole], size[whole])
        part = ~whole
        order = np.lexsort((start[part], item[part], doc[part]))
        nd, ni, na, nn, np_ = (c[part][order] for c in (doc, item, start, size, in_place))
        docs = np.unique(doc)
        exact = _lists(d, docs, [("item", pa.array(names[i], pa.string())), ("start", pa.array(a, pa.int64())), ("stop", pa.array(z, pa.int64()))])
        near = _lists(nd, docs, [("item", pa.array(names[ni], pa.string())), ("start", pa.array(na, pa.int64())), ("stop", pa.array(na + nn, pa.int64())), ("in_place", pa.array(np_, pa.int32()))])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), shard)), pa.array(docs, pa.int32()), exact, near], schema=schema)

    def run(batches):
        shard, parts = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges, edges[1:]):
                if shard is not None and shards[lo] != shard:
                    if (found := search(shard, parts, held.value)) is not None:
                        yield found
                    parts = []
                shard = int(shards[lo])
                own = batch.slice(lo, hi - lo)
                parts.append((own.column(1).to_pylist(), own.column(2)))
        if shard is not None and (found := search(shard, parts, held.value)) is not None:
            yield found

    return run


def search(index: Index, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", size: int = 13, near_terms: int = 10, block_chars: int = 2_000_000) -> DataFrame:
    """(shard, nth, exact, near) of the documents that have a match: exact runs (item, start, stop) and proximity matches
    (item, start, stop, in_place), in words of the document, [start, stop).

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window. An exact run is one or more
    windows of an item that stand in the document whole, each a word behind the last. A proximity match is a window and a place with `near_terms` or more,
    but not all, words in place; it may begin before the document's first word or end after its last. Item ids are strings;
    items without id or words match nothing; repeated items count once. What a block sends to the driver and to the
    executors is bounded by block_chars (or by one item, if that is longer); blocks are done one after the other.
    """
    if size - max(1, near_terms) >= GAP:
        raise ValueError(f"fewer than {GAP} terms of a window may be missing")
    spark = index.postings.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = benchmark.select(F.col(item_col).cast("string").alias("k"), F.col(item_text_col).cast("binary").alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    found = None
    for b in range(blocks):
        block = sorted((r.k, bytes(r.t)) for r in items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect())
        windows = Windows(block, size)
        held = spark.sparkContext.broadcast(windows)
        terms = spark.createDataFrame([(w.decode(),) for w in [BEGINS.encode(), *windows.vocab]], "term string")
        lists = index.postings.join(F.broadcast(terms), "term").select("shard", "term", "places")
        part = stored(lists.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_resolver(held, near_terms), FOUND), "matches")
        held.unpersist()
        found = part if found is None else found.union(part)
    if blocks == 1:
        return found
    return found.groupBy("shard", "nth").agg(F.flatten(F.collect_list("exact")).alias("exact"), F.flatten(F.collect_list("near")).alias("near"))


def document_matches(index: Index, benchmark: DataFrame, **options) -> DataFrame:
    """index.documents with a row each: n_words, spans ([start, stop) of exact runs, sorted), items (ids with exact windows, sorted), near, n_near."""
    found = search(index, benchmark, **options)
    rows = index.documents.join(found.hint("merge"), ["shard", "nth"], "left").drop("shard", "nth")
    exact, near = F.coalesce("exact", F.array().cast(EXACT)), F.coalesce("near", F.array().cast(NEAR))
    spans = F.array_sort(F.transform(exact, lambda x: F.array(x["start"], x["stop"])))
    items = F.array_sort(F.array_distinct(F.transform(exact, lambda x: x["item"])))
    return rows.withColumn("spans", spans).withColumn("items", items).withColumn("near", near).withColumn("n_near", F.size("near").cast("long")).drop("exact")


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "matches", **options) -> DataFrame:
    """docs with a struct `out`: n_words, spans, items, near, n_near (see document_matches). Every row and column of docs stays; a column that is named as `out` is replaced.

    Rows that share id and text share their matches. Null texts have no words. An empty table gives an empty table, an empty
    benchmark empty lists.
    """
    found = document_matches(build_index(docs, id_col, text_col), benchmark, **options).dropDuplicates(["id", "__t", "__u"])
    t, u = text_key(F.col(text_col))
    keyed = docs.drop(out).withColumns({"__own_t": t, "__own_u": u})
    result = F.struct("n_words", "spans", "items", "near", "n_near").alias("__result")
    found = found.select(F.col("id").alias("__id"), "__t", "__u", result)
    same = (keyed[id_col].eqNullSafe(F.col("__id"))) & (F.col("__own_t") == F.col("__t")) & (F.col("__own_u") == F.col("__u"))
    return keyed.join(found.hint("merge"), same, "left").withColumnRenamed("__result", out).drop("__id", "__t", "__u", "__own_t", "__own_u")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000, **options) -> DataFrame:
    """docs without the rows that are contaminated (see is_contaminated); columns stay as they are.

    Up to broadcast_rows contaminated texts are broadcast, so that no text is shuffled; more are joined by a shuffle.
    """
    found = document_matches(build_index(docs, id_col, text_col), benchmark, **options)
    bad = stored(found.where(is_contaminated(found)).select(F.col("id").alias("__id"), "__t", "__u").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad.hint("merge")
    t, u = text_key(F.col(text_col))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (t == F.col("__t")) & (u == F.col("__u"))
    return docs.join(bad, same, "left_anti")


def n_hit(spans: Column) -> Column:
    """Words in the union of sorted ranges."""
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], a["end"]))).alias("n"), F.greatest(a["end"], s[1]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda a: a["n"])


def is_contaminated(matches: Column | DataFrame) -> Column:
    """Some word is hit, and at least one in twenty."""
    hit = n_hit(matches["spans"])
    return (hit > 0) & (20 * hit >= matches["n_words"])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: the words, those hit by exact windows, the items, the verdict, and the number of proximity matches.

    Null texts have no words and are not contaminated; texts of any length are read whole; equal rows give equal rows.
    """
    found = document_matches(build_index(docs), benchmark)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(found).alias("contaminated"),
        "n_near",
    )
