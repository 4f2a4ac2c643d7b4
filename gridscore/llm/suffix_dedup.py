"""Removal of byte strings that occur twice or more in a corpus, with suffix arrays by linear grouping.

1. Each document is winnowed: every window of `length` bytes picks the least of its 64-byte grams (the last one of equals), by contents
   alone, so equal windows anywhere pick equal grams. The windows that pick one gram make a context.
2. Contexts meet by gram. A gram that occurs once is done; contexts that are equal as a whole are repeats as a whole; only
   the distinct contexts of a shared gram travel on with their bytes.
3. In blocks of such contexts, each context is read as 64-byte symbols aligned on its gram. A suffix array of the
   block is built by linear grouping (`suffix_array`). Suffixes that share their first symbols stand together in it;
   the windows that begin in front of them are compared exactly inside each such run.
4. Covered bytes are cut from the documents.

Bytes are shuffled twice at most: documents by their id, and distinct contexts by gram.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.common import stored

GRAM = 64
_TABLE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)
_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes in order; s ends with its only 0.

    First phase: suffixes are grouped by symbol, and groups are taken from the greatest down. Each suffix of a group
    points to the previous suffix of a smaller group; suffixes that are pointed to move to new groups behind their own, the more often
    pointed to the greater, which leaves groups of equal longest Lyndon prefixes. Second phase: from the sentinel on, each placed suffix
    places the suffixes whose Lyndon prefix ends where it starts, at the front of their groups.
    """
    n = len(s)
    sa = np.argsort(np.array(s), kind="stable").tolist()
    at, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(sa):
        if k and s[i] != s[sa[k - 1]]:
            start = k
        at[i], group[i] = k, start
        size[start] += 1
    before = [-1] * n
    end = n - 1
    while end >= 0:
        g = group[sa[end]]
        tally: dict[int, int] = {}
        for i in sorted(sa[g : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                tally[p] = tally.get(p, 0) + 1
        if tally:
            for _, same in groupby(sorted(tally, key=tally.__getitem__, reverse=True), key=tally.__getitem__):
                moved: dict[int, list[int]] = {}
                for p in same:
                    old = group[p]
                    last = old + size[old] - 1
                    size[old] -= 1
                    q, k = sa[last], at[p]
                    sa[last], sa[k], at[p], at[q] = p, q, last, k
                    moved.setdefault(old, []).append(p)
                for old, ps in moved.items():
                    new = old + size[old]
                    for p in ps:
                        group[p] = new
                    size[new] = len(ps)
        end = g - 1
    front = list(range(n))
    placed = [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    front[group[n - 1]] += 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            placed[i] = True
            i = before[i]
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def contexts(b: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(gram hash, first window, windows, gram's offset in the context) in order; the windows of all contexts are those of b."""
    out, size = [], 1 << 20
    for lo in range(0, max(0, len(b) - length + 1), size):
        part = np.frombuffer(b, np.uint8)[lo : lo + size + length - 1]
        h, n = _TABLE[part], 1
        while n < GRAM:
            h = h[:-n] * np.uint64((_M + 2 * n) & 0xFFFFFFFFFFFFFFFF) + h[n:]
            h ^= h >> np.uint64(29)
            n *= 2
        key = h & ~_MASK | (_MASK - np.arange(len(h), dtype=np.uint64))
        picked = (_MASK - (_sliding(key, length - GRAM + 1, np.minimum) & _MASK)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
        gram = h[picked[first]].view(np.int64)
        out += zip(gram.tolist(), (first + lo).tolist(), np.diff(np.concatenate([first, [len(picked)]])).tolist(), (picked[first] - first).tolist())
    return out


def _anchors(length: int):
    schema = pa.schema([("doc", pa.binary()), ("gram", pa.int64()), ("whole", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()), ("offset", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None and len(text) >= length:
                    view = memoryview(text)
                    rows += [(doc, g, xxhash.xxh3_64_intdigest(view[f : f + n + length - 1], o) - (1 << 63), f, n, o) for g, f, n, o in contexts(text, length)]
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 50_000]), schema.types)], schema=schema)

    return run


def repeated_windows(texts: list[bytes], offsets: list[int], groups: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its windows also occur in another context of its group (equal windows pick equal grams, so one context never holds two).

    Windows are told apart by the first whole symbol in them, which stands in the suffix array with `least` more; runs of
    suffixes that agree on so many symbols are the only places where windows can be equal.
    """
    least = (length - GRAM + 1) // GRAM
    shift = [o % GRAM for o in offsets]
    counts = [(len(t) - s) // GRAM for t, s in zip(texts, shift)]
    words = np.frombuffer(b"".join(t[s : s + n * GRAM] for t, s, n in zip(texts, shift, counts)), np.uint64).reshape(-1, GRAM // 8)
    h = np.repeat(np.array(groups, np.int64).view(np.uint64), counts)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(_M)
        h ^= h >> np.uint64(31)
    rank = np.unique(h, return_inverse=True)[1] + 2
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = np.arange(len(owner)) + owner  # a separator, symbol 1, after each context
    s = np.ones(len(owner) + len(texts) + 1, np.int64)
    s[where] = rank
    s[-1] = 0
    sa = np.array(suffix_array(s.tolist()))
    back = np.full(len(s), -1, np.int64)
    back[where] = np.arange(len(owner))
    long = np.concatenate([s, np.zeros(least, np.int64)])
    same = np.ones(len(sa) - 1, bool)
    for j in range(least):
        same &= (long[sa[1:] + j] == long[sa[:-1] + j]) & (long[sa[1:] + j] > 1)
    run = np.concatenate([[0], np.cumsum(~same)])
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    run, block = run[keep], back[sa[keep]]
    out = [np.zeros(max(0, len(t) - length + 1), bool) for t in texts]
    if not len(block):
        return out
    who, symbol = owner[block], nth[block]
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    power = np.full(len(flat) + 1, _M, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[flat] * power[:-1])])
    inverse = np.full(len(flat) + 1, _M_INV, np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    begin = np.array(shift)[who] + symbol * GRAM
    step = max(1, 2_000_000 // GRAM)
    edges = [0]
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])).tolist() + [len(run)]
    for a in starts[1:]:
        if a - edges[-1] >= step or a == len(run):
            edges.append(a)
    for lo, hi in zip(edges, edges[1:]):  # whole runs
        w = begin[lo:hi, None] - np.arange(GRAM)[None, :]
        ok = (w >= 0) & (w + length <= sizes[who[lo:hi], None])
        i, r = np.nonzero(ok)
        at = base[who[lo:hi][i]] + w[i, r]
        digest = (total[at + length] - total[at]) * inverse[at]
        order = np.lexsort((digest, r, run[lo:hi][i]))
        a, b, c = digest[order], r[order], run[lo:hi][i][order]
        eq = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
        hit = order[np.concatenate([eq, [False]]) | np.concatenate([[False], eq])]
        for o, x in zip(who[lo:hi][i[hit]].tolist(), w[i[hit], r[hit]].tolist()):
            out[o][x] = True
    return out


SPANS = "doc binary, start long, stop long"
_SPANS = pa.schema([("doc", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _resolve(length: int, at_once: int = 4000):
    """mapInArrow over (gram, doc, first, offset, bytes, known) sorted by gram: spans that repeats cover, by blocks of whole grams."""

    def work(rows):
        found = repeated_windows([r[4] for r in rows], [r[3] for r in rows], [r[0] for r in rows], length)
        spans = [(r[1], r[2] + a, r[2] + b + length - 1) for r, f in zip(rows, found) if not r[5] for a, b in _runs(f)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans) if spans else ([], [], []), _SPANS.types)], schema=_SPANS)

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(held) >= at_once and row[0] != held[-1][0]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return run


def _cut(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows(length: int):
    """mapInArrow over the same rows as _resolve: a row for each window, (gram, digest, doc, at); doc is null where the context is known."""
    schema = pa.schema([("gram", pa.int64()), ("digest", pa.int64()), ("doc", pa.binary()), ("at", pa.int64())])

    def run(batches):
        for batch in batches:
            for gram, doc, first, offset, text, known in zip(*[c.to_pylist() for c in batch.columns]):
                n = len(text) - length + 1
                digests = [xxhash.xxh3_64_intdigest(text[k : k + length], offset - k) - (1 << 63) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([gram] * n, pa.int64()), pa.array(digests, pa.int64()), pa.array([None if known else doc] * n, pa.binary()), pa.array(range(first, first + n), pa.int64())], schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int = 400, max_group: int = 20_000) -> DataFrame:
    """docs: (doc binary, text binary), doc unique. (doc, start, stop) ranges whose union is what repeats cover.

    Distinct contexts of one gram are held by one task, up to max_group of them; the windows of more than that are counted by digest
    instead, with map-side combining, and joined back, which splits a hot gram over all tasks.
    """
    session = docs.sparkSession
    n = int(session.conf.get("spark.sql.shuffle.partitions"))
    anchors = stored(docs.mapInArrow(_anchors(length), "doc binary, gram long, whole long, first long, windows int, offset int"), "anchors")
    me = F.xxhash64("doc", "first")
    kinds = anchors.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(me).alias("one"))
    grams = kinds.groupBy("gram").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where(F.col("all") > 1)
    known = stored(kinds.join(grams.hint("merge"), "gram").select("gram", "whole", "n", "kinds", "one"), "kinds")
    met = anchors.join(known.hint("merge"), ["gram", "whole"])
    whole = met.where("n > 1").select("doc", F.col("first").alias("start"), (F.col("first") + F.col("windows") + length - 1).alias("stop"))
    needed = met.where((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("one") == me)))
    needed = needed.groupBy("doc").agg(F.collect_list(F.struct("gram", "first", "windows", "offset", (F.col("n") > 1).alias("known"), (F.col("kinds") > max_group).alias("hot"))).alias("needed"))
    cut = docs.join(needed.hint("merge"), "doc").select("doc", "text", F.explode("needed").alias("c"))
    bytes_of = F.substring(F.col("text"), (F.col("c.first") + 1).cast("int"), F.col("c.windows") + (length - 1))
    rows = cut.select("c.gram", "doc", "c.first", "c.offset", bytes_of.alias("bytes"), "c.known", "c.hot")
    resolved = rows.where("NOT hot").drop("hot").repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_resolve(length), SPANS)
    if known.where(F.col("kinds") > max_group).isEmpty():
        return whole.union(resolved)
    windows = rows.where("hot").drop("hot").mapInArrow(_windows(length), "gram long, digest long, doc binary, at long")
    twice = windows.groupBy("gram", "digest").count().where("count > 1").select("gram", "digest")
    counted = windows.where("doc IS NOT NULL").join(twice.hint("merge"), ["gram", "digest"]).select("doc", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))
    return whole.union(resolved).union(counted)


RESULT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])


def _keep(with_text: bool):
    @F.arrow_udf(RESULT)
    def keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist()):
            cut = _cut([(x["start"], x["stop"]) for x in s or ()])
            ends = [0, *[x for ab in cut for x in ab], len(t)]
            kept = b"".join(t[a:b] for a, b in zip(ends[::2], ends[1::2]))
            out.append((sum(b - a for a, b in cut), len(cut), kept if with_text else None, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["n_removed", "n_spans", "kept", "kept_sha256"])

    return keep


def _names(rows: DataFrame, nth: Column, mark: Column) -> DataFrame:
    """(doc, text): names that hold the number among copies, a mark of the text, and the id, in bytes."""
    kind = F.when(F.col("__id").isNull(), "n").otherwise("i")
    name = F.concat(kind, F.lit("|"), nth, F.lit("|"), mark, F.lit("|"), F.coalesce(F.col("__id").cast("string"), F.lit("")))
    return rows.select(name.cast("binary").alias("doc"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = True, max_group: int = 20_000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256), one row per row of docs; the id column keeps its name.

    Null texts are empty. Rows with equal ids and equal texts are copies of each other, like any two rows: each row is a text of its own,
    numbered within its id and text. Texts shorter than `length` lose nothing; texts of any length are read whole. Other columns of docs take no part. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if rows.groupBy("__id").count().where("count > 1").isEmpty():
        own = _names(rows, F.lit("1"), F.lit(""))
    else:  # ids that repeat: copies are numbered once, and the numbers stored
        nth = F.row_number().over(Window.partitionBy("__id", F.md5("text")).orderBy("text"))
        own = stored(_names(rows.withColumn("__n", nth), F.col("__n").cast("string"), F.md5("text")), "rows")
    found = repeated_spans(own, length, max_group).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = own.join(found.hint("merge"), "doc", "left").withColumn("__r", _keep(with_text)(F.col("text"), F.col("spans")))
    name = F.col("doc").cast("string")
    own_id = F.when(name.startswith("i"), F.regexp_extract(name, r"(?s)^[^|]*\|[^|]*\|[^|]*\|(.*)$", 1)).cast(docs.schema[id_col].dataType)
    return joined.select(own_id.alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), "__r.n_removed", "__r.n_spans", "__r.kept", "__r.kept_sha256")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, a row per row of docs; rows as in remove_repeats."""
    return remove_repeats(docs.select("doc_id", "text"), with_text=False).drop("kept")
