"""Line deduplication over a corpus, native.

Texts are split once: hashes of lines are written as skinny rows (hash, document, position) and read from there. They are
range-partitioned on (hash, document) and sorted within a partition by document and position, so a line that a third of
all documents hold is dealt over neighbouring partitions. A stream over each partition marks the first occurrence in
each document; one summary row per line and partition is merged into the line's document count and last document.
Lines of enough documents meet the rows again: those with more rows than a quarter of a partition, of which there are at most four
a partition, by a broadcast, the others by a sort-merge join. What comes out is one compressed bitmap of kept lines for each document
that loses any. Texts take no part in any of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.llm.common import line_key, stored, text_hash

#: Lines of one bitmap: what bitmap_construct_agg holds.
BITMAP_LINES = 32768
#: A line with more rows than this part of an even partition is joined by a broadcast, and so is one with more than a thousandth of all rows; at most
#: four such lines a partition, or a thousand, are possible.
HEAVY = 0.25
HEX, INVERTED = "0123456789ABCDEF", "FEDCBA9876543210"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(__id, __t, __keep): for a row, known by its id and the hash of its text, a map from bucket of 32,768 lines to a hex bitmap of the lines to keep.
    Ones at a bitmap's end are left out, and so is a bucket of ones.

    A key (see line_key) of at least min_chars code points in at least min_docs documents loses its lines in
    all documents but the largest id. Rows that lose nothing have no row. Rows with the same id are one document, which counts
    once; where their texts differ each loses its own lines. Rows whose id is null neither count nor lose lines. An empty table gives an empty table.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = (
        docs.select(F.col(id_col).alias("__id"), text_hash(F.col(text_col)), F.posexplode(lines_of(F.col(text_col))).alias("__pos", "__line"))
        .where(F.col("__id").isNotNull() & (F.char_length("__line") >= min_chars))
        .withColumn("__key", line_key(F.col("__line")))
        .where(F.char_length("__key") >= min_chars)
        .select("__id", "__t", "__pos", F.xxhash64("__key").alias("__h"), F.hash("__key").alias("__h2"))
    )
    lines = stored(lines, "lines")
    in_doc = Window.partitionBy("__h", "__h2", "__id").orderBy("__pos")
    frequent = (
        lines.drop("__t").repartitionByRange(n, "__h", "__h2", "__id")
        .withColumn("__nth", F.row_number().over(in_doc))
        .groupBy("__h", "__h2")
        .agg(F.count_if(F.col("__nth") == 1).alias("__docs"), F.max("__id").alias("__last"), F.count("*").alias("__rows"))
        .where(F.col("__docs") >= min_docs)
        .select("__h", "__h2", "__last", "__rows")
    )
    frequent = stored(frequent, "frequent")
    heavy = F.col("__rows") > min(0.001, HEAVY / n) * lines.count()
    few = frequent.where(heavy).select("__h", "__h2", F.col("__last").alias("__heavy"))
    met = lines.join(F.broadcast(few), ["__h", "__h2"], "left")
    rest = met.where("__heavy IS NULL").drop("__heavy").join(frequent.where(~heavy).select("__h", "__h2", "__last").hint("merge"), ["__h", "__h2"])
    own = ["__id", "__t", "__pos"]
    dropped = met.where("__id < __heavy").select(*own).union(rest.where("__id < __last").select(*own))
    bits = F.translate(F.rtrim(F.hex("__bits"), F.lit("0")), HEX, INVERTED)  # zeros at the end would be ones that are left out
    return (
        dropped.select("__id", "__t", (F.col("__pos") + 1).cast("long").alias("__n"))
        .groupBy("__id", "__t", F.bitmap_bucket_number("__n").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__n")).alias("__bits"))
        .groupBy("__id", "__t")
        .agg(F.map_from_entries(F.collect_list(F.struct("__bucket", bits.alias("b")))).alias("__keep"))
    )


def is_kept(keep: Column, line: Column) -> Column:
    """Whether bit `line` (from 0) is set; absent buckets and bits beyond a bitmap's end are."""
    byte = F.substring(F.coalesce(F.element_at(keep, (F.floor(line / BITMAP_LINES) + 1).cast("long")), F.lit("")), ((F.floor(line / 8) % (BITMAP_LINES // 8)) * 2 + 1).cast("int"), F.lit(2))
    value = F.conv(F.rpad(byte, 2, "F"), 16, 10).cast("int")
    return (F.call_function("getbit", value, (line % 8).cast("int"))) == 1


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, out: str = "lines") -> DataFrame:
    """docs with a struct `out`: n_lines (of the text) and kept (an array of those that stay). Every row and column of docs
    stays; a column that is named as `out` is replaced, names that begin with two underscores are the operator's own.

    Null or empty text: one empty line, which stays. Lines and texts may be of any length; a document holds its lines in one row.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.drop(out)
    maps = maps.withColumnsRenamed({"__id": "__did", "__t": "__dt"}).hint("merge")
    joined = rows.join(maps, (rows[id_col] == F.col("__did")) & (text_hash(F.col(text_col)) == F.col("__dt")), "left").drop("__did", "__dt")
    split = joined.withColumn("__lines", lines_of(F.col(text_col)))
    kept = F.when(F.col("__keep").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda _, i: is_kept(F.col("__keep"), i)))
    return split.withColumn(out, F.struct(F.size("__lines").cast("long").alias("n_lines"), kept.alias("kept"))).drop("__lines", "__keep")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hex digest of what stays; rows as in dedup_lines."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        "lines.n_lines",
        (F.col("lines.n_lines") - F.size("lines.kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("lines.kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id < f.last) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
