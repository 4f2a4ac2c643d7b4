"""JSON arrays of any size, read by several tasks.

A file is read in pieces that end with a closing brace, which Spark finds within its own splits of the file; pieces of a split that follow each other
are a chunk. What a piece does to the state of a reader, inside a string or not and how deep in brackets, is known for either start from the piece
alone, and what a chunk does for either start from running sums inside it. Sums over the chunks, a row each, give each chunk its start.
An element ends where the depth is back at the array's. It is put together inside its chunk, and across chunks where it is in several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscore.sources.shared import new_path, store
from gridscore.sources.sizes import few

#: A chunk: pieces of a split, 2^17 at most.
CHUNK = ["path", "block", "chunk"]
CHUNK_BITS = 17
#: What may stand before an element: the array's start, commas, and elements that hold no object.
BEFORE_OBJECT = r'(?s)^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'


def _depth(text: Column) -> Column:
    """Brackets that a text opens less those it closes, strings left out; it starts outside of a string and may end in one."""
    outside = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '"[^"]*$', "")
    return F.length(F.translate(outside, "]}", "")) - F.length(F.translate(outside, "[{", ""))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, value): each object of the arrays in the files at path, as its text, with its place in the array from 0.

    Only objects are elements; numbers, strings and arrays of such between them are passed over, arrays of objects mustn't be there. Blank files and empty arrays have no rows. Files that are
    compressed as a whole are read by one task each.
    """
    pieces = spark.read.text(path, lineSep="}")
    at = F.monotonically_increasing_id()
    own = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    own = own.withColumn("bare", F.when(F.contains("value", F.lit("\\")), bare).otherwise(F.col("value")))
    quotes = F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))
    own = own.withColumn("quotes", quotes).withColumn("if_out", _depth(F.col("bare")))
    own = own.withColumn("if_in", F.when(F.col("quotes") == 0, 0).otherwise(_depth(F.regexp_replace("bare", '^[^"]*"', "")))).drop("bare")
    own = own.withColumn("chunk", F.shiftright("at", CHUNK_BITS))

    earlier = Window.partitionBy(*CHUNK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    own = own.withColumn("q", before("quotes"))
    for start in (0, 1):  # outside of a string, or inside
        starts_in, ends_out = (F.col("q") + start) % 2 == 1, (F.col("q") + F.col("quotes") + start) % 2 == 0
        deeper = F.when(starts_in, F.col("if_in")).otherwise(F.col("if_out")) - F.when(ends_out, 1).otherwise(0)  # the brace that ends the piece
        own = own.withColumn(f"out{start}", ends_out).withColumn(f"deeper{start}", deeper)
    own = own.withColumns({f"depth{start}": before(f"deeper{start}") + F.col(f"deeper{start}") for start in (0, 1)})
    own = store(own.drop("q", "if_out", "if_in"), new_path(spark, "pieces"))

    chunks = own.groupBy(*CHUNK).agg(*[F.sum(c).alias(c) for c in ("quotes", "deeper0", "deeper1")])
    so_far = Window.partitionBy("path").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("inside", F.coalesce(F.sum("quotes").over(so_far), F.lit(0)) % 2 == 1)
    starts = chunks.withColumn("start", F.coalesce(F.sum(F.when(F.col("inside"), F.col("deeper1")).otherwise(F.col("deeper0"))).over(so_far), F.lit(0)))
    met = own.join(few(starts.select(*CHUNK, "inside", "start")), CHUNK)
    now = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    met = met.select(*CHUNK, "at", "value", (now("out") & (F.col("start") + now("depth") == 1)).alias("ends"))

    met = met.withColumn("nth", before(F.col("ends").cast("int")))
    text = F.array_sort(F.collect_list(F.struct("at", "value")))
    parts = met.groupBy(*CHUNK, "nth").agg(F.concat(F.array_join(text["value"], "}"), F.lit("}")).alias("value"), F.bool_or("ends").alias("ends"))
    parts = store(parts, new_path(spark, "elements"))
    counted = parts.groupBy(*CHUNK).agg(F.count_if("ends").alias("n"))
    first = few(counted.select(*CHUNK, F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("first")))
    parts = parts.join(first, CHUNK).withColumn("pos", F.col("first") + F.col("nth"))
    inner = F.col("ends") & (F.col("nth") > 0)  # begins and ends in its chunk
    rest = parts.where(~inner).groupBy("path", "pos").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "chunk", "value")))["value"], "").alias("value"), F.bool_or("ends").alias("ends"))
    elements = parts.where(inner).select("path", "pos", "value").union(rest.where("ends").select("path", "pos", "value"))
    return elements.select("path", "pos", F.regexp_replace("value", BEFORE_OBJECT, "").alias("value"))
