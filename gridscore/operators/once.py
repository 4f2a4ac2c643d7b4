"""Work on texts that is done once: results in a table keyed by the text's digest and the version of the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.operators.convert import convert_responses
from gridscore.operators.shred import shred_tables
from gridscore.sources.shared import or_empty

#: The version of conversion and shredding. Whoever changes what they give raises it; results of other versions are left alone.
RULES = "3"
KEY = "text_digest"
CONVERTED = ("html", "conversion_ok", "conversion_tag", "removed_rows")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; null is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def keep(df: DataFrame, column: str, path: str, make: Callable[[DataFrame], DataFrame], version: str = RULES) -> Callable[[], DataFrame]:
    """Sees to it that the table at path has what make gives for every text of df's column; returns a reader of the table, by text_digest.

    Texts that the table lacks in this version are made distinct, made, and appended by one commit; where none is lacking nothing is
    made and no text moves, only digests do. make adds columns to (text_digest, text), sees each text once, null as empty, and must depend on nothing
    else. One job writes a table at a time; readers are free. df is read up to twice, so it should be cheap to read.
    """
    spark = df.sparkSession
    at = f"{path}/version={version}"
    texts = df.select(text_digest(F.col(column)).alias(KEY), F.coalesce(column, F.lit("")).alias("text"))
    made = make(texts.limit(0))
    schema = made.drop("text").schema
    known = lambda: or_empty(lambda: spark.read.schema(schema).parquet(at), spark, schema)
    lacking = texts.select(KEY).distinct().join(known().select(KEY).hint("merge"), KEY, "left_anti")
    if not lacking.isEmpty():
        fresh = texts.join(known().select(KEY).hint("merge"), KEY, "left_anti").groupBy(KEY).agg(F.first("text").alias("text"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work in each row: not left to coalescing
        make(fresh.repartition(n, KEY)).drop("text").write.mode("append").parquet(at)
    return known


def once(df: DataFrame, column: str, path: str, make: Callable[[DataFrame], DataFrame], version: str = RULES) -> DataFrame:
    """df with the columns that make adds to (text_digest, text), looked up in the table at path by df's column (see keep).

    A text that many rows share is one row of the table: rows meet it by digest, and AQE splits what is skewed.
    """
    known = keep(df, column, path, make, version)
    return df.withColumn(KEY, text_digest(F.col(column))).join(known().hint("merge"), KEY).drop(KEY)


def shredded_tables(df: DataFrame, column: str, path: str, version: str = RULES) -> Callable[[], DataFrame]:
    """A reader of (text_digest, shredded) that has every text of df's column."""
    return keep(df, column, f"{path}/shredded", lambda t: shred_tables(t, "text", "shredded"), version)


def shredded_once(df: DataFrame, column: str, out: str, path: str, version: str = RULES) -> DataFrame:
    """shred_tables by way of a table."""
    return once(df, column, f"{path}/shredded", lambda t: shred_tables(t, "text", "shredded"), version).withColumnRenamed("shredded", out)


def converted_once(df: DataFrame, column: str, path: str, strip_notes: bool = True, version: str = RULES) -> DataFrame:
    """convert_responses by way of a table, with and without stripping notes apart."""
    own = f"{path}/converted-{'stripped' if strip_notes else 'whole'}"
    return once(df.drop(*CONVERTED), column, own, lambda t: convert_responses(t, "text", strip_notes), version)
