"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.sources.shared import new_path, remove, store

#: The white space of the contracts: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which goes when the driver ends."""
    return store(df, new_path(df.sparkSession, name))


def replaced(df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
    """df as a table and its path; the table at the old path, which df may read, goes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = store(df, path)
    if old is not None:
        remove(spark, old)
    return out, path


def text_key(text: Column) -> list[Column]:
    """128 bits of hash of a text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("__t"), F.xxhash64(F.lit(1), t).alias("__u")]


def text_hash(text: Column) -> Column:
    """64 bits that tell rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("__t")


def ascii_lower(c: Column) -> Column:
    """A-Z only: lower() where every character is one byte, translate() elsewhere."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WS)))


#: CRC-32 of the ASCII text VALUE in DuckDB's SQL, bit by bit (fixed values: the polynomial, and the first and last xor).
CRC_SQL = """xor(list_reduce(list_transform(string_split(VALUE, ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda crc, byte: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)), 4294967295), 4294967295)"""
