"""Tables in buckets that a stream replaces bucket by bucket, whole or not at all.

A change writes the new buckets beside the old ones, as a generation of their own, and then one small pointer file, which tells the generation of every
bucket that has rows. Readers go by the greatest pointer. So a driver that is lost at any point leaves the table as it was before the change or as it is
after it, never between, and what a dead change has left is written by nobody's pointer and goes with the next one. Several tables under one
pointer change together.

    path/<table>/gen=<number>-<random>/bucket=<k>/*.parquet
    path/pointers/<number>      {"<table>": {"<k>": "<number>-<random>"}}
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType

from gridscore.sources.shared import names, read_small, remove, write_new

BUCKET = "bucket"
#: Pointers that stay readable: a reader that has begun on one may see as many changes less one before its files go.
KEPT = 3


def _pointers(spark: SparkSession, path: str) -> list[str]:
    return [n for n in names(spark, f"{path}/pointers") if not n.startswith("_")]


def _load(spark: SparkSession, path: str, pointer: str) -> dict[str, dict[int, str]]:
    told = json.loads(read_small(spark, f"{path}/pointers/{pointer}"))
    return {table: {int(k): gen for k, gen in gens.items()} for table, gens in told.items()}


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, dict[int, str]]]:
    """The number of the last change, 0 before the first, and for each table the generation of each bucket that has rows."""
    found = _pointers(spark, path)
    return (int(found[-1]), _load(spark, path, found[-1])) if found else (0, {})


def read(spark: SparkSession, path: str, table: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """Rows of the named buckets, or of all, with `bucket`, as of the last change; a table that isn't there is empty."""
    gens = current(spark, path)[1].get(table, {})
    full = StructType([*schema.fields]).add(BUCKET, IntegerType())
    wanted = [f"{path}/{table}/gen={gen}/{BUCKET}={k}" for k, gen in sorted(gens.items()) if buckets is None or k in buckets]
    if not wanted:
        return spark.createDataFrame([], full)
    found = StructType([*full.fields]).add("gen", StringType())
    return spark.read.schema(found).option("basePath", f"{path}/{table}").parquet(*wanted).drop("gen")


def _buckets(spark: SparkSession, folder: str) -> list[int]:
    return [int(n.removeprefix(f"{BUCKET}=")) for n in names(spark, folder) if n.startswith(f"{BUCKET}=")]


def replace(spark: SparkSession, path: str, tables: dict[str, DataFrame | Callable[[str], DataFrame]], buckets: list[int]) -> None:
    """Replace these buckets of the tables at hand, which have a column `bucket` and no rows of other buckets, by one pointer. Tables are written one
    after the other; one that reads an earlier one is a function of the generation's name (see read_generation)."""
    number, told = current(spark, path)
    gen = f"{number + 1:012d}-{uuid.uuid4().hex[:8]}"
    for table, rows in tables.items():
        (rows(gen) if callable(rows) else rows).write.partitionBy(BUCKET).parquet(f"{path}/{table}/gen={gen}")
        kept = {k: g for k, g in told.get(table, {}).items() if k not in buckets}
        told[table] = kept | dict.fromkeys(_buckets(spark, f"{path}/{table}/gen={gen}"), gen)
    write_new(spark, f"{path}/pointers/{number + 1:012d}", json.dumps(told))
    sweep(spark, path)


def read_generation(spark: SparkSession, path: str, table: str, gen: str, schema: StructType) -> DataFrame:
    """What a change in progress has written of a table."""
    return spark.read.schema(StructType([*schema.fields]).add(BUCKET, IntegerType())).parquet(f"{path}/{table}/gen={gen}")


def sweep(spark: SparkSession, path: str) -> None:
    """Remove old pointers, and buckets that no kept pointer tells of, those of dead changes included. Only the tables' one writer may do this."""
    found = _pointers(spark, path)
    for old in found[:-KEPT]:
        remove(spark, f"{path}/pointers/{old}")
    kept = [_load(spark, path, p) for p in found[-KEPT:]]
    for table in {t for told in kept for t in told}:
        held = {(gen, k) for told in kept for k, gen in told.get(table, {}).items()}
        live = {gen for gen, _ in held}
        for folder in names(spark, f"{path}/{table}"):
            gen = folder.removeprefix("gen=")
            if gen not in live:
                remove(spark, f"{path}/{table}/{folder}")
                continue
            for k in _buckets(spark, f"{path}/{table}/{folder}"):
                if (gen, k) not in held:
                    remove(spark, f"{path}/{table}/{folder}/{BUCKET}={k}")
