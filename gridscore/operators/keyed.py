"""Tables bucketed and sorted by key, which take upserts without a shuffle of what they hold.

A version of a table is a bucketed table of the catalog, and a view names the current one. An upsert shuffles the new rows into the
old version's buckets, leaves out what they replace by a join that needs no exchange on the old side, writes the next version, and then
moves the view; a driver that dies before that leaves the table as it was.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridscore.operators.upsert import latest


def _versions(spark: SparkSession, name: str) -> list[int]:
    own = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_v") and t.tableType != "VIEW"]
    return sorted(int(t.removeprefix(f"{name}_v")) for t in own if t.removeprefix(f"{name}_v").isdigit())


def _commit(df: DataFrame, name: str, keys: list[str], buckets: int, number: int) -> None:
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}_v{number}")  # of a driver that died
    df.write.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(f"{name}_v{number}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_v{number}")
    for old in _versions(spark, name):
        if old < number - 1:  # the last but one may still be read
            spark.sql(f"DROP TABLE {name}_v{old}")


def current_version(spark: SparkSession, name: str) -> int:
    """The number of the version that the view names, 0 where there is none."""
    if not spark.catalog.tableExists(name):
        return 0
    text = spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
    return int(re.findall(rf"{name}_v(\d+)", text)[-1])


def create_keyed(df: DataFrame, name: str, keys: list[str], buckets: int = 64) -> None:
    """A table `name` with the rows of df, whose keys are unique and not null, in so many buckets for good. Names are lower-case."""
    spread = df.repartition(buckets, *keys)  # one file a bucket
    _commit(spread, name, keys, buckets, current_version(df.sparkSession, name) + 1)


def upserted(spark: SparkSession, name: str, new: DataFrame, keys: list[str], order_col: str | None = None, buckets: int = 64) -> DataFrame:
    """The rows of the table without the keys of new, and new (its latest rows, where order_col says which); absent columns are null.

    Only new is shuffled. Its rows with a null key are left out.
    """
    fresh = new.dropna(subset=keys)
    fresh = (latest(fresh, keys, order_col) if order_col else fresh).repartition(buckets, *keys)
    old = spark.table(f"{name}_v{current_version(spark, name)}")
    return old.join(fresh.select(*keys).distinct().hint("merge"), keys, "left_anti").unionByName(fresh, allowMissingColumns=True).select(*old.columns)


def upsert_keyed(spark: SparkSession, name: str, new: DataFrame, keys: list[str], order_col: str | None = None, buckets: int = 64) -> None:
    """upserted as the table's next version. One job writes a table at a time; buckets are those of create_keyed."""
    _commit(upserted(spark, name, new, keys, order_col, buckets), name, keys, buckets, current_version(spark, name) + 1)
