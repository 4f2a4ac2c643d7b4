"""Predictions that keep arriving: the latest of each key, and a leaderboard that follows.

State is a table in buckets by key. A batch reads the buckets that it touches and replaces them by a change that is there whole or not at all (see
snapshots); nothing of older batches is kept. Merging is by greatest order, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridscore.operators.scoring import partial_sums, summed
from gridscore.operators.upsert import latest
from gridscore.streaming import snapshots
from gridscore.streaming.snapshots import BUCKET

KEYS = ["dataset", "run_id", "sample_id"]
ROWS, SUMS = "rows", "sums"


def stream_latest(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, order_col: str = "seq", buckets: int = 64, derived: dict[str, Callable[[DataFrame], DataFrame]] | None = None
) -> StreamingQuery:
    """Keep the row of greatest order_col for each key, whatever order rows arrive in, in a table at path (see latest_rows).

    derived: tables made of the rows of a bucket, with their bucket, which change together with the rows. The number of buckets is
    that of the table for good. One query writes a table.
    """
    keys = keys or KEYS

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[BUCKET] for r in fresh.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        old = snapshots.read(spark, path, ROWS, batch.schema, touched)
        tables = {ROWS: latest(old.unionByName(fresh), [*keys, BUCKET], order_col)}
        for name, of in (derived or {}).items():
            tables[name] = lambda gen, of=of: of(snapshots.read_generation(spark, path, ROWS, gen, batch.schema))
        snapshots.replace(spark, path, tables, touched)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table of stream_latest as of its last batch; empty before the first."""
    return snapshots.read(spark, path, ROWS, schema).drop(BUCKET)


def stream_summaries(scores: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Summaries of the latest scores (see board). Sums by run and bucket are kept; a batch sums the buckets anew that it touches, so a run of any size is spread."""
    return stream_latest(scores, path, checkpoint, buckets=buckets, derived={SUMS: lambda rows: partial_sums(rows, "dataset", "run_id", BUCKET)})


def board(spark: SparkSession, path: str) -> DataFrame:
    """The summaries as of the last batch; empty before the first."""
    none = partial_sums(spark.createDataFrame([], SCORES), "dataset", "run_id")
    return summed(snapshots.read(spark, path, SUMS, none.schema))


SCORES = "dataset string, run_id string, teds double, teds_s double, cell_f1 double, numeric_cells_correct int, numeric_cells_total int, run_failure boolean, conversion_failure boolean, seconds double"
