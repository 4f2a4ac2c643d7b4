"""Small tables of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscore.sources.shared import new_path, store

#: Tables up to this many rows are broadcast; longer ones are joined by a shuffle.
FEW = 100_000


def few(table: DataFrame, limit: int = FEW) -> DataFrame:
    """A table of keys and short fields, written once and counted: with a broadcast hint up to `limit` rows, else with one for a sort-merge join."""
    held = store(table, new_path(table.sparkSession, "few"))
    return F.broadcast(held) if held.count() <= limit else held.hint("merge")
