"""Caption and note rows at the ends of a grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore.functions.textnorm import NOTE_ROW, let


def body_range(grid: Column, pattern: str = NOTE_ROW) -> Column:
    """struct<lo, n>: where the rows begin (from 0) that are left between the notes at both ends, and how many they are.

    A note is a row at least as wide as the table less one, with one cell that isn't empty, which matches the pattern.
    """
    def note(r, width):
        filled = F.filter(r, lambda c: c != "")
        return (F.size(r) >= F.greatest(F.lit(1), width - 1)) & let(filled, lambda f: (F.size(f) == 1) & F.array_join(f, " ").rlike(pattern))

    plain = let(F.array_max(F.transform(grid, F.size)), lambda w: F.filter(F.transform(grid, lambda r, i: F.when(~note(r, w), i)), lambda i: i.isNotNull()))
    return let(plain, lambda p: F.when(F.size(p) == 0, F.struct(F.lit(0).alias("lo"), F.lit(0).alias("n"))).otherwise(F.struct(F.array_min(p).alias("lo"), (F.array_max(p) - F.array_min(p) + 1).alias("n"))))


def without_notes(grid: Column, pattern: str = NOTE_ROW) -> Column:
    return let(body_range(grid, pattern), lambda b: F.slice(grid, b["lo"] + 1, b["n"]))
