"""Running counts over a whole table in a stated order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.sources.shared import new_path, store


def amount_before(rows: DataFrame, order: list[str], amount: Column, out: str, within: list[str] | None = None) -> DataFrame:
    """rows with `out`: the sum of amount over the rows that come before, in order, of the same group (`within`; else of all).

    Rows are range-partitioned in order and stored with the number of their part; the parts' sums, a row for each part and group,
    are added up; inside a part rows are summed by a window. A group of any size is dealt over many parts. rows should be keys
    and amounts only. Order columns should tell rows of a group apart. Null groups are groups; an empty table gives an empty table.
    """
    within = within or []
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__amount", amount.cast("long")).repartitionByRange(n, *within, *order)
    dealt = store(dealt.withColumn("__part", F.spark_partition_id()), new_path(spark, "ordinal"))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*within, "__part").agg(F.sum("__amount").alias("__sum"))
    one = [F.lit(0)] if not within else within  # at most as many rows as parts
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(earlier(one, ["__part"])), F.lit(0))).drop("__sum")
    sums = sums.select(*[F.col(c).alias(f"__own_{c}") for c in within], F.col("__part").alias("__own"), "__base")
    inside = dealt.withColumn("__inside", F.coalesce(F.sum("__amount").over(earlier([*within, "__part"], order)), F.lit(0)))
    same = inside["__part"] == sums["__own"]
    for c in within:
        same = same & inside[c].eqNullSafe(sums[f"__own_{c}"])
    joined = inside.join(sums.hint("merge"), same)
    return joined.withColumn(out, F.col("__base") + F.col("__inside")).select(*rows.columns, out)
