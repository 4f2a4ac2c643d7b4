"""Latest rows, upserts by key, and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.sources.sizes import few


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def latest(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The row of greatest order_col for each key, with map-side combining. Ties: the greatest row, by its other columns in turn (maps and variants by their hash)."""
    rest = [c for c in df.columns if c not in keys]
    first = [order_col, *[c for c in rest if c != order_col]]
    if all(_ordered(df.schema[c].dataType) for c in first):  # the row is its own order, and is shuffled once
        return df.groupBy(*keys).agg(F.max(F.struct(*first)).alias("__row")).select(*keys, "__row.*").select(*df.columns)
    turn = [F.col(c) if _ordered(df.schema[c].dataType) else F.xxhash64(F.to_json(F.struct(c))).alias(c) for c in first[1:]]
    ranked = df.select(*keys, F.struct(*rest).alias("__row"), F.struct(F.col(order_col), *turn).alias("__order"))
    return ranked.groupBy(*keys).agg(F.max_by("__row", "__order").alias("__row")).select(*keys, "__row.*").select(*df.columns)


def latest_here(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """latest of a table that is partitioned by some of its keys, without another shuffle; what comes out is sorted by the keys in their order."""
    rest = [c for c in df.columns if c not in keys and c != order_col]
    turn = [F.col(c) if _ordered(df.schema[c].dataType) else F.xxhash64(F.to_json(F.struct(c))) for c in (order_col, *rest)]
    order = Window.partitionBy(*keys).orderBy(*[c.desc() for c in turn])
    return df.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """old without the keys of new, and new (its latest rows, where order_col says which); missing columns are null. Null keys meet each other."""
    fresh = latest(new, keys, order_col) if order_col else new
    touched = fresh.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = [old[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    return old.join(touched.hint("merge"), on, "left_anti").unionByName(fresh, allowMissingColumns=True)


def completed(predictions: DataFrame) -> DataFrame:
    """Keys of predictions that ran, converted and have a table."""
    ok = F.coalesce("run_ok", F.lit(False)) & F.coalesce("conversion_ok", F.lit(False)) & (F.coalesce("html", F.lit("")) != "")
    return predictions.where(ok).select("dataset", "run_id", "sample_id").distinct()


def pending_samples(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """(dataset, run_id, sample_id) that a run of the dataset still has to do."""
    wanted = samples.select("dataset", "sample_id").join(few(predictions.select("dataset", "run_id").distinct()), "dataset")
    return wanted.join(completed(predictions).hint("merge"), ["dataset", "run_id", "sample_id"], "left_anti").select("dataset", "run_id", "sample_id")


def run_counters(samples: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per dataset and run of `after`: samples skipped (complete before), attempted, and of these run_ok and with a table."""
    wanted = samples.select("dataset", "sample_id").join(few(after.select("dataset", "run_id").distinct()), "dataset")
    keys = ["dataset", "run_id", "sample_id"]
    rows = wanted.join(completed(before).withColumn("__done", F.lit(True)).hint("merge"), keys, "left").join(after.select(*keys, "run_ok", "conversion_ok", "html").hint("merge"), keys, "left")
    tried = F.col("__done").isNull()
    html = F.coalesce("conversion_ok", F.lit(False)) & (F.coalesce("html", F.lit("")) != "")
    return rows.groupBy("dataset", "run_id").agg(
        F.count_if(tried).alias("attempted"), F.count_if(~tried).alias("skipped"), F.count_if(tried & F.coalesce("run_ok", F.lit(False))).alias("run_ok"), F.count_if(tried & html).alias("html")
    )


def fixed_sample(samples: DataFrame, count: int, seed: int, key: str = "sample_id") -> DataFrame:
    """A repeatable draw of `count` rows without replacement, in key order; everything if there are no more."""
    drawn = samples.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(count)
    return drawn.orderBy(key)


def fixed_samples(samples: DataFrame, count: int, seed: int, key: str = "sample_id", by: str = "dataset") -> DataFrame:
    """A repeatable draw of `count` rows from each group, everything of a group that has no more. Tasks keep their first rows before they meet."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return samples.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= count).drop("__nth")
