"""Files in and out: JSON lines, CSV with a byte order mark, manifests, whole texts, datasets, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.operators.scoring import SUMMARY_NAMES
from gridscore.sources.arrays import read_json_array
from gridscore.sources.schemas import PREDICTION, SAMPLE
from gridscore.sources.shared import new_path, or_empty, store
from gridscore.sources.sizes import few


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped; a path that isn't there is an empty table."""
    return or_empty(lambda: spark.read.schema(schema).json(path), spark, schema)


def write_jsonl(df: DataFrame, path: str, append: bool = False, partition_by: tuple[str, ...] = (), compression: str = "none") -> None:
    """An object a line. Where folders are made by columns, only those of the rows at hand are replaced."""
    df.write.mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*partition_by).json(path)


def read_samples(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    df = read_jsonl(spark, path, SAMPLE)
    return df if dataset is None else df.where(F.col("dataset") == dataset)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PREDICTION)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is dropped. Without a schema all columns are strings."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    if schema:
        df = df.select(*[F.expr(f"try_cast(nullif(`{name}`, '') AS {kind}) AS `{name}`") for name, kind in (x.strip().rsplit(" ", 1) for x in schema.split(","))])
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """A header, the columns in order, nulls as blanks, and a byte order mark before the first name; nothing for an empty table."""
    if df.isEmpty():
        return
    df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def union_rows(*frames: DataFrame) -> DataFrame:
    """All columns in the order first seen; absent ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def summary_as_file(summary: DataFrame) -> DataFrame:
    """A run summary under the names that summary files have."""
    s = summary if "backend_tag" in summary.columns else summary.withColumn("backend_tag", F.lit(""))
    order = ["dataset", "run_id", "backend_tag", *list(SUMMARY_NAMES)[1:]]
    return s.select(*[F.col(c).alias(SUMMARY_NAMES.get(c, c)) for c in order])


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, image, gt, source, record) of manifest entries, from JSON arrays of any size or from an object a line; record has all fields as texts."""
    rows = spark.read.text(path).where(F.trim("value") != "") if lines else read_json_array(spark, path)
    rows = rows.select(F.from_json("value", "map<string,string>").alias("record"))
    return rows.select(*[F.col("record")[c].alias(c) for c in ("id", "image", "gt", "source")], "record")


def write_texts(texts: DataFrame, path: str) -> None:
    """texts (name, value) as containers: Parquet sorted by name, so that its statistics are the index by which a name is found. Names are strings."""
    rows = texts.select("name", "value", F.octet_length("value").cast("long").alias("length"))
    rows.repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").parquet(path)


PACKED = "name string, value string, length long"


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the texts of write_texts, by name, invalid bytes replaced."""
    return spark.read.schema(PACKED).parquet(path).select(F.col("name").alias("path"), F.make_valid_utf8("value").alias("value"))


def list_packed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the texts of write_texts; values aren't read."""
    return spark.read.schema(PACKED).parquet(path).select(F.col("name").alias("path"), "length", F.col("_metadata.file_modification_time").alias("modificationTime"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole files, invalid bytes replaced."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("value"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of files; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores (or summaries) by dataset and run; only the runs at hand are replaced."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "run_id").parquet(path)


def read_scores(spark: SparkSession, path: str, schema) -> DataFrame:
    return or_empty(lambda: spark.read.schema(schema).parquet(path), spark, schema)


def write_dataset(rows: DataFrame, path: str, source: str) -> DataFrame:
    """rows (dataset, sample_id, image, gt_html, meta) as samples, manifest, truths and import report, by dataset; returns the report.

    Other datasets at path stay. read_dataset gives the rows back from the manifest and the truths. Samples and manifest are lines in gzip files,
    which Spark reads as it reads others; a file is what one task wrote, and is read by one.
    """
    rows = store(rows, new_path(rows.sparkSession, "import"))
    file_name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    own = F.map_from_entries(F.array(F.struct(F.lit("source").alias("key"), F.lit(source).alias("value"))))
    meta = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(F.coalesce("meta", F.create_map().cast("map<string,string>")), k)), F.coalesce("meta", F.create_map().cast("map<string,string>")))
    write_jsonl(rows.select("dataset", "sample_id", "image", "gt_html", meta.alias("meta")), f"{path}/samples", partition_by=("dataset",), compression="gzip")

    fixed = {"id": F.col("sample_id"), "image": F.concat(F.lit("tables/"), file_name("image")), "gt": F.concat(F.lit("gt/"), "sample_id", F.lit(".html"))}
    first = F.map_from_arrays(F.array(*[F.lit(k) for k in fixed]), F.array(*fixed.values()))
    record = F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(meta, k)), meta)  # fields of meta go before those of the row
    manifest = rows.select("dataset", F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
    _by_dataset(manifest).option("compression", "gzip").text(f"{path}/manifest")
    truths = rows.select("dataset", fixed["gt"].alias("name"), F.coalesce("gt_html", F.lit("")).alias("value")).withColumn("length", F.octet_length("value").cast("long"))
    _by_dataset(truths.repartitionByRange("dataset", "name").sortWithinPartitions("dataset", "name")).parquet(f"{path}/truths")
    report = rows.groupBy("dataset").agg(F.count("*").alias("sample_count")).withColumn("source", F.lit(source))
    write_jsonl(report, f"{path}/report", partition_by=("dataset",))
    return report


def _by_dataset(df: DataFrame):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset")


def read_dataset(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(id, image, gt, source, record, value): the manifest of a dataset that write_dataset wrote, with its truths."""
    manifest = read_manifest(spark, f"{path}/manifest/dataset={dataset}", lines=True)
    truths = spark.read.schema(PACKED).parquet(f"{path}/truths/dataset={dataset}").select(F.col("name").alias("gt"), "value")
    return manifest.join(truths.hint("merge"), "gt")


def viewer_payload(samples: DataFrame, scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """(dataset, run_id, sample_id, image and score and prediction fields, null where there is none): every sample of every run, a row each.

    A run's list is its rows in id order; no row or task holds a run.
    """
    runs = few(predictions.select("dataset", "run_id").distinct())
    keys = ["dataset", "run_id", "sample_id"]
    wanted = samples.select("dataset", "sample_id", "image").join(runs, "dataset")
    s = scores.select(*keys, *[F.col(c).alias(n) for n, c in _VIEWED.items()])
    p = predictions.select(*keys, *SHOWN, "seconds", "error")
    return wanted.join(p.hint("merge"), keys, "left").join(s.hint("merge"), keys, "left")


#: Fields of a prediction and of its scores that the viewer shows.
SHOWN = ("run_ok", "conversion_ok", "preprocess_profile", "backend_tag", "prompt_id", "long_image_side")
_VIEWED = {"teds": "teds", "teds_s": "teds_s", "cell_f1": "cell_f1", "numeric": "numeric_cell_accuracy"}


def viewer_rows(scores: DataFrame, told: str) -> DataFrame:
    """viewer_payload of score rows that carry a struct of their predictions' SHOWN fields (see score_runs), null where there is none; nothing is joined."""
    return scores.select("dataset", "run_id", "sample_id", "image", *[F.col(f"{told}.{c}").alias(c) for c in SHOWN], "seconds", "error", *[F.col(c).alias(n) for n, c in _VIEWED.items()])


def write_viewer(payload: DataFrame, path: str) -> None:
    """The payload as JSON lines in gzip files, a folder for each dataset and run, ids in order within each file. It is made once: ranges are found in what is stored."""
    spark = payload.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = store(payload, new_path(spark, "payload")).repartitionByRange(n, "dataset", "run_id", "sample_id").sortWithinPartitions("dataset", "run_id", "sample_id")
    write_jsonl(rows, path, partition_by=("dataset", "run_id"), compression="gzip")
