"""Tables and folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a temporary one serves a driver that is its own executor; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="gridscore-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete what no later step reads."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete when the driver ends; until then lazy results may read it. The path must be there."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back: the lineage is cut, lost executors cost nothing, and what follows has true sizes."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def or_empty(read, spark: SparkSession, schema) -> DataFrame:
    """What read() gives; a path that isn't there is an empty table."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    fs, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_small(spark: SparkSession, path: str) -> str:
    """A small file's text, read on the driver."""
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside and renamed. It must be new."""
    fs, at = _file_system(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at.getParent()}/_{uuid.uuid4().hex}")
    stream = fs.create(aside)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        raise FileExistsError(f"{path} was written by someone else")
