"""Parquet tables by name, and tables that a job writes for its own later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its scan has fewer splits than these, as a small file of one row group has; else as it is.

    A scan of many splits is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str, wide: tuple[str, ...] = ("documents", "pages")) -> DataFrame:
    """A table of the folder; those that are `wide`, whose rows cost much work each, over all cores."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in wide else rows


_local: list[str] = []
_staged: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; with a local master and none, a temporary one.

    On a cluster without one this is an error: executors would write where nobody else can read.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is not None:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="noteweave-"))
    return _local[0]


def staged(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there, so that several readers cost them once."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what `staged` wrote in this session; call it once the results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)
