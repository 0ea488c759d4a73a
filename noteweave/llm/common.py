"""Helpers shared by the operators: shared-storage checkpoints, worker imports, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it is installed beside the driver's script.

    On a cluster the package is normally shipped with --py-files; then this adds a path that does
    no harm.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    # Workers give memory back to the system once a large array is freed, since they stay for later stages.
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "1048576"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)
    # Whole texts make wide rows; the default of 10,000 rows in an Arrow batch is held several times over.
    if int(spark.conf.get(ROWS)) == 10_000:
        spark.conf.set(ROWS, "500")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set and the master is local, so that the executors share the driver's
    disk, a temporary one. On a cluster without one this is an error: executors would write where nobody else can read."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        local = (sc.master or "").startswith("local")
        if not named and not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: compressed, for rows that hold texts."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(df.stored_at)


def release(spark: SparkSession) -> None:
    """Delete the tables that `stored` wrote in this session; call it once the results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def positional(df: DataFrame) -> DataFrame:
    """The columns by place, c0, c1 and so on, so that helper columns clash with none of them."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first columns c0, c1 and so on under their own names again, and all others dropped."""
    return df.select(*(f"c{i}" for i in range(len(columns)))).toDF(*columns)


#: A key with more than 1 / HOT of the rows is split, so there are fewer than HOT such keys; FEW rows need no split.
HOT, FEW = 256, 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`left` (a stored table) joined with `right`, which has one row for each key, hot keys of `left` split.

    Hot keys are counted by a partial aggregation; their list has fewer than HOT rows and is broadcast. Rows of
    a hot key go to as many places as it holds shares of 1 / HOT of all rows, and its row of `right` to each.
    """
    total = left.count()
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter((F.col("_n") * HOT > total) & (F.col("_n") > FEW))
    hot = stored(counts.select(*keys, F.ceil(F.col("_n") * HOT / max(1, total)).cast("int").alias("_parts")))
    if hot.isEmpty():
        return left.join(right, keys, how)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_parts").join(copied.drop("_parts"), [*keys, "_salt"], how).drop("_salt")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
