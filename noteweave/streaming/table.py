"""A table that streams keep current: rows by id in buckets, changed by copy-on-write, with a log of commits.

A batch reads and writes the buckets of its own ids only; a commit names the file of every bucket, so readers see a batch
wholly or not at all, older commits stay readable until `vacuum`, and what a crashed batch wrote is never read. A batch that is
repeated after its commit is left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.sources import commits

BUCKETS = 64


def _last(spark: SparkSession, root: str) -> dict:
    return commits.newest(spark, f"{root}/log") or {"number": 0, "batches": {}, "files": {}, "schema": None, "buckets": None}


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table after the last commit, or after the one named."""
    known = _last(spark, root) if number is None else commits.read(spark, f"{root}/log", number)
    if known["schema"] is None:
        raise ValueError(f"the table {root} has no commit")
    paths = sorted(known["files"].values())
    return spark.read.schema(known["schema"]).parquet(*paths) if paths else spark.createDataFrame([], known["schema"])


def apply(root: str, rows: DataFrame, key: list[str], order: list[str], name: str, batch: int, gone: str | None = None, buckets: int = BUCKETS) -> dict:
    """Upsert `rows`: of an id the greatest `order` wins, also against what is stored; where `gone` is true the id is deleted.

    A batch of the stream `name` that is already in the log changes nothing. The number of buckets is that of the first commit.
    """
    spark = rows.sparkSession
    old = _last(spark, root)
    if old["batches"].get(name, -1) >= batch:
        return old
    buckets = old["buckets"] or buckets
    columns = [c for c in rows.columns if c != gone]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    struct = F.struct(*columns, (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("_gone"))
    fresh = rows.groupBy(*key).agg(F.max_by(struct, F.struct(*order)).alias("r")).select("r.*").withColumn("_bucket", bucket)
    path = f"{root}/data/{uuid.uuid4().hex}"
    fresh.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/new")
    fresh = spark.read.schema(fresh.schema).parquet(f"{path}/new")
    touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most `buckets` numbers
    if not touched:  # an empty batch
        return old
    stored = [old["files"][str(b)] for b in touched if str(b) in old["files"]]
    schema = old["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    if stored:
        before = spark.read.schema(schema).parquet(*stored).withColumns({"_gone": F.lit(False), "_bucket": bucket})
        both = fresh.select(*before.columns).withColumn("_new", F.lit(1)).unionByName(before.withColumn("_new", F.lit(0)))
        fresh = both.groupBy("_bucket", *key).agg(F.max_by(F.struct(*(c for c in both.columns if c not in ("_bucket", "_new"))), F.struct(*order, "_new")).alias("r")).select("_bucket", "r.*")
    fresh.filter(~F.col("_gone")).select(*columns, "_bucket").repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    fs, _ = commits.place(spark, root)
    files = {k: v for k, v in old["files"].items() if int(k) not in touched}
    files |= {str(b): f"{path}/rows/_bucket={b}" for b in touched if fs.exists(commits.place(spark, f"{path}/rows/_bucket={b}")[1])}
    new = {"number": old["number"] + 1, "batches": old["batches"] | {name: batch}, "files": files, "schema": schema, "buckets": buckets, "touched": touched}
    commits.commit(spark, f"{root}/log", new["number"], new)
    fs.delete(commits.place(spark, f"{path}/new")[1], True)
    return new


def sink(stream: DataFrame, root: str, checkpoint: str, key: list[str], order: list[str], name: str = "stream", mode: str = "append", gone: str | None = None):
    """Write a stream into the table, as far as there is input; returns the query."""
    write = lambda batch, number: apply(root, batch, key, order, name, number, gone)
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete what none of the last `keep` commits names; the number of folders deleted. Not while a batch is being written."""
    known = commits.numbers(spark, f"{root}/log")[-keep:]
    named = {f.split("/data/")[1].split("/")[0] for n in known for f in commits.read(spark, f"{root}/log", n)["files"].values()}
    fs, here = commits.place(spark, f"{root}/data")
    old = [s.getPath() for s in fs.listStatus(here) if s.getPath().getName() not in named] if fs.exists(here) else []
    for folder in old:
        fs.delete(folder, True)
    return len(old)
