"""Numbered commits in a folder: one small JSON file each, put in place by a rename, so that each is there wholly or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), here


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The commits that are there, in order."""
    fs, here = place(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(here)] if fs.exists(here) else []
    return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())


def read(spark: SparkSession, folder: str, number: int) -> dict:
    fs, here = place(spark, f"{folder}/{number:08d}.json")
    stream = fs.open(here)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, folder: str) -> dict | None:
    known = numbers(spark, folder)
    return read(spark, folder, known[-1]) if known else None


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> dict:
    """Write commit `number`; one that another run made first is an error."""
    fs, here = place(spark, f"{folder}/{number:08d}.json")
    _, hidden = place(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(json.dumps(content, sort_keys=True, ensure_ascii=False).encode())
    out.close()
    if fs.exists(here) or not fs.rename(hidden, here):
        fs.delete(hidden, False)
        raise RuntimeError(f"commit {number} of {folder} was made by another run")
    return content
