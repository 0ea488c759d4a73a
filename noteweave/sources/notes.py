"""Sources and sinks: folders of notes, JSON lines, small state tables, collections."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.sources.commits import place

#: Folder names that a sync leaves out at any depth, and those that an audit does not look into (fixed values).
EXCLUDED = (".obsidian", ".trash", "模板")
UNSEEN = (".obsidian", ".trash")

FEEDBACK = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("result_id", T.StringType()), T.StructField("adopted", T.BooleanType()),
    T.StructField("note", T.StringType()), T.StructField("query", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("header_path", T.StringType()), T.StructField("memory_type", T.StringType()), T.StructField("similarity", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
])


def exists(spark: SparkSession, path: str) -> bool:
    fs, here = place(spark, path)
    return fs.exists(here)


def folders(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> list[str]:
    """The root and all folders below it, in order; what is excluded is not even listed. Only folders reach the driver."""
    fs, top = place(spark, root)
    out, waiting = [], [fs.getFileStatus(top).getPath()]
    while waiting:
        here = waiting.pop()
        out.append(here.toString())
        waiting += [s.getPath() for s in fs.listStatus(here) if s.isDirectory() and s.getPath().getName() not in excluded]
    return sorted(out)


def _files(spark: SparkSession, root: str, excluded: tuple[str, ...], names: str) -> DataFrame | None:
    """The files of the folders as Spark's reader gives them, with their `rel`ative paths; None where there are none."""
    fs, here = place(spark, root)
    top = fs.getFileStatus(here).getPath().toString().rstrip("/") + "/"
    quoted = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", folder) for folder in folders(spark, root, excluded)]
    globs = [f"{folder}/{names}" for folder in quoted]
    globs = [g for g in globs if any(s.isFile() for s in fs.globStatus(place(spark, g)[1]) or ())]
    if not globs:
        return None
    found = spark.read.format("binaryFile").load(globs)
    return found.withColumn("rel", F.substring("path", len(top) + 1, 1 << 20))


def read_notes(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED, ordered: bool = False) -> DataFrame:
    """`path` (relative, with slashes) and `raw` of every .md file below the folder; excluded folders are never opened.

    Spark's readers pass over files whose names begin with a dot or an underscore.
    """
    files = _files(spark, folder, excluded, "*.md")
    if files is None:
        return spark.createDataFrame([], "path string, raw string")
    rows = files.select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("raw"))
    return rows.orderBy("path") if ordered else rows


def read_names(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """`name`: the relative path of every file below the folder. No file is opened."""
    files = _files(spark, folder, excluded, "*")
    return spark.createDataFrame([], "name string") if files is None else files.select(F.col("rel").alias("name"))


def write_summary(counts: DataFrame, path: str) -> None:
    """Replace the one-row summary of a sync."""
    counts.coalesce(1).write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The summary of the last sync; no row where it is missing or malformed."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """`query`, `gold` of a JSON array; gold falls back to source_file, and a blank value is an error."""
    raw = spark.read.schema("query string, gold string, source_file string").option("multiLine", True).json(path)
    gold = F.coalesce(F.when(F.trim("gold") != "", F.trim("gold")), F.trim("source_file"))
    need = lambda c: F.when(F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0, F.trim(c)).otherwise(F.raise_error(F.lit("a case has a blank query or gold")))
    return raw.select(need(F.col("query")).alias("query"), need(gold).alias("gold"))


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases (`query`, `gold`) as one JSON array, as `read_cases` reads them; a set of cases is small."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("query", "gold"))), lambda c: c)
    cases.agg(F.to_json(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """`query`, `pos`, `neg` of JSON arrays of triples: [query, positive, negative] or [query, positive, [negatives]], one row for each negative."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("t")).filter(F.size("t") == 3)
    many = F.from_json(F.col("t")[2], "array<string>")
    negatives = F.when(F.col("t")[2].startswith("[") & many.isNotNull(), many).otherwise(F.array(F.col("t")[2]))
    return each.select(F.col("t")[0].alias("query"), F.col("t")[1].alias("pos"), F.explode(negatives).alias("neg"))


def write_collection(df: DataFrame, root: str, name: str) -> None:
    """Replace one collection of a table partitioned by collection, leaving the others."""
    df.withColumn("collection", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(root)


def read_collection(spark: SparkSession, root: str, name: str, columns: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """One collection, of it the `columns` named and the first `limit` rows by the first of them if these are given."""
    rows = spark.read.parquet(root).filter(F.col("collection") == name).drop("collection")
    rows = rows.select(*columns) if columns else rows
    return rows if limit is None else rows.orderBy(rows.columns[0]).limit(limit)


def write_postings(postings: DataFrame, table: str, buckets: int = 64) -> None:
    """The inverted index as a table bucketed by term, so look-ups and joins by term need no shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term", "doc_id").saveAsTable(table)
