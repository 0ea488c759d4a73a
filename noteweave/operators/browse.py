"""Metadata browsing and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.sources.notes import read_summary, write_summary


def matches(where: dict | None) -> Column:
    """A conjunction of `field: value` (equal as text) and `field: {"contains": part}`; absent values are empty."""
    tests = []
    for name, value in (where or {}).items():
        field = F.coalesce(F.col(name).cast("string"), F.lit(""))
        tests.append(field.contains(str(value["contains"])) if isinstance(value, dict) else field == str(value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def clamped(value: int, most: int) -> int:
    """A number of rows that a caller asked for, between 1 and what it may have."""
    return max(1, min(most, int(value)))


#: Rows that a caller may have: of a search, and of browsing through the interface for programs and that for tools (fixed values).
MOST_HITS, MOST_ROWS, MOST_TOOL_ROWS = 50, 500, 50


def browse(docs: DataFrame, where: dict | None = None, body_contains: str | None = None, limit: int = 50, excerpt: int = 300, id_col: str = "doc_id", most: int = MOST_ROWS) -> DataFrame:
    """The first `limit` rows by id that match, `most` at most; the limit comes after every predicate."""
    found = docs.filter(matches(where))
    if body_contains:
        found = found.filter(F.col("text").contains(body_contains))
    meta = [c for c in docs.columns if c != "text"]
    return found.select(*meta, F.substring("text", 1, excerpt).alias("excerpt")).orderBy(id_col).limit(clamped(limit, most))


def type_distribution(docs: DataFrame, by: str) -> DataFrame:
    return docs.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)).agg(F.count("*").alias("n"))


def stats(docs: DataFrame, file: str) -> DataFrame:
    return docs.agg(F.count("*").alias("n_chunks"), F.countDistinct(file).alias("n_files"))


SUMMARY = "total_chunks long, total_files long, type_distribution map<string, long>, last_sync string"


def sync_counts(docs: DataFrame, file: str, by: str, now: str) -> DataFrame:
    """The summary of a sync in one row: chunks, files, chunks of each type, and when."""
    types = type_distribution(docs, by).agg(F.map_from_entries(F.collect_list(F.struct(by, "n"))).alias("type_distribution"))  # a type each
    return stats(docs, file).crossJoin(types).select(F.col("n_chunks").alias("total_chunks"), F.col("n_files").alias("total_files"), "type_distribution", F.lit(now).alias("last_sync"))


def summary(spark: SparkSession, path: str, docs: DataFrame, file: str, by: str, now: str) -> DataFrame:
    """The stored summary where its total is the number of chunks that there are; else a new one, which is stored for the next time."""
    stored = read_summary(spark, path, SUMMARY).limit(1)
    if [r.total_chunks for r in stored.collect()] != [docs.count()]:
        write_summary(sync_counts(docs, file, by, now), path)
    return read_summary(spark, path, SUMMARY)
