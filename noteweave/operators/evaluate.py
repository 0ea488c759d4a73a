"""Retrieval quality: first hits, Hit@k and MRR, reachability, self-made cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_hits(ranking: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """`query_id` and `first`: the rank of the first gold document, null if none is ranked; queries with gold only."""
    asked = queries.select("query_id").join(gold.select("query_id").distinct(), "query_id", "left_semi")
    found = ranking.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return asked.join(found, "query_id", "left")


def metrics(first: DataFrame) -> DataFrame:
    """`n`, `hit1`, `hit5` and `mrr` (cut at 5), rounded to six digits."""
    share = lambda test: F.round(F.coalesce(F.avg(F.when(test, 1.0).otherwise(0.0)), F.lit(0.0)), 6)
    mrr = F.avg(F.when(F.col("first") <= 5, 1.0 / F.col("first")).otherwise(0.0))
    return first.agg(F.count("*").alias("n"), share(F.col("first") <= 1).alias("hit1"), share(F.col("first") <= 5).alias("hit5"), F.round(F.coalesce(mrr, F.lit(0.0)), 6).alias("mrr"))


def unreachable(items: DataFrame, gold: DataFrame) -> DataFrame:
    return items.join(gold.select("item_id").distinct(), "item_id", "left_anti")


def query_sentence(text: Column, longest: int = 44) -> Column:
    """A query from a text: of the lines after the first, the first long one, cut at its first sentence mark.

    Lines are stripped of list marks; a line needs 12 characters; the cut is at the earliest mark between
    position 8 and the end of the first `longest` characters.
    """
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 2, 1 << 20), lambda x: F.trim(F.regexp_replace(x, r"^[#\-*\s`]+", "")))
    line = F.get(F.filter(lines, lambda x: F.length(x) >= 12), F.lit(0))
    head = F.substring(line, 1, longest)
    cut = F.regexp_extract(head, r"^(.{8}[^.!?;。！？；]*)[.!?;。！？；]", 1)
    chosen = F.trim(F.when(F.length(cut) >= 8, cut).otherwise(head))
    return F.coalesce(chosen, F.trim(F.substring(text, 1, longest)))


def self_cases(docs: DataFrame, n: int, id_col: str = "doc_id", file_col: str = "source") -> DataFrame:
    """`n` cases, spread over the files: a hash orders each file's chunks and n // files + 1 of each may enter.

    The size of the sample is the feature.
    """
    files = docs.select(file_col).distinct().count()
    order = F.md5(F.col(id_col).cast("string").cast("binary"))
    drawn = docs.withColumn("h", order).withColumn("turn", F.row_number().over(Window.partitionBy(file_col).orderBy("h", id_col)))
    few = drawn.filter(F.col("turn") <= n // max(1, files) + 1).orderBy("h", id_col).limit(n)
    return few.select(id_col, F.col(file_col).alias("gold"), query_sentence(F.col("text")).alias("query"))
