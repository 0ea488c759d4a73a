"""The inverted index as DataFrames: tokens, postings, document frequencies, corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions import words
from noteweave.functions.text import text_or_empty, tokens


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `tokens`, `dl` (their number)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))
    return rows.withColumn("dl", F.size("tokens").cast("long"))


def postings(tokenised_docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """`doc_id`, `term`, `freq`, `dl`; of the terms in column `term` only, if given.

    The restriction stands below the aggregation, so a query's postings cost one narrow scan. Further columns of
    `tokenised_docs` are kept; they are part of the key. The outer form spares the filter on the size of the tokens that
    Spark would infer, which would tokenise once more.
    """
    own = [c for c in tokenised_docs.columns if c != "tokens"]
    each = tokenised_docs.select(*own, F.explode_outer("tokens").alias("term")).filter("term is not null")
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy(*own, "term").agg(F.count("*").alias("freq"))


def apart(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other row has, and the others (None if there are none); ids that are null are equal."""
    repeated = docs.groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("rows")).filter("rows > 1").select("again")
    if repeated.isEmpty():
        return docs, None
    same = F.col(id_col).eqNullSafe(F.col("again"))
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


#: Different words that a task counts before it passes them on.
HELD_WORDS = 1_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """`term`, `df`, `total` of all terms of `doc_id`, `text`: documents that have it, and occurrences.

    Tasks count within the rows and pass on a row for each term. Only rows that share an id are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[pa.Array, np.ndarray, np.ndarray]:
            coded = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
            at, n = coded.indices.to_numpy(), len(coded.dictionary)
            return coded.dictionary, *(np.bincount(at, np.concatenate([x[i] for x in held]), n).astype(np.int64) for i in (1, 2))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([held[0][0].cast(pa.string()), pa.array(held[0][1]), pa.array(held[0][2])], ["term", "df", "total"])

        for batch in batches:
            for _, texts in words.slices(batch.column("text")):
                _, word, freq, own = words.counted(texts)
                held.append((own, np.bincount(word, minlength=len(own)), np.bincount(word, freq, len(own)).astype(np.int64)))
                if sum(len(x[0]) for x in held) > HELD_WORDS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_WORDS // 2:
                        yield rows()
                        held = []
        if held:
            held = [merged()]
            yield rows()

    once, repeated = apart(docs.select("doc_id", text_or_empty(F.col("text")).alias("text")))
    found = once.select("text").mapInArrow(run, "term string, df long, total long")
    if repeated is not None:
        found = found.unionByName(postings(tokenised(repeated)).select("term", F.lit(1).cast("long").alias("df"), F.col("freq").alias("total")))
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """`query_id` and its different terms."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def ranked(scored: DataFrame, k: int, score: str = "score", by: str | list[str] = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query: by score rounded to six digits, then id; `rank` from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn(score, F.round(score, 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.sum(F.least("freq", F.lit(1))).alias("df")) if "freq" in posts.columns else posts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(tokenised_docs: DataFrame) -> DataFrame:
    """`n_docs`, `n_tokens`, `avgdl` (0 for an empty corpus)."""
    return tokenised_docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def corpus_digest(tokenised_docs: DataFrame, fan: int = 1024) -> DataFrame:
    """An order-sensitive digest of all tokens, folded as a tree so that no group grows with the corpus.

    Documents hash their tokens; `fan` neighbours by id make a group, `fan` groups the next, and so on over
    three levels.
    """
    own = F.sha2(F.array_join("tokens", "\x00").cast("binary"), 256)
    level = tokenised_docs.select(F.col("doc_id").alias("k"), own.alias("h"))
    for _ in range(3):
        level = level.groupBy(F.floor(F.col("k") / fan).alias("g")).agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("rows"))
        level = level.select(F.col("g").alias("k"), F.sha2(F.array_join(F.transform("rows", lambda r: r["h"]), "\x01").cast("binary"), 256).alias("h"))
    return level.select(F.col("k").alias("part"), F.col("h").alias("digest"))
