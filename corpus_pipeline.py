"""The corpus pipeline: stages over `documents`, each written as Parquet and read by the next.

1. language: documents without an identifiable language go;
2. near_duplicates: one document of each group of near-duplicates stays;
3. benchmark: documents that hold a benchmark item go;
4. personal_data: entities are replaced by surrogates;
5. encode: token counts and digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import bpe_automaton, decontaminate, language_id, pii, simhash_dedup
from noteweave.llm.common import stored as checkpoint
from noteweave.llm.registry import VOCABULARY, secret


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what has a letter and a language of posterior 0.6 or more."""
    return language_id.keep_identified(spark, docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 on five-word shingles."""
    return simhash_dedup.deduplicate(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage within 0.2 edits a word of a benchmark item."""
    return decontaminate.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace entities, and count the characters anew."""
    columns = docs.columns
    out = pii.pseudonymise(docs, secret(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return bpe_automaton.digest(bpe_automaton.round_trip(spark, docs, VOCABULARY))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("encode", encode)]

#: Random walks, keyed surrogates and automata have no SQL; tests/llm hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; what each stage returns is written as Parquet to the shared checkpoint folder.

    `noteweave.llm.common.release` deletes those tables once the result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
