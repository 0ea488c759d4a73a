"""Language identification by Bayesian fusion of four kinds of evidence.

* The text: tempered log-likelihoods of byte trigrams under one multinomial model for each language,
  trained on a bounded sample of labelled rows.
* The declared language (the markup's lang attribute, or a column): P(declared | language), estimated
  from all rows by a grouped aggregation.
* The address suffix (country-code suffix of the host, or a language segment of the path): estimated
  the same way.
* The host: priors by grouped aggregation of the text posteriors over all rows, smoothed from all rows
  to the registered domain and from the domain to the host.

Aggregations are partial before they shuffle, so a host with a third of all rows is one short row for each
task. The table of host priors is broadcast only if its counted size is within BROADCAST_HOSTS; beyond
that it is joined by shuffle, with hot hosts split.

Defined results: null or empty texts are judged by the other evidence alone; rows without any evidence
get the global prior's best language with its posterior; a null or malformed address has the empty host; an
unknown declared language counts as declared "other", a missing one as not declared; ties go to the
language first in alphabetical order; repeated rows count as often as they stand, but a repeated id trains once, with
its smallest text; without any labelled row no language is known, so pages get null and `keep_identified` keeps nothing; an
empty table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.common import checkpoint, named, positional, prepare, small_batches, spread_join, stored

#: Labelled rows that the text models are trained on: a documented bound.
SAMPLE = 3_000
BUCKETS = 1 << 16
#: Overlapping trigrams are not independent; their log-likelihoods count by this factor.
TEMPER = 0.2
#: Strength, in rows, of the prior of the level above.
STRENGTH = 20.0
BROADCAST_HOSTS = 100_000
#: Languages that a country-code suffix or a path segment speaks for (fixed values).
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "en": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>|&#?\w+;", re.S | re.I)
_CHUNK = 1 << 20


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's byte trigrams, lower case, without runs of blanks."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" "
    for start in range(0, len(data) - 2, _CHUNK):
        x = np.frombuffer(data[start : start + _CHUNK + 2], np.uint8).astype(np.uint32)
        a, b, c = x[:-2], x[1:-1], x[2:]
        kept = (b != 32) | (a != 32) & (c != 32)
        yield ((a * 7919 + b * 263 + c) & (BUCKETS - 1))[kept]


class TextModel:
    """`languages` in alphabetical order and `weights[bucket, language]`, log-probabilities."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> TextModel:
        languages = sorted({lang for _, lang in rows})
        counts = np.full((BUCKETS, len(languages)), 0.5)
        for text, lang in rows:
            for found in trigrams(text):
                counts[:, languages.index(lang)] += np.bincount(found, minlength=BUCKETS)
        return cls(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))

    def scores(self, text: str | None) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for found in trigrams(text) if text else ():
            total += self.weights[found].sum(axis=0, dtype=np.float64)
        total *= TEMPER
        return total - total.max(initial=-np.inf) if len(total) else total


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE) -> TextModel:
    """Train on the `bound` labelled ids that come first in the order of a hash.

    The hashes alone are sorted; then the texts up to the last hash are fetched, so that the driver gets
    `bound` texts and not as many from every task.
    """
    rows = labelled.filter(F.col(text_col).isNotNull() & (F.coalesce(F.col(lang_col), F.lit("")) != ""))
    rows = rows.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    last = rows.select("h").distinct().orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    drawn = rows.filter(F.col("h") <= last).groupBy("h").agg(F.min(F.struct("t", "l")).alias("r")).collect() if last is not None else []
    return TextModel.train(sorted((r.r.t, r.r.l) for r in drawn))


def code(value: Column) -> Column:
    """The primary subtag of a language tag in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def domain(name: Column) -> Column:
    """The last two labels of a host name, or three below a second-level suffix like co.uk."""
    found = F.regexp_extract(name, r"((?:[^.]+\.)?(?:(?:co|com|org|net|ac|gov|edu)\.[a-z]{2}|[^.]+))$", 1)
    return F.when(F.length(found) > 0, found).otherwise(name)


def suffix(url: Column) -> Column:
    """The language that the path's first segment or the host's last label speaks for; empty if none."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#._-]|$)", 1))
    label = F.regexp_extract(host(url), r"\.([a-z]{2})$", 1)
    pairs = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, path), F.try_element_at(pairs, label), F.lit(""))


def evidence(spark: SparkSession, df: DataFrame, model: TextModel, text_col: str, markup: bool, declared: Column | None, address: Column | None, place: Column | None = None) -> DataFrame:
    """All columns of `df` with `_scores`, `_declared`, `_suffix`, `_host` and `_domain`.

    `address` is a URL; `place` names the host directly where there is no URL. With `markup`, the text
    is that between the tags, and the declared language that of the first lang attribute.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages
    columns = df.columns
    text = F.col(text_col).cast("string")
    if declared is None and markup:
        declared = F.regexp_extract(text, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    place = place if place is not None else host(address) if address is not None else F.lit("")
    out = df.select(
        *columns,
        code(declared if declared is not None else F.lit("")).alias("_declared"),
        (suffix(address) if address is not None else F.lit("")).alias("_suffix"),
        F.coalesce(place.cast("string"), F.lit("")).alias("_host"),
        text.alias("_text"),
    ).withColumn("_domain", domain(F.col("_host")))
    fields = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in small_batches(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            found = [judge.scores(_MARKUP.sub(" ", t) if markup and t else t) for t in texts]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.list_(pa.float64()))], [*names, "_scores"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*(f for f in fields if f.name != "_text"), StructField("_scores", ArrayType(DoubleType()))])
    return out.mapInArrow(run, schema)


def _softmax(scores: Column, n: int) -> Column:
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(posterior: str, n: int) -> list[Column]:
    return [F.sum(F.element_at(posterior, i + 1)).alias(f"n{i}") for i in range(n)]


def _array(prefix: str, n: int) -> Column:
    return F.array(*(F.col(f"{prefix}{i}") for i in range(n)))


def priors(rows: DataFrame, n: int) -> tuple[DataFrame, list[list[dict[str, float]]]]:
    """`_host` with `_prior` (log-priors), and P(declared | language), P(suffix | language) as dictionaries.

    `rows` is what `evidence` gives. One grouped aggregation by host, declared language and suffix feeds
    all levels; the channels have at most a few dozen values.
    """
    base = checkpoint(rows.withColumn("_p", _softmax(F.col("_scores"), n)).groupBy("_host", "_domain", "_declared", "_suffix").agg(*_sums("_p", n)))
    total = [F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]
    overall = base.agg(*total).first()
    mass = [float(x or 0.0) for x in overall]
    start = [(x + 1.0) / (sum(mass) + n) for x in mass]
    hosts = base.groupBy("_host", "_domain").agg(*total)
    domains = hosts.groupBy("_domain").agg(*total)

    def smoothed(counts: list[Column], above: list[Column]) -> list[Column]:
        size = reduce(lambda a, b: a + b, counts)
        return [(c + STRENGTH * p) / (size + STRENGTH) for c, p in zip(counts, above, strict=True)]

    level = domains.select("_domain", *(p.alias(f"d{i}") for i, p in enumerate(smoothed([F.col(f"n{i}") for i in range(n)], [F.lit(x) for x in start]))))
    level = hosts.join(level, "_domain").select("_host", *(F.log(p).alias(f"h{i}") for i, p in enumerate(smoothed([F.col(f"n{i}") for i in range(n)], [F.col(f"d{i}") for i in range(n)]))))
    found = level.select("_host", _array("h", n).alias("_prior"))
    channels = []
    for name in ("_declared", "_suffix"):
        # Values are codes of two or three letters, so this is a few thousand short rows at most.
        counts = {r[name]: [float(x) for x in r[1:]] for r in base.groupBy(name).agg(*total).collect()}
        values = sorted(counts)
        channels.append([{v: (counts[v][i] + 1.0) / (mass[i] + len(values) + 1.0) for v in values} for i in range(n)])
    return found, channels


def fuse(rows: DataFrame, prior: DataFrame, channels: list[list[dict[str, float]]], languages: list[str]) -> DataFrame:
    """`rows` with `_lang` and `_posterior`, and without the columns of evidence."""
    n = len(languages)
    few = prior.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(prior), "_host", "left") if few else spread_join(stored(rows), prior, ["_host"], "left")
    spoken = F.col("_scores")
    parts = [F.col("_prior")]
    for name, channel in zip(("_declared", "_suffix"), channels, strict=True):
        values = sorted(channel[0]) if channel else []
        logs = F.create_map(*(x for v in values for x in (F.lit(v), F.array(*(F.lit(float(np.log(c[v]))) for c in channel))))) if values else None
        if logs is not None:  # an empty value is no evidence
            parts.append(F.when(F.col(name) != "", F.try_element_at(logs, F.col(name))))
    for part in parts:
        spoken = F.zip_with(spoken, F.coalesce(part, F.array_repeat(F.lit(0.0), n)), lambda a, b: a + b)
    names = F.array(*map(F.lit, languages))
    out = joined.withColumn("_fused", _softmax(spoken, n))
    best = F.array_max("_fused")
    return out.withColumns({"_lang": F.try_element_at(names, F.array_position("_fused", best).cast("int")), "_posterior": best}).drop("_scores", "_declared", "_suffix", "_host", "_domain", "_prior", "_fused")


def identify_pages(spark: SparkSession, pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col`, `url_col`, `lang` and `posterior` for each page."""
    if not model.languages:
        return pages.select(id_col, url_col, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    narrow = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("_html"))
    rows = checkpoint(evidence(spark, narrow, model, "_html", True, None, F.col("u")).drop("_html"))
    prior, channels = priors(rows, len(model.languages))
    found = fuse(rows, prior, channels, model.languages)
    return found.select(F.col("i").alias(id_col), F.col("u").alias(url_col), F.col("_lang").alias("lang"), F.col("_posterior").alias("posterior"))


def keep_identified(spark: SparkSession, docs: DataFrame, model: TextModel, least: float = 0.6, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that have a letter and a language of posterior `least` or more.

    The source stands for the host. Texts are read twice and never shuffled.
    """
    columns = docs.columns
    text, lang, source = (f"c{columns.index(c)}" for c in (text_col, lang_col, source_col))
    plain = positional(docs)
    if not model.languages:
        return docs.filter(F.lit(False))
    rows = evidence(spark, plain, model, text, False, F.col(lang), None, F.col(source))
    prior, channels = priors(rows.drop(*plain.columns), len(model.languages))
    found = fuse(rows, prior, channels, model.languages)
    return named(found.filter((F.col("_posterior") >= least) & F.col(text).rlike(r"\p{L}")), columns)
