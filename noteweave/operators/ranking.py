"""Keyword, vector and fused ranking over batches of queries; every ranking has a total order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.functions.text import tokens
from noteweave.operators.browse import MOST_HITS, clamped
from noteweave.operators.index import document_frequencies, postings, query_terms, ranked, term_counts, tokenised
from noteweave.operators.shards import rank, shards_of_texts

RRF_K, POOL = 60, 50
#: Query vectors that one pass over the corpus takes with it.
QUERY_BLOCK = 2048
#: Vectors that are compared with a block of queries at a time.
VECTORS = 1024


def bm25(docs: DataFrame, queries: DataFrame, k: int = POOL, keep: Column | None = None) -> DataFrame:
    """`query_id`, `rank`, `doc_id`, `score` of the k best documents that share a term with the query.

    `keep` is a predicate on `docs`; statistics stay those of the whole corpus.
    """
    return rank(shards_of_texts(docs, queries, keep), queries, k).drop("channel")


def tfidf(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """`doc_id`, `term`, `weight`: sublinear frequencies, smooth idf, unit length, the `most` commonest terms."""
    return weights(postings(tokenised(docs)), idf_table(docs, most))


def idf_table(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """`term`, `idf` of the `most` commonest terms."""
    n = docs.count()
    return term_counts(docs).orderBy(F.desc("total"), "term").limit(most).select("term", (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weights(posts: DataFrame, idf: DataFrame) -> DataFrame:
    """`doc_id`, `term`, `weight`: unit vectors of sublinear frequencies under `idf`."""
    raw = posts.join(idf, "term").select("doc_id", "term", ((F.log(F.col("freq")) + 1.0) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("weight"))


def term_cosine(docs: DataFrame, queries: DataFrame, k: int = POOL, keep: Column | None = None) -> DataFrame:
    """The sparse vector channel: cosine of log-frequency document vectors and binary query vectors."""
    return rank(shards_of_texts(docs, queries, keep), queries, k, ("vector",)).drop("channel")


def channels(docs: DataFrame, queries: DataFrame, k: int = POOL, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The vector and the keyword ranking, from one pass over the texts."""
    both = rank(shards_of_texts(docs, queries, keep), queries, k, ("vector", "keyword"))
    return tuple(both.filter(F.col("channel") == c).drop("channel") for c in ("vector", "keyword"))


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = POOL, metric: str = "dot", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`query_id`, `rank`, the id and `score` of the k best vectors of each query, by dot product or 1 - squared distance.

    A block of query vectors goes along with one pass over the corpus; each task keeps k rows of each
    query, so only those are shuffled. Vectors of another length than the query's are not compared.
    """
    asked = queries.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
    passes = -(-asked.count() // QUERY_BLOCK) or 1
    rows = vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = None
    for number in range(passes):
        block = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == number)
        held: dict[int, list] = {}
        for r in block.collect():  # about QUERY_BLOCK rows
            held.setdefault(len(r.v), []).append((r.q, r.v))
        shared = spark.sparkContext.broadcast({n: (np.array([q for q, _ in x]), np.array([v for _, v in x])) for n, x in held.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {n: _Best(len(names), k) for n, (names, _) in shared.value.items()}
            for batch in batches:
                ids, lists = batch.column("id").to_numpy(), batch.column("v")
                lengths = lists.value_lengths().to_numpy()
                flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
                for n, (_, matrix) in shared.value.items():
                    every = np.flatnonzero(lengths == n)
                    for i in range(0, len(every), VECTORS):
                        here = every[i : i + VECTORS]
                        x = flat[starts[here][:, None] + np.arange(n)]
                        scores = matrix @ x.T
                        if metric == "l2":
                            scores = 1.0 - ((matrix * matrix).sum(1)[:, None] + (x * x).sum(1) - 2.0 * scores)
                        best[n].add(scores, ids[here])
            for n, (names, _) in shared.value.items():
                query, score, doc = best[n].rows()
                if len(query):
                    yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])

        part = rows.mapInArrow(run, "query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    return ranked(found, k).select("query_id", "rank", F.col("doc_id").alias(id_col), "score")


class _Best:
    """The k best rows of each query so far, by score rounded to six digits and then id; scores that are not above minus infinity are none."""

    def __init__(self, queries: int, k: int):
        self.k, self.bar, self.late = k, np.full(queries, -np.inf), 0
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """`scores` of queries by rows; they are rounded here, in place."""
        bar = self.bar
        if scores.shape[1] > self.k and np.isneginf(bar).any():  # nothing is known yet: the k best here do
            np.nan_to_num(scores, copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            bar = np.maximum(bar, np.round(np.partition(scores, -self.k, axis=1)[:, -self.k], 6))
        # What rounds to the bar is less than one unit below it; the product is not rounded where it is far from that.
        query, row = np.nonzero(scores >= (bar - 1e-6)[:, None])
        score = np.round(scores[query, row], 6)
        keep = (score >= bar[query]) & (score > -np.inf)
        self.held.append((query[keep], score[keep], ids[row[keep]]))
        self.late += int(keep.sum())
        if self.late > max(100_000, self.k * len(self.bar)) or np.isneginf(self.bar).any():
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, np.arange(len(self.bar)))
        kept = np.arange(len(query)) - first[query] < self.k if len(query) else np.zeros(0, bool)
        self.held, self.late = [(query[kept], score[kept], ids[kept])], 0
        last = first + self.k - 1
        full = np.flatnonzero(np.diff(first, append=len(query)) >= self.k)
        self.bar[full] = score[last[full]]
        return self.held[0]


def fuse(vector: DataFrame, keyword: DataFrame, vector_weight: float = 1.0, keyword_weight: float = 1.0, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings (`query_id`, `rank`, `doc_id`, `score`)."""
    v = vector.select("query_id", "doc_id", F.col("rank").alias("vec_rank"), F.col("score").alias("similarity"))
    w = keyword.select("query_id", "doc_id", F.col("rank").alias("kw_rank"), F.col("score").alias("bm25"))
    part = lambda rank, weight: F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    return v.join(w, ["query_id", "doc_id"], "full_outer").withColumn("fused", part("vec_rank", vector_weight) + part("kw_rank", keyword_weight))


def hits(fused: DataFrame, top_k: int) -> DataFrame:
    """Fused order: by score, then the vector channel's rank, then the keyword channel's."""
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.col("vec_rank").asc_nulls_last(), F.col("kw_rank").asc_nulls_last(), "doc_id")
    return fused.withColumn("fused", F.round("fused", 9)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def search(docs: DataFrame, queries: DataFrame, top_k: int = 10, keep: Column | None = None, mode: str = "hybrid", vector_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Hybrid, vector-only or keyword-only search under a metadata predicate, with the hit's metadata.

    `docs` has doc_id, text and any metadata; `top_k` is between 1 and 50; excerpts are the first 200 characters. In the one-channel modes the
    other weight is zero, as if that channel had found nothing.
    """
    asked = {"hybrid": ("vector", "keyword"), "vector": ("vector",), "keyword": ("keyword",)}[mode]
    found = rank(shards_of_texts(docs, queries, keep), queries, POOL, asked)
    vector, keyword = (found.filter(F.col("channel") == c).drop("channel") for c in ("vector", "keyword"))
    best = hits(fuse(vector, keyword, vector_weight, keyword_weight), clamped(top_k, MOST_HITS))
    meta = [c for c in docs.columns if c not in ("doc_id", "text")]
    shown = docs.select("doc_id", *meta, F.substring("text", 1, 200).alias("excerpt"))
    return best.join(shown, "doc_id").select("query_id", "rank", "doc_id", F.bround("fused", 5).alias("fused_score"), F.bround("similarity", 3).alias("similarity"), F.bround("bm25", 3).alias("bm25"), *meta, "excerpt")


def rerank(docs: DataFrame, queries: DataFrame, pool: DataFrame, top_k: int = 10, clip: int = 512) -> DataFrame:
    """Reorder a pool of hits by a pair score on texts clipped to `clip` characters.

    The scorer here is lexical: the share of the query's different terms that the clipped text holds. Queries
    with no more candidates than `top_k` keep their order.
    """
    sized = pool.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    terms = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("q"))
    texts = docs.select("doc_id", F.substring("text", 1, clip).alias("clipped"))
    pairs = sized.join(terms, "query_id").join(texts, "doc_id")
    share = F.size(F.array_intersect("q", tokens(F.col("clipped")))) / F.greatest(F.size("q"), F.lit(1)).cast("double")
    scored = pairs.withColumn("rerank_score", F.when(F.col("n") > top_k, F.round(share, 6)))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.col("rank"))
    return scored.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= top_k).select("query_id", F.col("new_rank").alias("rank"), "doc_id", "rerank_score", F.col("rank").alias("pool_rank"))


#: Items without an inner token that one automaton holds.
SHORT_ITEMS = 100_000


def with_paths(docs: DataFrame, *parts: str) -> DataFrame:
    """`docs` with the columns `parts` (path, file name) before the text, so that path tokens count in keyword search, once."""
    return docs.withColumn("text", F.concat_ws(" ", *parts, "text"))


def gold_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(`item_id`, `doc_id`) where the document's text contains the item's whole text.

    Not a comparison of all pairs: a text that contains an item has all its inner tokens, which are its CJK grams
    and the runs of letters and digits that touch neither end of it. The item's rarest inner token leads to the
    documents that hold it, and only those are compared. Items without any (in Cyrillic or Thai, say, where no
    token stands) go into automata over many patterns, SHORT_ITEMS in each, which read each text once. The empty item is in every
    text that is not null.
    """
    toks = tokenised(docs)
    kept = F.regexp_replace(F.regexp_replace("text", "^[a-zA-Z0-9]+", ""), "[a-zA-Z0-9]+$", "")
    sized = items.filter(F.col("text").isNotNull()).select("item_id", "text", F.array_distinct(tokens(kept)).alias("t"))
    inner = sized.filter(F.size("t") > 0).select("item_id", F.explode("t").alias("term"))
    posts = postings(toks, inner)
    counts = document_frequencies(posts)
    rarest = inner.join(counts, "term").groupBy("item_id").agg(F.min(F.struct("df", "term")).alias("best")).select("item_id", F.col("best.term").alias("term"))
    near = rarest.join(posts.select("term", "doc_id"), "term").select("item_id", "doc_id")
    texts = docs.select("doc_id", F.col("text").alias("doc_text"))
    found = near.join(items.select("item_id", "text"), "item_id").join(texts, "doc_id").filter(F.col("doc_text").contains(F.col("text"))).select("item_id", "doc_id")
    short = sized.filter(F.size("t") == 0).select("item_id", "text")
    blocks = -(-short.count() // SHORT_ITEMS)
    for number in range(blocks):
        block = short if blocks == 1 else short.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        found = found.unionByName(holding(texts, [(r.item_id, r.text) for r in block.collect()], found.schema["item_id"].dataType.simpleString()))  # about SHORT_ITEMS rows
    return found


def holding(texts: DataFrame, patterns: list[tuple], id_type: str) -> DataFrame:
    """(`item_id`, `doc_id`) of the patterns (id, text) that each text (`doc_id`, `doc_text`) contains, by an Aho-Corasick automaton."""
    spark = texts.sparkSession
    by_text: dict[str, list] = {}
    for item, text in patterns:
        by_text.setdefault(text, []).append(item)
    shared = spark.sparkContext.broadcast(by_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, items in shared.value.items():
            if text:
                automaton.add_word(text, items)
        automaton.make_automaton()
        everywhere = shared.value.get("", [])
        for batch in batches:
            rows, items = [], []
            for row, text in enumerate(batch.column("doc_text").to_pylist()):
                if text is None:
                    continue
                own = {id(found): found for _, found in automaton.iter(text)} if len(automaton) else {}
                for found in (*own.values(), everywhere):
                    items += found
                    rows += [row] * len(found)
            kinds = {"int": pa.int32(), "bigint": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(items, kinds.get(id_type, pa.string())), batch.column("doc_id").take(pa.array(rows, pa.int64()))], ["item_id", "doc_id"])

    return texts.mapInArrow(run, f"item_id {id_type}, doc_id {texts.schema['doc_id'].dataType.simpleString()}")
