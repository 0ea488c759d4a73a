"""Latent semantic vectors: TF-IDF, truncated SVD by a growing subspace, unit length.

The term side (vocabulary x rank) is bounded by the vocabulary limit and travels in broadcasts of COLUMNS columns;
documents stay distributed, and each pass sums blocks of terms up. A model is its vocabulary and its term vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import words
from noteweave.functions.text import text_or_empty
from noteweave.operators import ranking
from noteweave.operators.index import apart, postings, tokenised
from noteweave.operators.ranking import idf_table, weights
from noteweave.sources.tables import staged


def weighted(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """`doc_id`, `terms`, `weights`: the TF-IDF vector of each document; persist it if it is used again."""
    return folded(docs, idf_table(docs, most))


def folded(docs: DataFrame, idf: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as `weighted` has them, of texts that the model need not have seen: under the stored `idf` (`term`, `idf`) of its corpus."""
    rows, vocabulary = numbered(docs, idf, id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("numbers")
            terms = pa.ListArray.from_arrays(_offsets(lists), known.value.take(lists.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), terms, batch.column("weights")], ["doc_id", "terms", "weights"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, terms array<string>, weights array<double>")


def numbered(docs: DataFrame, idf: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, pa.Array]:
    """`doc_id`, `numbers`, `weights` of the documents that have a term of `idf`, and the terms that the numbers stand for.

    A document is folded within its row. Rows that share an id are one document, and only these are shuffled.
    """
    spark = docs.sparkSession
    table = idf.select("term", "idf").orderBy("term").toArrow()  # bounded by `most`
    vocabulary = table["term"].cast(pa.string()).combine_chunks()
    shared = spark.sparkContext.broadcast((vocabulary, table["idf"].to_numpy()))
    once, repeated = apart(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")))
    schema = f"doc_id {once.schema['doc_id'].dataType.simpleString()}, numbers array<int>, weights array<double>"

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scale = shared.value
        for batch in batches:
            for start, texts in words.slices(batch.column("text")):
                row, word, freq, own = words.counted(texts)
                number = pc.fill_null(pc.index_in(own.cast(pa.string()), value_set=names), -1).to_numpy()[word]
                known = number >= 0
                row, number = row[known], number[known]
                weight = (np.log(freq[known]) + 1.0) * scale[number]
                weight /= np.sqrt(np.bincount(row, weight * weight, len(texts)))[row]
                sizes = np.bincount(row, minlength=len(texts))
                here = np.flatnonzero(sizes)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[here])]), pa.int32())
                ids = batch.column("doc_id").take(pa.array(start + here))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(number, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(weight))], ["doc_id", "numbers", "weights"])

    def of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            numbers = pc.index_in(lists.flatten(), value_set=shared.value[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(_offsets(lists), numbers), batch.column("weights")], ["doc_id", "numbers", "weights"])

    rows = once.mapInArrow(of_texts, schema)
    if repeated is not None:
        cells = weights(postings(tokenised(repeated)), idf).groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight")).alias("cells"))
        rows = rows.unionByName(cells.select("doc_id", F.col("cells.term").alias("terms"), F.col("cells.weight").alias("weights")).mapInArrow(of_cells, schema))
    return rows, vocabulary


def _offsets(lists: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), pa.int32())


#: Components at most; columns that one pass takes along; terms of a block of sums; cells that are multiplied at a time.
RANK, COLUMNS, BLOCK, CELLS = 384, 132, 1024, 2048
#: Cells of a batch that are held at a time in numbers, rows and weights.
PART = 1 << 20
#: The residual, as a share of the largest eigenvalue, at which the rounds of `fit` end.
TOLERANCE = 1e-3
#: The setting by which a pass deletes its shuffle files when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Columns that the subspace of `fit` may grow to, in widths and at least, before the best vectors start a new one.
GROWTH, LEAST = 2, 256
#: Documents or terms with fewer cells than this in a batch are summed side by side.
FEW = 8


def _sums(out: np.ndarray, at: np.ndarray, of: np.ndarray, weight: np.ndarray, source: np.ndarray) -> None:
    """Add `weight * source[of]` to the rows `at` of `out`; `at` is sorted.

    Rows with many cells are products of a vector and gathered rows, a bounded number of these at a time; those with FEW go
    side by side.
    """
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    sizes, rows = np.diff(starts, append=len(at)), at[starts]
    held = np.empty((CELLS, source.shape[1]), source.dtype)
    many = np.flatnonzero(sizes >= FEW)
    for row, start, size in zip(rows[many].tolist(), starts[many].tolist(), sizes[many].tolist(), strict=True):
        for i in range(start, start + size, CELLS):
            stop = min(i + CELLS, start + size)
            out[row] += weight[i:stop] @ np.take(source, of[i:stop], axis=0, out=held[: stop - i], mode="clip")
    for size in range(1, FEW):
        some = np.flatnonzero(sizes == size)
        for i in range(0, len(some), CELLS):
            part = some[i : i + CELLS]
            total = out[rows[part]]
            for cell in range(size):
                x = np.take(source, of[starts[part] + cell], axis=0, out=held[: len(part)], mode="clip")
                x *= weight[starts[part] + cell][:, None]
                total += x
            out[rows[part]] = total


def _cells(batch: pa.RecordBatch, vocabulary: pa.Array | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row and number of rows of parts with about PART cells; row, term number and weight of each cell whose term is known, by rows.

    `vocabulary` is None if the rows have numbers.
    """
    column = "numbers" if vocabulary is None else "terms"
    ends, start = np.cumsum(batch.column(column).value_lengths().to_numpy(), dtype=np.int64), 0
    while start < batch.num_rows:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PART, side="right")))
        lists = batch.column(column).slice(start, stop - start)
        numbers = lists.flatten() if vocabulary is None else pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1)
        numbers, row = numbers.to_numpy(), np.repeat(np.arange(stop - start, dtype=np.int32), lists.value_lengths().to_numpy())
        weight = batch.column("weights").slice(start, stop - start).flatten().to_numpy().astype(np.float32)
        known = numbers >= 0
        yield start, stop - start, *((row, numbers, weight) if known.all() else (row[known], numbers[known], weight[known]))
        start = stop


def _projected(n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]), basis.dtype)
    _sums(out, row, term, weight, basis)
    return out


def _product(rows: DataFrame, vectors: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Transposed matrix times matrix times each of the `vectors`, COLUMNS at a time: each core sums what it reads, then blocks of terms are summed.

    `rows` have numbers. The factors have single precision, the sums of a core double.
    """
    out = np.empty_like(vectors, np.float32) if out is None else out
    for i in range(0, len(vectors), COLUMNS):
        out[i : i + COLUMNS] = _pass(rows, vectors[i : i + COLUMNS].T.astype(np.float32)).T
    return out


def _pass(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(basis))
    width = basis.shape[1]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.shape)
        for batch in batches:
            for _, n, row, term, weight in _cells(batch, None):
                part = _projected(n, row, term, weight, shared.value)
                order = np.argsort(term.astype(np.uint16) if len(total) <= 1 << 16 else term, kind="stable")
                _sums(total, term[order], row[order], weight[order], part)
        yield from blocks({i: total[i : i + BLOCK] for i in range(0, len(total), BLOCK)})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("b").to_pylist(), batch.column("x"), strict=True):
                part = np.frombuffer(x.as_buffer(), dtype=np.float32).reshape(-1, width)
                held[b] = held[b] + part if b in held else part.astype(np.float64)
        yield from blocks(held)

    def blocks(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b, x in found.items():
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["b", "x"])

    out = np.zeros_like(basis)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        part = rows.select("numbers", "weights").coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(local, "b long, x binary")
        for r in part.repartition("b").mapInArrow(summed, "b long, x binary").collect():  # as large as `basis`
            out[r.b : r.b + BLOCK] = np.frombuffer(r.x, dtype=np.float32).reshape(-1, width)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    shared.destroy()
    return out


def _with_numbers(rows: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """`numbers` and `weights` of rows with terms, staged."""
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, row, number, weight in _cells(batch, known.value):
                offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(number, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(weight))], ["numbers", "weights"])

    return staged(rows.mapInArrow(run, "numbers array<int>, weights array<float>"))


def fit(spark: SparkSession, rows: DataFrame, rank: int | None = None, rounds: int = 12, seed: int = 42, tolerance: float = TOLERANCE, vocabulary: pa.Array | None = None) -> tuple[pa.Array, np.ndarray]:
    """The vocabulary and the right singular vectors (terms x rank) of `weighted` rows, or of `numbered` ones with their vocabulary.

    `rank` is min(RANK, documents - 1, terms) unless given. The subspace begins with ten random columns more than that. Each round finds the
    best vectors within it and how far each is from being one of the matrix (the norm of
    what the squared matrix adds to a multiple of it, against the largest eigenvalue), and grows it by what is added, so that earlier products
    are kept (a block Krylov space). Beyond GROWTH times its width the best vectors begin a new one. The rounds end where the distance is at
    most `tolerance` for all `rank` vectors, or after `rounds` of them. Products have single precision: distances below 1e-6 are not told apart.
    """
    if vocabulary is None:
        names = [r.term for r in rows.select(F.explode("terms").alias("term")).distinct().collect()]  # bounded by `most`
        vocabulary = pa.array(sorted(names), pa.string())
        matrix = _with_numbers(rows, vocabulary)
    else:
        matrix = rows
    rank = max(1, min(RANK, rows.count() - 1, len(vocabulary))) if rank is None else rank
    width = min(rank + 10, max(1, len(vocabulary)))
    most = max(GROWTH * width, LEAST)
    new = _whitened(np.random.default_rng(seed).standard_normal((width, len(vocabulary)), np.float32))
    if not len(vocabulary):
        return vocabulary, new[:rank].T
    spanned, products = (np.empty((most, len(vocabulary)), np.float32) for _ in range(2))
    inner, size, turn = np.zeros((0, 0), np.float32), 0, np.eye(width, dtype=np.float32)
    for _ in range(rounds):
        size, before = size + len(new), size
        spanned[before:size] = new
        del new  # vectors are held once
        across = spanned[:size] @ _product(matrix, spanned[before:size], products[before:size]).T
        inner = np.block([[inner, across[:before]], [across[:before].T, across[before:]]])
        values, turn = np.linalg.eigh((inner + inner.T).astype(np.float64) / 2)
        values, turn = values[::-1][:width].astype(np.float32), np.ascontiguousarray(turn[:, ::-1][:, :width].T.astype(np.float32))
        beside = turn @ products[:size]
        _less(beside, turn * values[:, None], spanned[:size])
        if _lengths(beside[:rank]).max() <= tolerance * values[0]:
            break
        if size + width > most:
            for held in (spanned, products):
                _turned(held[:size], turn)
            inner, size, turn = np.diag(values), width, np.eye(width, dtype=np.float32)
        new = _beside(spanned[:size], beside)
        del beside
        if not len(new):  # the subspace is all that the matrix reaches from it
            break
    del products
    return vocabulary, np.ascontiguousarray((_turned(spanned[:size], turn[:rank]) if size else new[:rank]).T)


def _turned(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """`turn @ vectors`, which overwrites the first of them, some columns at a time."""
    for i in range(0, vectors.shape[1], 4096):
        vectors[: len(turn), i : i + 4096] = turn @ vectors[:, i : i + 4096]
    return vectors[: len(turn)]


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))  # without a copy


def _less(vectors: np.ndarray, turn: np.ndarray, spanned: np.ndarray) -> None:
    """Take `turn @ spanned` from the vectors, a few at a time."""
    for i in range(0, len(vectors), 64):
        vectors[i : i + 64] -= turn[i : i + 64] @ spanned


def _whitened(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal vectors with the same span, as far as single precision tells them apart; the argument is overwritten."""
    size, turn = np.linalg.eigh((vectors @ vectors.T).astype(np.float64))
    kept = size > 1e-6 * max(1.0, size[-1] if len(size) else 0.0)
    return _turned(vectors, (turn[:, kept] / np.sqrt(size[kept])).T.astype(np.float32))


def _beside(spanned: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthonormal vectors that span what `vectors` have beside the span of `spanned`; the argument is overwritten."""
    vectors /= np.maximum(_lengths(vectors), 1e-30)[:, None]
    for _ in range(3):
        _less(vectors, vectors @ spanned.T, spanned)
        vectors = _whitened(vectors)
    return vectors


def residuals(spark: SparkSession, rows: DataFrame, model: tuple[pa.Array, np.ndarray]) -> np.ndarray:
    """How far each vector of a model is from being a singular vector of `weighted` rows, as `fit` measures it."""
    matrix = rows if "numbers" in rows.columns else _with_numbers(rows, model[0])
    basis = np.linalg.qr(model[1].astype(np.float64))[0]
    product = _product(matrix, basis.T).T.astype(np.float64)
    inner = basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return np.linalg.norm(product @ turn - basis @ turn * values, axis=0) / max(values[0], 1e-300)


def search(spark: SparkSession, docs: DataFrame, queries: DataFrame, idf: DataFrame, model: tuple[pa.Array, np.ndarray], top_k: int = 10, keep: Column | None = None, vector_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Hybrid search with latent vectors: `query_id`, `rank`, `doc_id`, `fused_score`, `similarity`, `bm25`, and the `channel` that found it.

    Documents and queries are folded into the model; both channels go by the predicate `keep`. Queries without a known term have keyword
    hits only. Ids are whole numbers.
    """
    kept = docs if keep is None else docs.filter(keep)
    mine = transform(spark, *aligned(numbered(kept, idf), model))
    asked = transform(spark, *aligned(numbered(queries.withColumnRenamed("query_id", "doc_id"), idf, "doc_id", "query"), model))
    known = F.exists("embedding", lambda x: x != 0)
    vector = ranking.nearest(spark, mine.filter(known), asked.filter(known)).withColumnRenamed("vec_id", "doc_id")
    best = ranking.hits(ranking.fuse(vector, ranking.bm25(docs, queries, ranking.POOL, keep), vector_weight, keyword_weight), top_k)
    channel = F.when(F.col("kw_rank").isNull(), "vector").when(F.col("vec_rank").isNull(), "keyword").otherwise("both")
    return best.select("query_id", "rank", "doc_id", F.bround("fused", 5).alias("fused_score"), F.bround("similarity", 3).alias("similarity"), F.bround("bm25", 3).alias("bm25"), channel.alias("channel"))


def as_table(spark: SparkSession, model: tuple[pa.Array, np.ndarray]) -> DataFrame:
    """A model as rows of `term` and `vector`, to be written like any table."""
    cells = pa.table({"term": model[0], "vector": pa.array(list(model[1].astype(np.float64)), pa.list_(pa.float64()))})
    return spark.createDataFrame(cells)


def from_table(rows: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The model of such rows, as many as its vocabulary has terms."""
    found = rows.select("term", "vector").orderBy("term").toArrow()
    return pa.array(found["term"].to_pylist(), pa.string()), np.array(found["vector"].to_pylist()).reshape(found.num_rows, -1)


def aligned(numbered_rows: tuple[DataFrame, pa.Array], model: tuple[pa.Array, np.ndarray]) -> tuple[DataFrame, tuple[None, np.ndarray]]:
    """`numbered` rows and the model by their numbers; terms that it lacks have no part in it."""
    rows, vocabulary = numbered_rows
    if vocabulary.equals(model[0]):
        return rows, (None, model[1])
    at = pc.fill_null(pc.index_in(vocabulary, value_set=model[0]), -1).to_numpy()
    return rows, (None, np.where((at >= 0)[:, None], model[1][at], 0.0) if len(model[0]) else np.zeros((len(vocabulary), model[1].shape[1])))


def transform(spark: SparkSession, rows: DataFrame, model: tuple[pa.Array | None, np.ndarray]) -> DataFrame:
    """`vec_id` and `embedding` (unit length; a zero vector stays zero) of `weighted` rows, or of `aligned` ones."""
    shared = spark.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1], np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, v = shared.value
        for batch in batches:
            for start, n, row, number, weight in _cells(batch, names):
                x = _projected(n, row, number, weight, v)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.where(norm > 1e-6, x / np.maximum(norm, 1e-6), 0.0).astype(np.float32)  # less is noise
                offsets = pa.array(np.arange(n + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, n), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["vec_id", "embedding"])

    return rows.mapInArrow(run, "vec_id long, embedding array<float>")
