"""Rankings over an inverted index in shards.

A shard holds SHARD documents at most (or TOKENS tokens): one row with their ids, lengths and norms, and one row for each
term with the places of the documents that have it and their frequencies. Shards are made where the texts are read, so
texts are never shuffled. A ranking takes the lists of its queries' terms to their shards, scores a document there
completely, and passes on the k best of each query and shard only.

Documents without tokens count in the statistics. Ids are taken as unique: of a repeated id each row is scored on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import words
from noteweave.functions.text import text_or_empty, tokens
from noteweave.operators.index import query_terms, ranked
from noteweave.sources.tables import staged

#: Documents and tokens of a shard; queries that one pass takes along; terms that go into a filter by value.
SHARD, TOKENS, QUERY_BLOCK, LITERAL = 16_384, 4_000_000, 2048, 2000
#: Saturation and length normalisation of BM25 (fixed values).
K1, B = 1.5, 0.75

def pack(counts: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """Shards of `doc_id`, `kept`, `terms` and `freqs` (null: once each); lists of the `wanted` terms only, if given.

    A document is one row. The rows of a shard have `kind` shards (ids, lengths, norms, kept) or lists (term, slots, freqs).
    """
    spark = counts.sparkSession
    shared = None if wanted is None else spark.sparkContext.broadcast(pa.array(sorted(wanted), pa.string()))

    def shard(name: str, table: pa.Table, out_types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
        ids, terms = table.column("doc_id").combine_chunks(), table.column("terms").combine_chunks()
        n = len(ids)
        sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        slot = np.repeat(np.arange(n), sizes)
        times = np.concatenate([np.ones(0, np.int64), *(np.ones(s, np.int64) if f is None else np.array(f, np.int64) for f, s in zip(table.column("freqs").to_pylist(), sizes.tolist()))]) if table.column("freqs").null_count < n else np.ones(len(slot), np.int64)
        words = coded.dictionary
        place = np.empty(len(words), np.int64)
        order = pc.sort_indices(words).to_numpy()
        place[order] = np.arange(len(words))  # lists come in the order of their terms
        key = place[coded.indices.to_numpy()] * n + slot
        values, inverse = np.unique(key, return_inverse=True)
        freq = np.bincount(inverse, times, len(values)).astype(np.int64)
        term, at = values // max(n, 1), values % max(n, 1)
        lengths = np.bincount(at, freq, n).astype(np.int32)
        norms = np.sqrt(np.bincount(at, (np.log(freq) + 1.0) ** 2, n))
        names = words.take(pa.array(order))
        asked = np.flatnonzero(pc.is_in(names, value_set=shared.value).to_numpy(zero_copy_only=False)) if shared is not None else np.arange(len(names))
        yield from _shard_rows(name, ids, table.column("kept").combine_chunks(), lengths, norms, names, asked, term, at, freq, out_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs = size = number = 0
        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = types or _types(batch)
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                stop = int(min(start + SHARD - docs, max(start + 1, np.searchsorted(sizes, base + TOKENS - size, side="right")), batch.num_rows))
                held.append(batch.slice(start, stop - start))
                docs, size, start = docs + stop - start, size + int(sizes[stop - 1] - base), stop
                if docs >= SHARD or size >= TOKENS:
                    yield from shard(f"{TaskContext.get().partitionId()}-{number}", pa.Table.from_batches(held), types)
                    held, docs, size, number = [], 0, 0, number + 1
        if held:
            yield from shard(f"{TaskContext.get().partitionId()}-{number}", pa.Table.from_batches(held), types)

    return counts.select("doc_id", "kept", "terms", "freqs").mapInArrow(run, _schema(counts))


def _schema(rows: DataFrame) -> str:
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return f"kind string, shard string, term string, slots array<int>, freqs array<int>, ids array<{id_type}>, lengths array<int>, norms array<double>, kept array<boolean>"


def _types(batch: pa.RecordBatch) -> dict[str, pa.DataType]:
    text, ints = pa.string(), pa.list_(pa.int32())
    return {"kind": text, "shard": text, "term": text, "slots": ints, "freqs": ints, "ids": pa.list_(batch.schema.field("doc_id").type), "lengths": ints, "norms": pa.list_(pa.float64()), "kept": pa.list_(pa.bool_())}


def _shard_rows(name: str, ids: pa.Array, kept: pa.Array, lengths: np.ndarray, norms: np.ndarray, names: pa.Array, asked: np.ndarray, term: np.ndarray, at: np.ndarray, freq: np.ndarray, out_types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard, with the lists of the `asked` of its `names`; cells are sorted by `term`, then place."""
    n = len(ids)
    empty = {c: pa.nulls(1, t) for c, t in out_types.items()}
    one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(values) if not isinstance(values, pa.Array) else values).cast(t)
    row = empty | {"kind": pa.array(["shards"]), "shard": pa.array([name]), "ids": one(ids, out_types["ids"]), "lengths": one(lengths, out_types["lengths"]), "norms": one(norms, out_types["norms"]), "kept": one(kept, out_types["kept"])}
    yield pa.RecordBatch.from_arrays([row[c] for c in out_types], list(out_types))
    starts = np.searchsorted(term, np.arange(len(names) + 1))
    for cut in range(0, len(asked), 20_000):
        some = asked[cut : cut + 20_000]
        many = starts[some + 1] - starts[some]
        take = np.repeat(starts[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
        offsets = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
        lists = {c: pa.ListArray.from_arrays(offsets, pa.array(x[take], pa.int32())).cast(out_types[c]) for c, x in (("slots", at), ("freqs", freq))}
        part = {c: pa.nulls(len(some), t) for c, t in out_types.items()} | {"kind": pa.array(["lists"] * len(some)), "shard": pa.array([name] * len(some)), "term": names.take(pa.array(some)).cast(pa.string())} | lists
        yield pa.RecordBatch.from_arrays([part[c] for c in out_types], list(out_types))


def pack_texts(docs: DataFrame, wanted: set[str], keep: Column | None = None) -> DataFrame:
    """Shards as `pack` makes them of `of_texts`, with lists of the `wanted` terms only; texts are cut in arrays, other terms are never held."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(sorted(wanted), pa.string()))
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs = size = number = 0
        types: dict[str, pa.DataType] = {}

        def shard() -> Iterator[pa.RecordBatch]:
            ids, kept = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
            lengths, norms, term, at, freq = (np.concatenate([x[i] for x in held]) for i in range(2, 7))
            order = np.lexsort((at, term))
            term = term[order]
            yield from _shard_rows(f"{TaskContext.get().partitionId()}-{number}", ids, kept, lengths.astype(np.int32), norms, shared.value, np.unique(term), term, at[order], freq[order], types)

        for batch in batches:
            types = types or _types(batch)
            for first, texts in words.slices(batch.column("text")):
                row, word, freq, own = words.counted(texts)
                lengths = np.bincount(row, freq, len(texts)).astype(np.int64)
                norms = np.sqrt(np.bincount(row, (np.log(freq) + 1.0) ** 2, len(texts)))
                term = pc.fill_null(pc.index_in(own.cast(pa.string()), value_set=shared.value), -1).to_numpy()[word]
                row, term, freq = row[term >= 0], term[term >= 0].astype(np.int64), freq[term >= 0]
                sizes, start = np.cumsum(lengths), 0
                while start < len(texts):
                    base = int(sizes[start - 1]) if start else 0
                    stop = int(min(start + SHARD - docs, max(start + 1, np.searchsorted(sizes, base + TOKENS - size, side="right")), len(texts)))
                    a, b = np.searchsorted(row, [start, stop])
                    held.append((batch.column("doc_id").slice(first + start, stop - start), batch.column("kept").slice(first + start, stop - start), lengths[start:stop], norms[start:stop], term[a:b], row[a:b] - start + docs, freq[a:b]))
                    docs, size, start = docs + stop - start, size + int(sizes[stop - 1]) - base, stop
                    if docs >= SHARD or size >= TOKENS:
                        yield from shard()
                        held, docs, size, number = [], 0, 0, number + 1
        if held:
            yield from shard()

    rows = docs.select("doc_id", kept.alias("kept"), text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(run, _schema(rows))


def of_texts(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """What `pack` reads, of documents with `doc_id` and `text`; `keep` says which of them a ranking may return."""
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    return docs.select("doc_id", kept.alias("kept"), tokens(F.col("text")).alias("terms"), F.lit(None).cast("array<int>").alias("freqs"))


class Shards:
    """Shards that a ranking can read: lists, shards (with `dead` and `allowed` ids, or null), and the number and mean length of documents."""

    def __init__(self, rows: DataFrame, removed: DataFrame | None = None, allowed: DataFrame | None = None, stats: tuple[int, int] | None = None):
        rows = rows if "segment" in rows.columns else rows.withColumn("segment", F.lit(""))
        self.spark = rows.sparkSession
        self.lists = rows.filter("kind = 'lists'").select("segment", "shard", "term", "slots", "freqs")
        own = rows.filter("kind = 'shards'").select("segment", "shard", "ids", "lengths", "norms", "kept")
        self.id_type = own.schema["ids"].dataType.elementType.simpleString()
        self.removed = removed
        for name, ids in (("dead", removed), ("allowed", allowed)):
            if ids is None:
                own = own.withColumn(name, F.lit(None).cast(f"array<{self.id_type}>"))
            else:
                own = own.join(ids.groupBy("segment", "shard").agg(F.collect_list("doc_id").alias(name)), ["segment", "shard"], "left")
        # A predicate that no document of a shard meets leaves none of them.
        self.shards = own if allowed is None else own.withColumn("allowed", F.coalesce("allowed", F.array().cast(f"array<{self.id_type}>")))
        if stats is None:
            found = own.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
            stats = (found[0] or 0, found[1] or 0)
        self.n, self.avgdl = stats[0], stats[1] / stats[0] if stats[0] else 0.0

    def own(self) -> DataFrame:
        """The shards with other names for their keys (`of`, `at`), to be taken together with their lists."""
        return self.shards.select(F.col("segment").alias("of"), F.col("shard").alias("at"), *(c for c in self.shards.columns if c not in ("segment", "shard")))

    def frequencies(self, lists: DataFrame) -> DataFrame:
        """`term`, `df` of these lists, removed documents left out."""
        if self.removed is None:
            return lists.groupBy("term").agg(F.sum(F.size("slots")).alias("df"))
        places = self.shards.filter("dead is not null").select("segment", "shard", F.filter(F.transform("ids", lambda x, i: F.when(F.array_contains("dead", x), i)), lambda i: i.isNotNull()).alias("gone"))
        left = lists.join(places, ["segment", "shard"], "left")
        live = F.size("slots") - F.coalesce(F.size(F.array_intersect("slots", F.coalesce("gone", F.array().cast("array<int>")))), F.lit(0))
        return left.groupBy("term").agg(F.sum(live).alias("df"))


def rank(index: Shards, queries: DataFrame, k: int, channels: tuple[str, ...] = ("keyword",)) -> DataFrame:
    """`channel`, `query_id`, `rank`, `doc_id`, `score`: the k best documents of each query in each channel.

    `keyword` is BM25, `vector` the cosine of log-frequency vectors and binary query vectors; only scores above 0 are ranked. Queries
    go in blocks of QUERY_BLOCK, whose terms a pass takes along.
    """
    spark = index.spark
    asked = query_terms(queries).groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    passes = max(1, -(-asked.count() // QUERY_BLOCK))
    id_types = index.id_type, queries.schema["query_id"].dataType.simpleString()
    found = None
    for number in range(passes):
        block = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number)
        held = [(r.query_id, r.terms) for r in block.collect()]  # about QUERY_BLOCK rows
        part = _rank_block(index, held, k, channels, id_types)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k, by=["channel", "query_id"]).select("channel", "query_id", "rank", "doc_id", "score")


def _rank_block(index: Shards, held: list[tuple], k: int, channels: tuple[str, ...], id_types: tuple[str, str]) -> DataFrame:
    spark, n, avgdl = index.spark, index.n, index.avgdl or 1.0
    terms = sorted({t for _, own in held for t in own})
    if len(terms) <= LITERAL:  # the filter reaches the scan
        lists = index.lists.filter(F.col("term").isin(terms)) if terms else index.lists.limit(0)
    else:
        lists = index.lists.join(F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")  # of QUERY_BLOCK queries
    weight = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lists = lists.join(F.broadcast(index.frequencies(lists).select("term", weight.alias("idf"))), "term")
    shared = spark.sparkContext.broadcast(held)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids_type = right.schema.field("ids").type.value_type
        query_out, channel_out, doc_out, score_out = [], [], [], []
        if left.num_rows and right.num_rows:
            own = {c: right.column(c).combine_chunks() for c in right.column_names}
            ids, lengths, norms = own["ids"].flatten(), own["lengths"].flatten().to_numpy(), own["norms"].flatten().to_numpy()
            open_ = own["kept"].flatten().to_numpy(zero_copy_only=False).astype(bool)
            if own["dead"].null_count == 0:
                open_ = open_ & ~pc.is_in(ids, value_set=own["dead"].flatten()).to_numpy(zero_copy_only=False)
            if own["allowed"].null_count == 0:
                open_ = open_ & pc.is_in(ids, value_set=own["allowed"].flatten()).to_numpy(zero_copy_only=False)
            slots, freqs = left.column("slots").combine_chunks(), left.column("freqs").combine_chunks()
            offsets, places, times = slots.offsets.to_numpy(), slots.values.to_numpy(), freqs.values.to_numpy().astype(np.float64)
            idf = np.repeat(left.column("idf").to_numpy(), np.diff(offsets))
            places, times = places[offsets[0] : offsets[-1]], times[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            long = np.maximum(lengths[places], 1) / avgdl
            parts = {"keyword": idf * times * (K1 + 1) / (times + K1 * (1 - B + B * long)), "vector": (np.log(times) + 1.0) / norms[places]}
            number = {t: i for i, t in enumerate(left.column("term").to_pylist())}
            order = None
            for query, wanted in shared.value:
                here = [number[t] for t in wanted if t in number]
                if not here:
                    continue
                for channel in channels:
                    sums = np.zeros(len(lengths))
                    for i in here:
                        span = slice(offsets[i], offsets[i + 1])
                        sums[places[span]] += parts[channel][span]
                    if channel == "vector":
                        sums /= math.sqrt(len(wanted))
                    sums = np.round(np.where(open_, sums, 0.0), 6)
                    pick = np.flatnonzero(sums > 0)
                    if len(pick) > k:
                        pick = pick[sums[pick] >= np.partition(sums[pick], -k)[-k]]
                    if order is None:  # places in the order of ids
                        order = np.empty(len(lengths), np.int64)
                        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(lengths))
                    best = pick[np.lexsort((order[pick], -sums[pick]))[:k]]
                    query_out += [query] * len(best)
                    channel_out += [channel] * len(best)
                    doc_out.append(ids.take(pa.array(best)))
                    score_out.append(sums[best])
        kinds = {"int": pa.int32(), "bigint": pa.int64()}
        columns = [pa.array(channel_out, pa.string()), pa.array(query_out, kinds.get(id_types[1], pa.string())), pa.chunked_array(doc_out, ids_type), pa.array(np.concatenate(score_out) if score_out else np.zeros(0))]
        return pa.Table.from_arrays(columns, ["channel", "query_id", "doc_id", "score"])

    schema = f"channel string, query_id {id_types[1]}, doc_id {id_types[0]}, score double"
    return lists.groupBy("segment", "shard").cogroup(index.own().groupBy("of", "at")).applyInArrow(score, schema)


def shards_of_texts(docs: DataFrame, queries: DataFrame, keep: Column | None = None) -> Shards:
    """Shards of `docs` for these queries: one pass over the texts, and lists of the queries' terms only, staged for the rankings.

    With more than QUERY_BLOCK queries all lists are kept, as the passes need other ones.
    """
    asked = query_terms(queries).select("term").distinct()
    wanted = {r.term for r in asked.collect()} if queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK else None
    return Shards(staged(pack(of_texts(docs, keep)) if wanted is None else pack_texts(docs, wanted, keep)))
