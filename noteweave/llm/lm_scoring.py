"""Cross-entropy difference scores from matched bigram models (Moore and Lewis's selection).

The target model is fitted on the labelled good documents and the background model on all documents. Both
share one vocabulary (every word of the corpus), order and smoothing, so their losses on a token can be
subtracted: a document's score is the mean of (target loss - background loss) over its tokens, low for documents like
the target. A model's probability of a word after another is (pairs + PRIOR / V) / (contexts + PRIOR), with V words in
the vocabulary: a Dirichlet prior, so each model sums to one, and a loss is a part for the context less one for the pair.

Every pair and every context of the corpus counts, however rare; there is no cut. Their number grows with the input,
so the counts never meet in one place:

1. One pass counts the vocabulary and finds the keys (pairs and contexts, by 63-bit hashes) with at least 1 / HEAVY of
   all entries, an entry being a key of a document. Such a key holds that share of some part of a task's
   entries, so tasks name candidates from their own counts; fewer than HEAVY pass.
2. The heavy keys are counted exactly, added up by slot, and broadcast with their losses.
3. The last pass scores heavy keys in place and sends all others, of which none is hot, to buckets of bounded size
   by hash, packed in arrays. A bucket counts its keys over the whole corpus and sends back what each document's sums
   lack, to the part of a task (a few thousand documents) that they came from, where the sums are completed.

Defined results: null and empty texts have no tokens and null scores; without any target document the
target model is uniform over the vocabulary; repeated rows count as often as they stand; several labels of
one document make it a target if one of them does; an empty table gives an empty result; further columns
are not read. Two keys with one 63-bit hash would share their counts. Rows must come in the same order if a task is
repeated, as those of a stored table do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from noteweave.llm.common import prepare, small_batches, stored

#: Weight of the uniform prior, in tokens.
PRIOR = 4.0
#: A key with 1 / HEAVY of all entries is broadcast; entries that a task holds at a time while it counts, and while it packs; entries in a bucket.
HEAVY, HELD, PACKED, BUCKET = 500_000, 1 << 22, 1 << 21, 1 << 22
#: Target ids are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_IDS = 2_000_000
#: Bytes of a word that is hashed beside the others, in arrays; counts whose losses are kept.
LONG, TABLE = 256, 1024

#: What str.split() cuts at, among bytes and beyond ASCII.
SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

START = np.uint64(xxh64_intdigest("", 17))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, `text.lower().split()`, one after the other, and the number of each text's.

    A hash mixes in a word's size and then eight bytes at a time, of all words together.
    """
    lowered = [text.lower() if text else "" for text in texts]
    encoded = [(x if x.isascii() else SPACES.sub(" ", x)).encode() for x in lowered]
    data = b"\n".join([b"", *encoded, b""])
    bounds = np.cumsum([1, *(len(x) + 1 for x in encoded)])
    n, padded = len(data), np.frombuffer(data + bytes(16 - len(data) % 8), np.uint64)
    space = SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    out = mixed(START + sizes.astype(np.uint64))
    for place in range(0, LONG, 8):
        some = np.flatnonzero((sizes > place) & (sizes <= LONG))
        if not len(some):
            break
        at, rest = starts[some] + place, np.minimum(sizes[some] - place, 8).astype(np.uint64)
        shift = (at & 7).astype(np.uint64) << np.uint64(3)
        eight = padded[at >> 3] >> shift | padded[(at >> 3) + 1] << (np.uint64(63) - shift) << np.uint64(1)
        eight &= ~np.uint64(0) >> (np.uint64(64) - (rest << np.uint64(3)))
        out[some] = mixed(out[some] * np.uint64(0x9E3779B97F4A7C15) + eight)
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]], 17)
    return out, np.diff(np.searchsorted(starts, bounds))


def entries(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different keys, even for contexts and odd for pairs, how often each occurs there, and the text's place."""
    ends = np.cumsum(sizes)
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[(ends - sizes)[sizes > 0]] = START
    context = mixed(before)
    pair = mixed(context * np.uint64(0x9E3779B97F4A7C15) + found)
    keys, texts = np.empty(2 * len(found), np.int64), np.repeat(np.arange(len(sizes)), 2 * sizes)
    keys[::2], keys[1::2] = (context & ~np.uint64(1)).view(np.int64), (pair | np.uint64(1)).view(np.int64)
    for start, stop in zip((2 * (ends - sizes)).tolist(), (2 * ends).tolist(), strict=True):
        keys[start:stop].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))), texts[at]


def losses(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """What an occurrence of each key adds to a text's loss."""
    return np.where(keys & 1, -np.log(counts + PRIOR / size), np.log(counts + PRIOR))


def gathered(rows: DataFrame) -> DataFrame:
    """`kind`, `k`, `n`: 0 the vocabulary's words; 1 keys that may be heavy, with counted entries; 2 the number of entries."""

    share, limit = HEAVY, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            may = n * share >= held
            found = ((0, np.unique(np.concatenate(seen)).view(np.int64), None), (1, keys[may], n[may]), (2, np.zeros(1, np.int64), np.array([held])))
            for kind, k, count in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(np.zeros(len(k), np.int64) if count is None else count)], ["kind", "k", "n"])

        for batch in small_batches(batches, "t"):
            found, sizes = words(batch.column("t").to_pylist())
            parts.append(entries(found, sizes)[0])
            seen.append(found)
            held += len(parts[-1])
            if held > limit:
                yield from out()
                parts, seen, held = [], [], 0
        if held:
            yield from out()

    return stored(rows.select("t").mapInArrow(run, "kind byte, k long, n long").groupBy("kind", "k").agg(F.sum("n").alias("n")))


def heavy_counts(rows: DataFrame, shared) -> DataFrame:
    """`slot`, `target` and `background`: exact occurrences of the heavy keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        counts = np.zeros((2, len(heavy)), np.int64)
        for batch in small_batches(batches, "t"):
            keys, n, text = entries(*words(batch.column("t").to_pylist()))
            slot, hit = placed(keys, heavy)
            good = hit & batch.column("target").to_numpy(zero_copy_only=False)[text]
            np.add.at(counts[1], slot[hit], n[hit])
            np.add.at(counts[0], slot[good], n[good])
        some = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["slot", "target", "background"])

    counted = rows.select("t", "target").mapInArrow(run, "slot long, target long, background long")
    return counted.groupBy("slot").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def placed(keys: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's slot among the sorted heavy ones, and whether it is there."""
    if not len(heavy):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    slot = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
    return slot, heavy[slot] == keys


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return pa.chunked_array([c.flatten() for c in table.column(name).chunks]).to_numpy() if table.num_rows else np.zeros(0)


def packed(rows: DataFrame, kind: str, shared, size: int, buckets: int) -> DataFrame:
    """The other keys by bucket, in arrays, one row for each bucket and part of a task.

    `part` numbers the part and `doc` a document in it. One row of each part brings its documents' ids, token numbers
    and sums, in which keys that are not heavy count as if no other document had them.
    """
    id_type, limit = to_arrow_type(rows.schema["i"].dataType), PACKED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, values = shared.value
        known = [losses(np.full(TABLE, odd), np.arange(TABLE), size) for odd in (0, 1)]
        number, ids, docs, held, standing = 0, [], [], 0, 0

        def out() -> pa.RecordBatch:
            part = (TaskContext.get().partitionId() << 32) + number
            keys, n, doc, good, base = (np.concatenate([d[c] for d in docs]) for c in range(5))
            bucket = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, n, doc, good, bucket = (x[order] for x in (keys, n, doc, good, bucket))
            names = np.union1d(np.unique(bucket), [number % buckets])
            ends = np.searchsorted(bucket, names, side="right")
            bears = names == number % buckets
            own = np.cumsum(np.where(bears, len(base), 0))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], own]).astype(np.int32)), pa.concat_arrays(ids))
            columns = [pa.array(names), pa.array(np.full(len(names), part)), _lists(keys, ends), _lists(n, ends), _lists(doc, ends), _lists(good, ends), listed]
            columns += [_lists(base[:, c], own) for c in range(3)]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "part", "k", "n", "doc", "good", "ids", "tokens", "st", "sb"])

        for batch in small_batches(batches, "t"):
            ids.append(batch.column("i").cast(id_type))
            found, sizes = words(batch.column("t").to_pylist())
            keys, n, text = entries(found, sizes)
            slot, hit = placed(keys, heavy)
            mark = batch.column("target").to_numpy(zero_copy_only=False)[text]
            rare, heavy_n, heavy_slot = ~hit, n[hit], slot[hit]
            keys, times, own, good = keys[rare], n[rare], text[rare], mark[rare]
            base = [sizes]
            for m in (0, 1):
                counts = times * good if m == 0 else times
                lost = np.where(keys & 1, known[1][np.minimum(counts, TABLE - 1)], known[0][np.minimum(counts, TABLE - 1)])
                many = counts >= TABLE
                lost[many] = losses(keys[many], counts[many], size)
                base.append(np.bincount(text[hit], heavy_n * values[heavy_slot, m], len(sizes)) + np.bincount(own, times * lost, len(sizes)))
            docs.append((keys, times.astype(np.int32), (own + standing).astype(np.int32), good, np.stack(base, axis=1)))
            held, standing = held + len(keys), standing + len(sizes)
            if held > limit:
                yield out()
                ids, docs, held, standing, number = [], [], 0, 0, number + 1
        if docs:
            yield out()

    schema = f"bucket long, part long, k array<long>, n array<int>, doc array<int>, good array<boolean>, ids array<{kind}>, tokens array<double>, st array<double>, sb array<double>"
    return rows.mapInArrow(run, schema)


def completed(parts: DataFrame, kind: str, size: int) -> DataFrame:
    """`i`, `n_tokens`, `target_loss` and `background_loss`: each bucket's keys counted, each part's sums completed."""

    def lacking(table: pa.Table) -> pa.Table:
        keys, n, doc, good = (_flat(table, c) for c in ("k", "n", "doc", "good"))
        sizes = np.concatenate([c.value_lengths().to_numpy() for c in table.column("k").chunks])
        row = np.repeat(np.arange(table.num_rows), sizes)
        different, where = np.unique(keys, return_inverse=True)
        both = np.stack([np.bincount(where, weights=n * good, minlength=len(different)), np.bincount(where, weights=n, minlength=len(different))])
        others = both[1][where] > n
        where, n, doc, good, row, key = where[others], n[others], doc[others], good[others], row[others], keys[others]
        more = [n * (losses(key, both[m][where], size) - losses(key, n * good if m == 0 else n, size)) for m in (0, 1)]
        # The rows of a part stand together, and so do those of a document.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        sums = [np.add.reduceat(x, at) if len(at) else np.zeros(0) for x in more]
        ends = np.searchsorted(row[at], np.arange(table.num_rows), side="right")
        out = [table.column("part"), _lists(doc[at].astype(np.int32), ends), _lists(sums[0], ends), _lists(sums[1], ends), *(table.column(c) for c in ("ids", "tokens", "st", "sb"))]
        return pa.table(out, names=["part", "doc", "dt", "db", "ids", "tokens", "st", "sb"])

    def finished(table: pa.Table) -> pa.Table:
        n, st, sb = (_flat(table, c) for c in ("tokens", "st", "sb"))
        doc = _flat(table, "doc").astype(np.int64)
        lost = [np.where(n > 0, (s + np.bincount(doc, weights=_flat(table, d), minlength=len(n))) / np.maximum(n, 1), np.nan) for s, d in ((st, "dt"), (sb, "db"))]
        ids = pa.chunked_array([c.flatten() for c in table.column("ids").chunks])
        return pa.table([ids, pa.array(n.astype(np.int64)), *(pa.array(x, from_pandas=True) for x in lost)], names=["i", "n_tokens", "target_loss", "background_loss"])

    lacked = parts.groupBy("bucket").applyInArrow(lacking, f"part long, doc array<int>, dt array<double>, db array<double>, ids array<{kind}>, tokens array<double>, st array<double>, sb array<double>")
    return lacked.groupBy("part").applyInArrow(finished, f"i {kind}, n_tokens long, target_loss double, background_loss double")


def score(spark: SparkSession, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `n_tokens`, `target_loss`, `background_loss` and `score` (their difference) for each row.

    `targets` holds the ids of the target documents in `id_col`.
    """
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    facts = gathered(rows)
    size, total = facts.agg(F.count_if(F.col("kind") == 0), F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0))).first()
    found = facts.filter((F.col("kind") == 1) & (F.col("n") * HEAVY >= total)).select("k").toArrow()  # HEAVY at most
    heavy = np.sort(found.column("k").to_numpy())
    good = targets.select(F.col(id_col).alias("i")).filter("i is not null").distinct().withColumn("good", F.lit(True))
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(good) if few else good, "i", "left").select("i", "t", F.col("good").isNotNull().alias("target"))
    marked = marked if few else stored(marked)  # a shuffle's rows may come in another order
    counted = heavy_counts(marked, spark.sparkContext.broadcast(heavy)).toArrow()  # HEAVY at most
    counts, size = np.zeros((len(heavy), 2)), max(1, size)
    counts[counted.column("slot").to_numpy()] = np.stack([counted.column(c).to_numpy() for c in ("target", "background")], axis=1)
    values = np.stack([losses(heavy, counts[:, m], size) for m in (0, 1)], axis=1)
    parts = packed(marked, kind, spark.sparkContext.broadcast((heavy, values)), size, -(-total // BUCKET) or 1)
    out = completed(parts, kind, size)
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("i", id_col)
