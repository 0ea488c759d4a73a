"""Benchmark decontamination: documents that hold a benchmark item, exactly or within few word edits.

Items and documents are word sequences (lower case runs of letters and digits; in scripts that are written
without spaces each letter is a word). A document leaks an item if some passage of it is within edit distance floor(0.2 * words of the item), a similarity of 0.8; items of fewer than five
words allow no edit and match exact occurrences.

Search goes by CGK random-walk embedding. A walk with shared random bits reads a sequence and, at each
step, puts out the word it stands on and moves on or not as the word's bit for that step says; small edit
distances become small Hamming distances. Bit-sampling LSH then takes a few steps of the output as a key; REPEATS
independent walks and samples from either end of a window, their number set by the wanted recall, put each item in
2 * REPEATS buckets, and the item-sized windows of a text look their own buckets up. What stands in them is
verified by the exact edit distance between the item and the best passage around the windows. A walk reaches about half of
STEPS words, so items of more than PIECE words are cut into equal pieces with walks of their own from either end of each: of
an item's edits some piece has no more than its own share, wherever they stand, and that piece's windows lead to the
item. Steps are sampled only while a walk still stands on a word (a step moves on by one word at most), so that keys speak of words alone.

Windows need not be embedded where no leak can be: of an item's n - q + 1 runs of q words, e edits
spoil q * e at most, so a passage with e edits holds the others unchanged. Items are grouped by size, and for each
group only windows whose surroundings hold as many runs of any of its items as that (q is chosen so that it is one
at least) are embedded. No leak is lost by it, and which item a window resembles is left to the buckets.

Items go to the workers in blocks of about BLOCK characters, one pass over the documents for each block, so
what is broadcast is bounded; documents are never shuffled, only hits are.

Defined results: null or empty texts and items have no words and never match; repeated items each match under their own id, which may be
null, and repeated rows each give their hits; ties between passages go to the first; the window is as long as the item and ends where its passage does; an empty table on either side gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.common import positional, prepare, small_batches

#: Edits allowed for each word of an item; characters of items in a block.
SHARE, BLOCK = 0.2, 8_000_000
#: Steps in a key; walks from either end; longest walk; longest piece of an item; growth of the pieces' size from group to group.
SAMPLED, REPEATS, STEPS, PIECE, GROWTH = 3, 32, 64, 128, 1.2

#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
WORDS = re.compile(rf"[^\W_{UNSPACED}]+|[^\W_]").findall


def words(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


def allowed(n: int) -> int:
    return int(SHARE * n)


def passage_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The smallest edit distance between the item and any passage of the region, and where it ends."""
    row = np.zeros(len(region) + 1, np.int64)  # a passage may start anywhere
    steps = np.arange(len(region) + 1)
    for i, word in enumerate(item.tolist(), 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - steps) + steps  # insertions
    end = int(row.argmin())
    return int(row[end]), end


def codes(numbers: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of q words; 0 where a word is unknown."""
    n = len(numbers) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, whole = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(q):
        part = numbers[i : i + n]
        out = (out * 1_000_003 + part) & ((1 << 62) - 1)
        whole &= part > 0
    return np.where(whole, out, 0)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Group:
    """Pieces (by number) of about one size: their runs, and their LSH buckets from either end."""

    def __init__(self, size: int, q: int, members: list[tuple[int, np.ndarray]], seed: int):
        self.q, self.seed, self.steps = q, seed, min(size, STEPS)
        lengths = [len(item) for _, item in members]
        self.sizes = {k: len(item) for k, item in members}
        self.longest, self.reach = max(lengths), allowed(max(lengths))
        self.need = min(max(1, n - q + 1 - q * allowed(n)) for n in lengths)
        self.runs = np.unique(np.concatenate([codes(item, q) for _, item in members]))
        self.samples = np.sort(np.random.default_rng([seed, size]).integers(0, self.steps, (2, REPEATS, SAMPLED)), axis=2)
        self.buckets = []
        for end in (0, 1):
            keys = np.concatenate([self.item_keys([item[:: -1 if end else 1] for _, item in members[cut : cut + 1000]], end) for cut in range(0, len(members), 1000)])
            owners = np.repeat(np.array([k for k, _ in members]), REPEATS)
            order = np.argsort(keys, kind="stable")
            self.buckets.append((keys[order], owners[order]))

    def keys(self, numbers: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """(windows, REPEATS) keys of the windows at `starts` (0: a word of no item, or beyond the text)."""
        padded = np.concatenate([numbers, np.zeros(self.steps, numbers.dtype)])
        different, place = np.unique(padded, return_inverse=True)
        walks = np.arange(REPEATS, dtype=np.uint64)
        out = np.tile(np.arange(1, REPEATS + 1, dtype=np.int64), (len(starts), 1))
        stands = np.repeat(starts[:, None], REPEATS, axis=1)
        words = different.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for step in range(int(self.samples[end].max()) + 1):
            here = place[stands]
            taken = np.flatnonzero((self.samples[end] == step).any(axis=1))
            if len(taken):
                out[:, taken] = (out[:, taken] * 1_000_003 + different[here[:, taken]] + 1) & ((1 << 62) - 1)
            bits = splitmix(words + np.uint64((self.seed << 40) + (end << 32) + step))
            stands += (bits[here] >> walks & np.uint64(1)).astype(np.int64)
        return out

    def item_keys(self, items: list[np.ndarray], end: int) -> np.ndarray:
        """The items' keys, one after the other; walks are no longer than an item, so they stay in their own."""
        starts = np.cumsum([0, *(len(x) for x in items[:-1])])
        return self.keys(np.concatenate(items), starts, end).ravel()

    def windows(self, known: np.ndarray) -> np.ndarray:
        """Starts of the windows that may hold a leak; `known` marks the places where a run of the group begins."""
        total = np.concatenate([[0], np.cumsum(known)])
        starts = np.arange(len(known))
        low, high = np.maximum(starts - self.reach, 0), np.minimum(starts + self.longest + self.reach, len(known))
        return np.flatnonzero(total[high] - total[low] >= self.need)

    def candidates(self, numbers: np.ndarray, places: np.ndarray, values: np.ndarray) -> dict[int, set[int]]:
        """For each piece that shares a bucket with a window of the text, where such windows start.

        `places` and `values` are the text's runs of q words that some item has.
        """
        out: dict[int, set[int]] = defaultdict(set)
        own = places[self.runs[np.minimum(np.searchsorted(self.runs, values), len(self.runs) - 1)] == values]
        if len(own) < self.need:
            return out
        known = np.zeros(len(numbers) - self.q + 1, bool)
        known[own] = True
        rest = np.zeros(self.q - 1, bool)
        for end, (keys, owners) in enumerate(self.buckets):
            # From the other end a text is read backwards, and so are its runs.
            read = numbers[::-1] if end else numbers
            starts = self.windows(np.concatenate([known[::-1] if end else known, rest]))
            for cut in range(0, len(starts), 2048):
                some = starts[cut : cut + 2048]
                found = self.keys(read, some, end).ravel()
                first, last = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
                for at in np.flatnonzero(first < last).tolist():
                    start = int(some[at // REPEATS])
                    for owner in set(owners[first[at] : last[at]].tolist()):
                        out[owner].add(len(numbers) - start - self.sizes[owner] if end else start)
        return out


class Index:
    """A block of items: their words' numbers, groups of pieces by size, and the items too short for an edit."""

    def __init__(self, items: list[tuple[int | None, list[str]]], seed: int = 11):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        self.pieces: list[tuple[int, int]] = []  # item and place of the first word
        for item_id, found in items:
            if found:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
        grouped, whole = defaultdict(list), defaultdict(list)
        for k, item in enumerate(self.items):
            n, e = len(item), allowed(len(item))
            if e:
                borders = np.linspace(0, n, -(-n // PIECE) + 1).astype(int).tolist()
                for start, stop in zip(borders, borders[1:]):
                    own, size = stop - start, 5
                    while max(size + 1, int(size * GROWTH)) <= own:
                        size = max(size + 1, int(size * GROWTH))
                    grouped[size, min(4, own // (allowed(own) + 1))].append((len(self.pieces), item[start:stop]))
                    self.pieces.append((k, start))
            else:
                whole[n].append((int(codes(item, n)[0]), k))
        self.groups = [Group(size, q, members, seed) for (size, q), members in sorted(grouped.items())]
        self.runs = {q: np.unique(np.concatenate([g.runs for g in self.groups if g.q == q])) for q in {g.q for g in self.groups}}
        self.whole = {n: (np.array([c for c, _ in sorted(found)]), np.array([k for _, k in sorted(found)])) for n, found in whole.items()}

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, first word of the window, end of the passage) for each item that leaks."""
        found = words(text)
        if not found or not self.items:
            return []
        numbers = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))
        out = []
        for n, (known, owners) in self.whole.items():
            here = codes(numbers, n)
            where, first = np.unique(here, return_index=True)
            for at in np.flatnonzero(np.isin(known, where[where > 0])):
                start = int(first[np.searchsorted(where, known[at])])
                out.append((self.ids[owners[at]], 0, start, start + n))
        near: dict[int, set[int]] = defaultdict(set)
        for q, runs in self.runs.items():
            here = codes(numbers, q)
            places = np.flatnonzero(here)
            places = places[runs[np.minimum(np.searchsorted(runs, here[places]), len(runs) - 1)] == here[places]]
            if not len(places):
                continue
            for group in self.groups:
                if group.q == q:
                    for piece, starts in group.candidates(numbers, places, here[places]).items():
                        k, offset = self.pieces[piece]
                        near[k].update(start - offset for start in starts)
        for k, starts in sorted(near.items()):
            best = self.best(k, sorted(starts), numbers)
            if best:
                out.append((self.ids[k], *best))
        return out

    def best(self, k: int, starts: list[int], numbers: np.ndarray) -> tuple[int, int, int] | None:
        """(distance, start, end) of item k's best passage around the windows, if it is within the edits."""
        item = self.items[k]
        n, most = len(item), allowed(len(item))
        regions: list[list[int]] = []
        for start in starts:
            low, high = max(0, start - 2 * most), min(len(numbers), start + n + 2 * most)
            if regions and low <= regions[-1][1]:
                regions[-1][1] = max(high, regions[-1][1])
            else:
                regions.append([low, high])
        found = None
        for low, high in regions:
            distance, end = passage_distance(item, numbers[low:high])
            if distance <= most and (found is None or distance < found[0]):
                found = (distance, max(0, low + end - n), low + end)
                if not distance:
                    break
        return found


def blocks(named: DataFrame) -> Iterator[Index]:
    """Indexes of blocks of items (`k`, `t`), about BLOCK characters each, dealt by a hash."""
    total = named.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = -(-total // BLOCK)
    for number in range(passes):
        part = named if passes == 1 else named.filter(F.pmod(F.xxhash64("k", "t"), F.lit(passes)) == number)
        yield Index([(r.k, words(r.t)) for r in part.collect()])


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`id_col`, `item_id`, `distance` (word edits), `start` and `stop` (words of the passage's window)."""
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    named = items.select(F.col(item_col).cast("long").alias("k"), F.col(item_text_col).cast("string").alias("t"))
    out = spark.createDataFrame([], f"i {kind}, item_id long, distance int, start long, stop long")
    for index in blocks(named):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in small_batches(batches, "t"):
                found = [(j, hit) for j, text in enumerate(batch.column("t").to_pylist()) for hit in index.hits(text)]
                columns = [batch.column("i").take(pa.array([j for j, _ in found], pa.int64()))]
                for place, type_ in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64())):
                    columns.append(pa.array([hit[place] for _, hit in found], type_))
                yield pa.RecordBatch.from_arrays(columns, ["i", "item_id", "distance", "start", "stop"])

        out = out.unionByName(rows.mapInArrow(run, out.schema))
    return out.withColumnRenamed("i", id_col)


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that leak no item, with all their columns; texts are not shuffled."""
    prepare(spark)
    out, columns = positional(docs), docs.columns
    schema, at = out.schema, f"c{columns.index(text_col)}"
    for index in blocks(items.select(F.lit(None).cast("long").alias("k"), F.col("text").cast("string").alias("t"))):  # ids do not matter here
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in small_batches(batches, at):
                yield batch.filter(pa.array([not index.hits(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.toDF(*columns)
