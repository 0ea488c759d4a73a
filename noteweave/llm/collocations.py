"""Phrase collocations by depth-truncated suffix subtrees, after vertical partitioning.

The words of a language are one long sequence with breaks where a piece or a document ends. Every position begins a suffix; cut
after DEEP words, its suffixes form a tree whose node at depth d is a phrase of d words, and the phrase's frequency is
the sum over the leaves below it. The tree is far too large for one place, so it is cut vertically: a first
word is a prefix; a prefix that may begin more than a quarter of a group's budget of suffixes is extended by its next word, and
once more if that word is as frequent, since a pair is no more frequent than either of its words. What is left are
prefixes below which every subtree fits the budget; they are dealt to groups by a hash, and each group sorts its suffixes
and builds its subtrees alone, reading node counts from runs of leaves. Only a pair of two such heavy words lies in
several groups, whose counts of it are added. Groups have BUDGET suffixes on average; with more than GROUPS * BUDGET words in
all the budget grows, so fewer than 4 * GROUPS words are ever over it, which bounds the list that is broadcast.

Equal suffixes of a task's chunk are one row with a count before they are shuffled. A word with fewer than `least`
occurrences is in no candidate, so suffixes end before it: a table of SLOTS bits over hashes of the frequent words, of the same
size for every corpus, tells most rare words; a collision only keeps a suffix that counts for nothing.

A candidate is a phrase of two or more words with a frequency of `least`. It is cut after each of its words, the frequencies
of both parts are looked up (hot parts are split), and the lowest score floor(10^6 a^2 / (l r)) counts, in exact integers.

Defined results: null and empty texts have no words; a null language is `und`; a document is a row, so repeated rows count again; phrases
do not cross pieces or documents; ties go by frequency, then by the phrase in UTF-8 order; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.llm.common import prepare, small_batches, spread_join, stored

#: Occurrences that a candidate needs; phrases returned for a language; share of a longer phrase (hundredths) that drops a shorter.
LEAST, FIRST, COVERED = 10, 2000, 50
#: Words of a phrase; suffixes in a group; most groups; words in a task's chunk; bits over the frequent words, and bits in a row of them.
DEEP, BUDGET, GROUPS, CHUNK, SLOTS, ROW = 3, 1 << 20, 1 << 16, 1 << 18, 1 << 26, 1 << 15

#: A-Z in lower case, tabs as spaces, the marks and line ends that part pieces as full stops.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 9 else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
Chunk = tuple[str, pa.Array, np.ndarray]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Language, distinct words and the sequence of their numbers (-1: a break), for about CHUNK words at a time."""
    held: dict[str, list[bytes]] = {}

    def take(lang: str) -> Chunk:
        coded = pa.array(held.pop(lang), pa.binary()).dictionary_encode()
        numbers, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        stop = pc.index(words, pa.scalar(b".", pa.binary())).as_py()
        return lang, words, np.where(numbers == stop, -1, numbers)

    for batch in small_batches(batches, "t"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
            own = held.setdefault(lang, [])
            own += text.translate(FOLD).replace(b".", b" . ").split()
            own.append(b".")
            if len(own) > CHUNK or sum(map(len, held.values())) > 2 * CHUNK:
                yield take(lang)
    for lang in list(held):
        yield take(lang)


def counted(lang: str, words: pa.Array, columns: list[np.ndarray]) -> list[pa.Array]:
    """The language, the words and the counts of the distinct tuples of word numbers, as columns."""
    size, depth = len(words) + 1, len(columns)
    if size**depth < 1 << 62:
        packed = np.zeros(len(columns[0]), np.int64)
        for column in columns:
            packed = packed * size + column + 1
        values, counts = np.unique(packed, return_counts=True)
        numbers = [values // size**step % size - 1 for step in reversed(range(depth))]
    else:  # a very long text with millions of different words
        distinct, counts = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        numbers = list(distinct.T)
    texts = [pc.fill_null(words.take(pa.array(x, mask=x < 0)), b"").cast(pa.string()) for x in numbers]
    return [pa.array([lang] * len(counts), pa.string()), *texts, pa.array(counts)]


def sliced(columns: list[pa.Array], names: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays(columns, names)
    for cut in range(0, batch.num_rows, rows):
        yield batch.slice(cut, rows)


def following(numbers: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each word of the sequence its number and those of the next words, -1 from the first break on."""
    out = [numbers]
    for step in range(1, depth):
        after = np.concatenate([numbers[step:], np.full(min(step, len(numbers)), -1)])
        out.append(np.where(out[-1] < 0, -1, after))
    here = numbers >= 0
    return [x[here] for x in out]


def slots(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) % SLOTS for w in words), np.int64, len(words))


def texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))


def word_counts(rows: DataFrame) -> DataFrame:
    """`lang`, `w1`, `f` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in chunks(batches):
            yield from sliced(counted(lang, words, following(numbers, 1)), ["lang", "w1", "f"])

    return rows.mapInArrow(run, "lang string, w1 string, f long").groupBy("lang", "w1").agg(F.sum("f").alias("f"))


def frequent_bits(frequent: DataFrame) -> np.ndarray:
    """One bit for each slot that a frequent word (`w1`) has; SLOTS / 8 bytes reach the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(slots(batch.column("w1").cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(found // ROW), pa.array((found % ROW).astype(np.int32))], ["row", "at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for at in batch.column("at"):
                bits = np.zeros(ROW, np.uint8)
                bits[at.values.to_numpy()] = 1
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(packed, pa.binary())], ["row", "bits"])

    rows = frequent.select("w1").mapInArrow(run, "row long, at int").groupBy("row").agg(F.collect_set("at").alias("at"))  # ROW at most
    out = np.zeros((SLOTS // ROW, ROW // 8), np.uint8)
    for row in rows.mapInArrow(pack, "row long, bits binary").toLocalIterator():
        out[row.row] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


class Frequent:
    """Drops what cannot be in a candidate: rare words become breaks. The bits travel as one broadcast."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, words: pa.Array, numbers: np.ndarray) -> np.ndarray:
        at = slots(words.to_pylist())
        known = (self.bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return np.where((numbers >= 0) & known[numbers], numbers, -1)


def suffixes(spark: SparkSession, rows: DataFrame, heavy: dict[str, list[str]], frequent) -> DataFrame:
    """`lang`, `w1`, `w2`, `w3` ('' beyond the end), `f` and `depth`: of how many words the suffix's prefix consists.

    `heavy` has the heavy words of each language. A suffix of one word is no phrase and is left out.
    """
    shared = spark.sparkContext.broadcast({lang: pa.array(own, pa.string()) for lang, own in heavy.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in chunks(batches):
            places = following(frequent.value(words, numbers), DEEP)
            here = places[1] >= 0
            if not here.any():
                continue
            columns = counted(lang, words, [x[here] for x in places])
            depth = np.ones(len(columns[-1]), np.int32)
            if lang in shared.value:
                first, second = (pc.is_in(c, value_set=shared.value[lang]).to_numpy(zero_copy_only=False) for c in columns[1:3])
                depth += first.astype(np.int32) + (first & second).astype(np.int32)
            yield from sliced([*columns, pa.array(depth)], ["lang", "w1", "w2", "w3", "f", "depth"])

    return rows.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, f long, depth int")


def subtrees(sorted_suffixes: DataFrame, least: int) -> DataFrame:
    """`lang`, `w1`, `w2`, `w3` ('': depth two) and `a` of the nodes at depths two and three with `least` occurrences.

    The partitions are sorted, so the leaves of a node are neighbours. Rows are taken some ten thousand at a time, up to where
    a subtree of depth two ends. A pair of heavy words is spread over groups: each group gives what it has of it.
    """
    names = ["lang", "w1", "w2", "w3"]

    def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
        out = np.zeros(table.num_rows, bool)
        out[:1] = True
        for c in columns:
            column = table.column(c)
            out[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
        return out

    def nodes(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pair = changes(table, names[:3])
        leaf = pair | changes(table, names[3:])
        f, depth = table.column("f").to_numpy(), table.column("depth").to_numpy()
        ends = table.column("w3")
        for starts, deep in ((np.flatnonzero(pair), 2), (np.flatnonzero(leaf), 3)):
            a = np.add.reduceat(f, starts)
            good = a >= least
            if deep == 2:
                good |= depth[starts] == 3
            else:
                good &= pc.not_equal(ends.take(pa.array(starts)), "").to_numpy()
            at = pa.array(starts[good])
            third = ends.take(at) if deep == 3 else pa.chunked_array([pa.array([""] * len(at), pa.string())])
            out = [table.column(c).take(at) for c in names[:3]] + [third, pa.chunked_array([pa.array(a[good])])]
            for batch in pa.Table.from_arrays(out, [*names, "a"]).combine_chunks().to_batches(50_000):
                yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        count, wanted = 0, 1 << 16
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count < wanted:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            last = int(np.flatnonzero(changes(table, names[:3]))[-1])
            if last:
                yield from nodes(table.slice(0, last))
                rest = table.slice(last).combine_chunks()
                waiting, count, wanted = rest.to_batches(), rest.num_rows, 1 << 16
            else:  # one subtree so far: more rows before it is looked at again
                waiting, wanted = table.to_batches(), 2 * count
        if count:
            yield from nodes(pa.Table.from_batches(waiting).combine_chunks())

    return sorted_suffixes.select(*names, "f", "depth").mapInArrow(run, "lang string, w1 string, w2 string, w3 string, a long")


def phrase(*words: str) -> Column:
    return F.concat_ws(" ", *(F.when(F.col(w) != "", F.col(w)) for w in words))


def phrase_counts(spark: SparkSession, docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", budget: int = BUDGET, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the words (`lang`, `w1`, `f`) and of the phrases of two and three words with `least` occurrences."""
    rows = texts(docs, text_col, lang_col)
    words = stored(word_counts(rows))
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = max(1, min(groups, -(-total // budget)))
    limit = max(total / parts / 4, least)
    frequent = spark.sparkContext.broadcast(Frequent(frequent_bits(words.filter(F.col("f") >= least))))
    heavy: dict[str, list[str]] = {}  # fewer than 4 * parts words, whatever the corpus
    for r in words.filter(F.col("f") > limit).toLocalIterator():
        heavy.setdefault(r.lang, []).append(r.w1)
    own = suffixes(spark, rows, heavy, frequent)
    key = [F.col("lang"), F.col("w1"), F.when(F.col("depth") > 1, F.col("w2")), F.when(F.col("depth") > 2, F.col("w3"))]
    # Sorted by a hash of the pair first: one integer settles nearly every comparison.
    grouped = own.repartition(parts, *key).sortWithinPartitions(F.xxhash64("lang", "w1", "w2"), "lang", "w1", "w2", "w3")
    phrases = subtrees(grouped, least).groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return words, stored(phrases)


def mine(spark: SparkSession, docs: DataFrame, least: int = LEAST, first: int = FIRST, text_col: str = "text", lang_col: str = "lang", budget: int = BUDGET, groups: int = GROUPS) -> DataFrame:
    """`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score` of each language's first candidates."""
    prepare(spark)
    words, phrases = phrase_counts(spark, docs, least, text_col, lang_col, budget, groups)
    named = phrases.select("lang", phrase("w1", "w2", "w3").alias("phrase"), "w1", "w2", "w3", "a")
    # Every part of every cut, one row each: as (language, part) it meets its frequency in one join.
    cut = lambda k, part, text: F.struct(F.lit(k).alias("k"), F.lit(part).alias("side"), text.alias("part"))
    two = F.array(cut(1, "l", F.col("w1")), cut(1, "r", F.col("w2")))
    three = F.array(cut(1, "l", F.col("w1")), cut(1, "r", phrase("w2", "w3")), cut(2, "l", phrase("w1", "w2")), cut(2, "r", F.col("w3")))
    cuts = stored(named.select("lang", "phrase", "a", F.explode(F.when(F.col("w3") == "", two).otherwise(three)).alias("c")).select("lang", "phrase", "a", "c.*"))
    known = words.filter(F.col("f") >= least).select("lang", F.col("w1").alias("part"), "f").unionByName(phrases.filter("w3 = ''").select("lang", phrase("w1", "w2").alias("part"), F.col("a").alias("f")))
    met = spread_join(cuts, known, ["lang", "part"]).groupBy("lang", "phrase", "a").agg(*(F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in (1, 2) for s in "lr"))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = lambda k: F.call_function("div", (wide("a") * wide("a")).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(f"l{k}") * wide(f"r{k}"))
    option = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = met.select("lang", "phrase", "a", F.least(option(1), option(2)).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inner = phrases.filter("w3 <> ''").select("lang", "a", F.explode(F.array(phrase("w1", "w2"), phrase("w2", "w3"))).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longest, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < COVERED * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
