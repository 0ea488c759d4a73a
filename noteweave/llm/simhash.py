"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's words (ASCII lower case, cut at ASCII white space) give word shingles; each shingle's XXH64
(UTF-8, seed 42) votes for the 64 bits of the fingerprint, and a bit is 1 if more than half of the
hashes have it. Two fingerprints link at two or fewer differing bits.

Links are found without comparing all pairs. The fingerprint is cut into three segments of 22, 21 and
21 bits. Two errors over three segments leave one segment i without an error whose follower (i + 1) mod 3
has one error at most, so three keys are enough: the exact bits of segment i with a fuzzy key of its
follower. The fuzzy key comes from the perfect binary Golay code (23, 12, 7): each 23-bit word is decoded
to its nearest codeword, at three errors or fewer, and words three errors away also to the five codewords
at four errors. If two words differ in one bit, the nearest codeword of one is among the one or six of
the other. Nearest keys are joined with the lists, and every candidate is verified.

Equal fingerprints are one row from the start. A key that many different fingerprints share is not
expanded into pairs: each of its fingerprints names itself and all words one bit away from it, and rows
that share such a word are linked to the smallest of them. Two fingerprints differ in at most two bits
exactly if they share such a word, so this is exact and linear too.

Components come from alternating large-star and small-star rounds over the links, each round
stored in the shared folder, so nothing is gathered in one place; nodes with very many links are split.

Defined results: null, empty and white-space-only texts have fingerprint zero and link like any other;
with fewer words than a shingle the whole sequence is the one shingle; a repeated doc_id keeps its rows,
each by its own text; rows whose id is null take part as texts but have component null unless an id is
reachable; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from noteweave.llm.common import discard, prepare, small_batches, spread_join, stored

#: Lowest bit and width of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Keys with more different fingerprints than this go by shared neighbour words instead of by pairs.
PAIRWISE = 32
#: Shingle hashes that vote at a time.
VOTES = 1 << 15


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(2**23, 6) indices of the codewords near each word, the nearest first, -1 where there is none.

    The code is generated by its polynomial; a word's syndrome names its error pattern, since the code
    is perfect.
    """
    generator = 0b101011100011

    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words = np.where(words >> bit & 1, words ^ (generator << (bit - 11)), words)
        return words

    one = 1 << np.arange(23, dtype=np.int64)
    patterns = {0: [0]}
    for weight in (1, 2, 3, 4):
        patterns[weight] = sorted({p | int(o) for p in patterns[weight - 1] for o in one if not p & int(o)})
    leader = np.zeros(2048, np.int64)
    for weight in (0, 1, 2, 3):
        found = np.array(patterns[weight], np.int64)
        leader[remainder(found)] = found
    four = np.array(patterns[4], np.int64)
    syndrome = remainder(four)
    order = np.argsort(syndrome, kind="stable")
    start = np.searchsorted(syndrome[order], np.arange(2049))
    others = np.full((2048, 5), -1, np.int64)
    for s in range(2048):
        row = four[order[start[s] : start[s + 1]]]
        others[s, : len(row)] = row
    return leader, others


class Golay:
    """Decodes arrays of 23-bit words; a codeword's index is its upper 12 bits."""

    def __init__(self):
        self.leader, self.others = golay_tables()
        self.upper = np.array([self._remainder(i << 11) for i in range(4096)], np.int64)

    @staticmethod
    def _remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= 0b101011100011 << (bit - 11)
        return word

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.upper[words >> 11] ^ (words & 2047)

    def nearest(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.leader[self.syndrome(words)]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """(n, 6), -1 where there are fewer."""
        s = self.syndrome(words)
        others = self.others[s]
        return np.concatenate([((words ^ self.leader[s]) >> 11)[:, None], np.where(others < 0, -1, (words[:, None] ^ others) >> 11)], axis=1)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    words = (text or b"").lower().split()
    if len(words) <= size:
        found = [xxh64_intdigest(b" ".join(words), 42)] if words else []
    elif size == 3:
        found = [xxh64_intdigest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        found = [xxh64_intdigest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(size)), strict=False)]
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit; zero without hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), VOTES):
        block = np.ascontiguousarray(hashes[start : start + VOTES]).astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """`id_col` and `fp` (the 64 bits as a signed long) for each row."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            texts = batch.column("t").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(shingle_hashes(t, size)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(found.view(np.int64))], ["i", "fp"])

    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, fp long").withColumnRenamed("i", id_col)


def _segments(words: np.ndarray) -> list[np.ndarray]:
    return [(words.view(np.uint64) >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """`key`, `fp`, `node` and `probe` (whether the key is the nearest one): each fingerprint's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = golay()
        for batch in batches:
            words, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
            parts = _segments(words)
            for i in range(3):
                near = code.near(parts[(i + 1) % 3])
                row, col = np.nonzero(near >= 0)
                key = (np.int64(i) << 34) | (parts[i][row] << 12) | near[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(words[row]), pa.array(node[row]), pa.array(col == 0)], ["key", "fp", "node", "probe"])

    return fps.select("fp", "node").mapInArrow(run, "key long, fp long, node long, probe boolean")


def links(fps: DataFrame) -> DataFrame:
    """Links `a` < `b` between nodes of different fingerprints (`fp`, `node`), two or fewer bits apart.

    Of a key that many share, only links to the smallest node around each shared word are given.
    """
    keys = stored(fuzzy_keys(fps))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keys = spread_join(keys, shared, ["key"])
    few = keys.filter(F.col("n") <= PAIRWISE)
    left = few.filter("probe").select("key", F.col("fp").alias("fp_a"), F.col("node").alias("x"))
    right = few.select("key", F.col("fp").alias("fp_b"), F.col("node").alias("y"))
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2
    pairs = left.join(right, "key").filter((F.col("x") != F.col("y")) & close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    words = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = keys.filter(F.col("n") > PAIRWISE).select("fp", "node").distinct().select("node", F.explode(words).alias("word"))
    centres = around.groupBy("word").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("word", "a")
    stars = around.join(centres, "word").filter("a < node").select("a", F.col("node").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component` (the smallest node reachable) for the nodes of edges `a` < `b`."""
    edges = stored(edges.select("a", "b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(spread_join(both.filter("b > a"), low, ["a"]).select(F.col("m").alias("a"), "b").filter("a < b").distinct())
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = spread_join(large, down, ["b"])
        done, edges = edges, stored(small.select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).filter("a < b").distinct())
        discard(done, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
        before = state


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """`id_col`, `fingerprint` (16 hex digits) and `component_id` for each row."""
    rows = stored(fingerprints(spark, df, id_col, text_col, size))
    nodes = stored(rows.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("first")).withColumn("node", F.coalesce("first", F.lit((1 << 63) - 1) - F.abs(F.xxhash64("fp") % F.lit(1 << 40)))))
    found = components(links(nodes))
    best = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = spread_join(rows, best, ["fp"])  # copies, and texts without words, share a fingerprint
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    unknown = F.lit((1 << 63) - 1 - (1 << 40))
    return out.select(id_col, hexed, F.when(F.col("component_id") < unknown, F.col("component_id")).alias("component_id"))
