"""Exact top-k inner products with a bit-sliced index.

Each vector is quantised, ``floor(256 * x)`` per component. Candidates are cut into blocks; in a block
every component (attribute) is stored as bit slices, one bitmap over the block's rows for each bit of
its value, the lowest `dropped` bits left out. For a query the weighted attributes are added with bitmap
arithmetic: a query component's binary digits say at which place an attribute's slices enter, negative
components take the complement slices, and full adders on whole bitmaps reduce each place to one slice of
the sum. Walking that sum from the most significant slice downward finds the k-th largest value without
looking at rows one by one. What the dropped bits can add is known for each query, so all rows that can
still be among the first k are selected by a second walk, and these boundary rows are resolved with
their exact integer products, ties to the smaller id. Blocks' winners meet in one window over k rows of
each block.

Work is queries x candidates, as the task demands; it is dealt in blocks of both, and nothing is
gathered but k rows for each query and block.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do empty
ones; vectors of different lengths are not compared; rows with the query's own id are not its candidates;
each row of `queries` is a query, so a repeated id has a ranking for each of its rows; equal candidate rows are ranked
one after the other; where a score might not fit a long, vectors are compared one by one, in integers of any size, and a
score beyond a long becomes the nearest long; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.llm.common import checkpoint, prepare

#: Components in a block of candidates (65,536 rows of 64), and queries in a group.
COMPONENTS, QUERIES = 1 << 22, 2048
DROPPED_BITS = 2
#: Quantised components below 2**LARGE go into slices.
LARGE = 60
LONG = 1 << 63


class Slices:
    """The bit slices of one block of candidates; rows are in the order of their ids."""

    def __init__(self, values: np.ndarray, dropped: int):
        self.values, self.rows, self.dropped = values, len(values), dropped
        self.largest = int(np.abs(values).max(initial=0))
        kept = values >> dropped
        self.low = int(kept.min(initial=0))
        shifted = (kept - self.low).astype(np.uint64)
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        self.top = (1 << self.bits) - 1
        pad = -self.rows % 64
        planes = np.stack([np.packbits(np.pad((shifted >> np.uint64(b) & np.uint64(1)).astype(bool), ((0, pad), (0, 0))), axis=0, bitorder="little") for b in range(self.bits)])
        words = np.ascontiguousarray(planes.transpose(2, 0, 1)).view(np.uint64)  # attribute, bit, word
        self.slices, self.complements = words, ~words
        valid = np.packbits(np.pad(np.ones(self.rows, bool), (0, pad)), bitorder="little").view(np.uint64)
        self.valid = valid

    def total(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of the weighted sum of the kept bits, lowest first; a constant is left out."""
        widest = int(np.abs(weights).max(initial=0)).bit_length()
        places: list[list[np.ndarray]] = [[] for _ in range(self.bits + widest + 64)]
        for attribute in np.flatnonzero(weights):
            weight = int(weights[attribute])
            planes = (self.slices if weight > 0 else self.complements)[attribute]
            weight, place = abs(weight), 0
            while weight:
                if weight & 1:
                    for bit in range(self.bits):
                        places[place + bit].append(planes[bit])
                weight, place = weight >> 1, place + 1
        out = []
        for place, entering in enumerate(places):
            while len(entering) > 2:
                a, b, c = entering.pop(), entering.pop(), entering.pop()
                half = a ^ b
                entering.insert(0, half ^ c)
                half &= c
                half |= a & b
                places[place + 1].append(half)
            if len(entering) == 2:
                a, b = entering
                places[place + 1].append(a & b)
                entering[:] = [a ^ b]
            out.append(entering[0] if entering else None)
        while out and out[-1] is None:
            out.pop()
        empty = np.zeros_like(self.valid)
        return [empty if x is None else x for x in out]

    def kth(self, total: list[np.ndarray], k: int, among: np.ndarray) -> int:
        """The k-th largest value among rows of a bitmap, read from the most significant slice downward."""
        value, equal, above = 0, among, 0
        for place in range(len(total) - 1, -1, -1):
            ones = equal & total[place]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                equal, value = ones, value | 1 << place
            else:
                above, equal = above + n, equal & ~total[place]
        return value

    def at_least(self, total: list[np.ndarray], bound: int, among: np.ndarray) -> np.ndarray:
        """The bitmap of the rows whose value is `bound` or more."""
        if bound <= 0:
            return among
        if bound >> len(total):
            return np.zeros_like(among)
        larger, equal = np.zeros_like(among), among
        for place in range(len(total) - 1, -1, -1):
            if bound >> place & 1:
                equal = equal & total[place]
            else:
                larger = larger | equal & total[place]
                equal = equal & ~total[place]
        return larger | equal

    def best(self, ids: np.ndarray, own: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of the k best rows, ties to the smaller id."""
        among = self.valid
        left, right = np.searchsorted(ids, [own, own + 1])
        if left < right:
            among = among.copy()
            for row in range(left, right):
                among[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        count = self.rows - (right - left)
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = self.total(weights)
        size = sum(map(abs, weights.tolist()))
        # A dropped rest lies in 0 .. 2**dropped - 1, so the exact score is within this many units.
        slack = -(-size * ((1 << self.dropped) - 1) >> self.dropped)
        bound = self.kth(total, min(k, count), among) - slack
        chosen = self.at_least(total, bound, among)
        rows = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
        scores = self.values[rows] @ weights
        order = np.lexsort((ids[rows], -scores))[:k]
        return rows[order], scores[order]


def integers(values: np.ndarray) -> list[list[int]]:
    """Quantised components of any size, exactly."""
    return [[math.floor(x * 256.0) if abs(x) < 2.0**40 else int(x) * 256 for x in row] for row in values.tolist()]


def finite(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id`, `dim`, `q`: the vectors that take part."""
    fit = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.col(id_col).isNotNull() & F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x.cast("double"), F.lit(0.0))))
    return df.filter(fit).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), F.col(vector_col).cast("array<double>").alias("q"))


def solved(candidates: tuple[np.ndarray, np.ndarray], asking: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, dropped: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(query row, query id, ids, scores) of each query's k best candidates of one block."""
    order = np.argsort(candidates[0], kind="stable")
    ids, exact = candidates[0][order], candidates[1][order]
    small = (np.abs(exact) < 2.0 ** (LARGE - 8)).all(axis=1)
    near = ids[small]
    slices = Slices(np.floor(exact[small] * 256.0).astype(np.int64), dropped)
    for row, own, vector in zip(*asking, strict=True):
        whole = integers(vector[None, :])[0]
        fits = slices.largest * sum(map(abs, whole)) < LONG and max(map(abs, whole)) < LONG
        others = np.flatnonzero((ids != own) & ~(small & fits))
        scores = [sum(a * b for a, b in zip(x, whole, strict=True)) for x in integers(exact[others])]
        scores = np.array([min(max(s, -LONG), LONG - 1) for s in scores], np.int64)
        picked = np.lexsort((ids[others], ~scores))[:k] if len(others) else others
        yield int(row), int(own), ids[others[picked]], scores[picked]
        if fits:
            at, scores = slices.best(near, int(own), np.array(whole, np.int64), k)
            yield int(row), int(own), near[at], scores


def top_k(spark: SparkSession, df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dropped: int = DROPPED_BITS) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: the k best candidates of each query."""
    prepare(spark)
    vectors = checkpoint(finite(df, id_col, vector_col))
    asked = checkpoint(finite(queries, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    n, m = vectors.agg(F.sum("dim")).first()[0] or 0, asked.count()
    groups = -(-m // QUERIES) or 1
    # As many blocks as memory asks for, and as many cells as there are cores.
    blocks = max(-(-n // COMPONENTS), min(-(-spark.sparkContext.defaultParallelism // groups), -(-n // 65_536))) or 1
    # Candidates are dealt to the blocks by id and queries to their groups; each block meets each group.
    cut = vectors.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "row": F.lit(None).cast("long")})
    cut = cut.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    ask = asked.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    ask = ask.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cut.unionByName(ask).repartition(blocks * groups, "block", "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[list]] = {}
        for batch in batches:
            lengths, where = batch.column("q").value_lengths().to_numpy(), batch.column("q")
            flat = where.values.to_numpy()[where.offsets[0].as_py() : where.offsets[-1].as_py()]
            starts = np.cumsum(lengths) - lengths
            ids, block, group = (batch.column(c).to_numpy() for c in ("id", "block", "group"))
            row = batch.column("row").fill_null(-1).to_numpy()
            names = np.stack([block, group, lengths, row >= 0], axis=1)
            for name in np.unique(names, axis=0):
                rows = np.flatnonzero((names == name).all(axis=1))
                vectors_ = flat[starts[rows][:, None] + np.arange(int(name[2]))]
                held.setdefault(tuple(name[:3].tolist()), [[], []])[int(name[3])].append((row[rows], ids[rows], vectors_))
        for candidates, asking in held.values():
            if not candidates or not asking:
                continue
            found = [[], [], [], []]
            several = [np.concatenate([x[c] for x in candidates]) for c in (1, 2)]
            for number, own, names, scores in solved(tuple(several), tuple(np.concatenate([x[c] for x in asking]) for c in range(3)), k, dropped):
                for kept, values_ in zip(found, (np.full(len(names), number), np.full(len(names), own), names, scores), strict=True):
                    kept.append(values_)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in found], ["row", "query_id", "vec_id", "score"])

    winners = cells.select("id", "q", "block", "group", "row").mapInArrow(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return winners.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
