"""Near-duplicate removal for corpora: SimHash by Golay-code keys, verified, and made whole for similarity 0.8.

SimHash comes first: fingerprints over five-word shingles, the fuzzy keys of `simhash`, and links at two or fewer
differing bits, each verified by the similarity of the shingle sets. It joins copies with few edits at little cost.
But two texts at a Jaccard similarity of 0.8 often differ in more bits (a copy with a paragraph more nearly always), and
a radius that holds them would link unrelated texts, so what it may miss is looked for by prefixes of the shingles.

Each text's different shingles are put in one order that all texts share, rare
ones first. Two texts at a Jaccard similarity of 0.8 share four fifths of either's shingles, so the first
shingle they share is among the first n - ceil(0.8 n) + 1 of either, and as many follow it in both as the
similarity asks for. Texts that share such a key at places that leave room for the similarity are compared by
their shingle sets unless SimHash links hold them together already, and the links found make components. Any order is without loss; the order by counts in
a sample of SAMPLE texts only keeps common shingles (license lines, templates) out of most prefixes.

A key shared by more than PAIRWISE texts is not expanded into pairs at once: its texts are first compared with
the smallest one, and once the components of these links are known, with each text of the key in another
component, in blocks of BLOCK by BLOCK texts for many tasks. What is left out are pairs that are in one
component anyway, so the components are those of all pairs.

Defined results: null texts and texts without words are duplicates of equal texts only; with fewer words than
a shingle the whole sequence is the one shingle; of each group the row with the smallest id stays, once
if it is repeated (that with the smallest hash of all columns), nulls last; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.llm import simhash
from noteweave.llm.common import discard, named, positional, prepare, small_batches, spread_join, stored
from noteweave.llm.simhash import PAIRWISE, components, shingle_hashes

SHINGLE, SIMILAR = 5, 0.8
#: Texts whose shingles are counted for the order, the least count that is listed, and the side of a block of pairs.
SAMPLE, LISTED, BLOCK = 20_000, 4, 1024
#: Characters of texts for each bucket of keys, keys that a task holds at a time, and nodes whose list is broadcast.
CHARS, HELD, BROADCAST_NODES = 1 << 23, 1 << 18, 2_000_000
#: Counters in a text's sketch.
COUNTERS = 64


def common_shingles(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that LISTED or more of about SAMPLE texts hold."""
    share = min(1.0, SAMPLE / max(1, nodes.count()))
    part = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            found = [np.unique(shingle_hashes(t, SHINGLE)) for t in batch.column("t").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    counted = part.select("node", "t").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= LISTED).toArrow()
    hashes, counts = counted.column("key").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def packed_keys(nodes: DataFrame, buckets: int) -> DataFrame:
    """The keys of each text's prefix by bucket, in arrays: `key`, `node`, `n` (the text's shingles), `at` (place in the order) and `listed`.

    Listed keys may be hot, so they are dealt by node and not by key.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(common_shingles(nodes))  # SAMPLE texts' shingles / LISTED at most
    limit = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shared.value
        parts, held = [], 0

        def out() -> pa.RecordBatch:
            key, node, n, at, listed = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = (np.where(listed, node * 0x9E3779B1, key).view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            ends = pa.array(np.append(first, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (key, node, n, at, listed)]
            return pa.RecordBatch.from_arrays([pa.array(names), *lists], ["bucket", "key", "node", "n", "at", "listed"])

        for batch in small_batches(batches, "t"):
            for node, text in zip(batch.column("node").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist(), strict=True):
                found = np.unique(shingle_hashes(text, SHINGLE))
                n = len(found)
                if not n:
                    continue
                seen = np.zeros(n, np.int64)
                if len(hashes):
                    slot = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    seen = np.where(hashes[slot] == found, counts[slot], 0)
                length = n - (4 * n + 4) // 5 + 1
                first = np.argsort(seen, kind="stable")[:length]
                parts.append((found[first].view(np.int64), np.full(length, node, np.int64), np.full(length, n, np.int32), np.arange(length, dtype=np.int32), seen[first] > 0))
                held += length
            if held > limit:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    return nodes.select("node", "t").mapInArrow(run, "bucket long, key array<long>, node array<long>, n array<int>, at array<int>, listed array<boolean>")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """The rows of prefix keys that texts share, with `members` and the key's smallest node `first`."""
    size = nodes.agg(F.sum(F.length("t"))).first()[0] or 0

    def shared(table: pa.Table) -> pa.Table:
        key, node, n, at, listed = (np.concatenate([np.zeros(0, t), *(c.flatten().to_numpy(zero_copy_only=False) for c in table.column(x).chunks)]) for x, t in (("key", np.int64), ("node", np.int64), ("n", np.int32), ("at", np.int32), ("listed", bool)))
        order = np.lexsort((node, key))
        key, node, n, at, listed = (x[order] for x in (key, node, n, at, listed))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        members = np.diff(np.append(start, len(key)))
        first = np.repeat(node[start], members)
        members = np.repeat(members, members)
        keep = listed | (members > 1)
        return pa.table([pa.array(x[keep]) for x in (key, node, n, at, members, first, listed)], names=["key", "node", "n", "at", "members", "first", "listed"])

    found = packed_keys(nodes, -(-size // CHARS) or 1).groupBy("bucket").applyInArrow(shared, "key long, node long, n int, at int, members long, first long, listed boolean")
    found = stored(found)
    rare, hot = found.filter("not listed").drop("listed"), found.filter("listed").drop("members", "first", "listed")
    counted = hot.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("first")).filter("members > 1")
    return rare.unionByName(hot.join(F.broadcast(counted), "key"))  # no more keys than are listed


def side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(c if c in ("key", "mine", "other") else f"{name}_{c}") for c in rows.columns))


def room() -> Column:
    """Whether the sizes and places of x and y leave room for the similarity if this is the first shingle they share."""
    return 9 * F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= 4 * (F.col("x_n") + F.col("y_n"))


def paired(joined: DataFrame) -> DataFrame:
    return joined.filter(room()).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def short_hashes(text: bytes | None) -> np.ndarray:
    """The 32-bit hashes of the text's different shingles."""
    return np.unique(shingle_hashes(text, SHINGLE).astype(np.uint32))


def shingle_sets(nodes: DataFrame) -> DataFrame:
    """`node` and `s`, the hashes of the text's different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            found = [short_hashes(t).view(np.int32) for t in batch.column("t").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int32()))], ["node", "s"])

    return nodes.select("node", "t").mapInArrow(run, "node long, s array<int>")


def signatures(nodes: DataFrame) -> DataFrame:
    """`node`, `fp`, the SimHash fingerprint, and `k`, the sketch: how many shingle hashes fall to each of COUNTERS counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            found = [shingle_hashes(t, SHINGLE) for t in batch.column("t").cast(pa.binary()).to_pylist()]
            fps = np.array([simhash.fingerprint(x) for x in found], np.uint64).view(np.int64)
            sketches = [np.bincount(np.unique(x.astype(np.uint32)) % COUNTERS, minlength=COUNTERS).astype(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(fps), pa.array(sketches, pa.list_(pa.int32()))], ["node", "fp", "k"])

    return stored(nodes.select("node", "t").mapInArrow(run, "node long, fp long, k array<int>"))


def similar(common: Column, x: Column, y: Column) -> Column:
    """Whether sets of x and y elements with `common` ones have the similarity."""
    return (common >= SIMILAR * (x + y - common)) & (common > 0)


def verified(nodes: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs `a` < `b` whose similarity is SIMILAR or more.

    Sets share no more elements than the lesser of their counters allow, so most other pairs go by the sketches,
    which are much shorter than the sets.
    """
    pairs, total = stored(pairs), lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)

    def with_both(rows: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        # The smaller node of a pair may be that of very many.
        one, two = (facts.select(F.col("node").alias(end), F.col(name).alias(f"{name}{end}")) for end in ("a", "b"))
        return spread_join(rows, one, ["a"]).join(two, "b")

    kept = stored(with_both(pairs, signed, "k").filter(similar(total(F.zip_with("ka", "kb", lambda x, y: F.least(x, y))), total("ka"), total("kb"))).select("a", "b"))
    held = stored(kept.select(F.col("a").alias("node")).unionByName(kept.select(F.col("b").alias("node"))).distinct())
    few = held.count() <= BROADCAST_NODES
    sets = stored(shingle_sets(nodes.join(F.broadcast(held) if few else held, "node", "left_semi")))
    found = stored(with_both(kept, sets, "s").filter(similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b"))
    discard(pairs, kept, held, sets)
    return found


def simhash_pairs(signed: DataFrame) -> DataFrame:
    """Pairs `a` < `b`, not yet verified: each text with the smallest one of its fingerprint, and with the smallest linked one."""
    fps = signed.select("fp", "node")
    first = stored(fps.groupBy("fp").agg(F.min("node").alias("node")))
    equal = spread_join(fps, first.withColumnRenamed("node", "a"), ["fp"]).filter("a < node").select("a", F.col("node").alias("b"))
    return equal.unionByName(simhash.links(first).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component (`node`, `component`) already."""
    named = pairs
    for end in ("a", "b"):
        named = named.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return named.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def links(nodes: DataFrame) -> DataFrame:
    """Links `a` < `b` that have the components of all pairs whose similarity is SIMILAR or more."""
    signed = signatures(nodes)
    found = verified(nodes, signed, simhash_pairs(signed))
    keys = shared_keys(nodes)
    few, many = keys.filter(F.col("members") <= PAIRWISE), keys.filter(F.col("members") > PAIRWISE)
    short = F.col("at") <= F.col("n") - F.ceil(8 * F.col("n") / 9)
    ordered = (F.col("x_n") < F.col("y_n")) | (F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node"))
    pairs = paired(side(few.filter(short), "x").join(side(few, "y"), "key").filter(ordered))
    stars = many.filter("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = found.unionByName(verified(nodes, signed, apart(pairs.unionByName(stars).distinct(), components(found))))
    if many.isEmpty():
        return found
    named = many.drop("first").join(components(found), "node", "left").select("key", "node", "n", "at", "members", F.coalesce("component", "node").alias("c"))
    named = stored(named)
    largest = named.groupBy("key", "c").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("c", "size").alias("largest"), F.count("*").alias("kinds"))
    rows = stored(named.join(largest.filter("kinds > 1").drop("kinds"), "key"))
    if rows.isEmpty():
        return found
    blocks = F.ceil(F.col("members") / BLOCK)
    own, every = F.pmod(F.xxhash64("node"), blocks), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    left = side(rows.filter("c != largest").withColumn("mine", own).withColumn("other", every), "x")
    right = side(rows.withColumn("other", own).withColumn("mine", every), "y")
    other = (F.col("x_c") != F.col("y_c")) & ((F.col("y_c") == F.col("y_largest")) | (F.col("x_node") < F.col("y_node")))
    return found.unionByName(verified(nodes, signed, paired(left.join(right, ["key", "mine", "other"]).filter(other))))


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns."""
    prepare(spark)
    columns, plain = docs.columns, positional(docs)
    own, text = (f"c{columns.index(c)}" for c in (id_col, text_col))
    marked = plain.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(text, F.lit(1)), "id": F.col(own).cast("long")})
    first = stored(marked.groupBy("h1", "h2").agg(F.min("id").alias("id")))
    # Without an id a text is named by its hash, below all ids that are not negative.
    first = first.withColumn("node", F.coalesce("id", -F.abs(F.col("h1") % F.lit(1 << 62)) - 1)).withColumn("id", F.coalesce("id", F.lit(0)))
    keys = ["h1", "h2", "id"]
    once = Window.partitionBy(*keys).orderBy(F.xxhash64(*plain.columns))
    kept = marked.withColumn("id", F.coalesce("id", F.lit(0))).join(first, keys).withColumn("turn", F.row_number().over(once)).filter("turn = 1")
    nodes = stored(kept.select(*plain.columns, "node"))
    groups = components(links(nodes.select("node", F.col(text).cast("string").alias("t"))))
    gone = groups.filter("node != component").select("node")
    return named(nodes.join(gone, "node", "left_anti"), columns)
