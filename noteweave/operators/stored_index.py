"""A stored inverted index that search reads, kept current by digests.

An index is a folder: `index` and `documents` with one part for each segment, `removed/<name>` with what later
versions took away, and `manifest/<version>.json`, which names what belongs to a version. A version is committed by
renaming its manifest, so what a crashed run wrote is never read; a version never changes, and readers of an older one are not
disturbed.

`refresh` compares by a tree of digests: a document's digest, sums of them over BRANCHES branches of ids, and the root over those. Where the
root agrees nothing is read or written; else only the stored documents of branches that differ are read, and only the postings
of new and changed documents are written. `compact` merges all segments into one without reading a text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.operators import ranking
from noteweave.operators.browse import MOST_HITS, clamped
from noteweave.operators.shards import Shards, of_texts, pack, rank
from noteweave.sources import commits

#: Branches of the digest tree.
BRANCHES = 64


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The newest committed version of the index, or the one named; version 0 is empty."""
    known = commits.numbers(spark, f"{root}/manifest")
    if version and version not in known:
        raise ValueError(f"{root} has no version {version}")
    if not known or version == 0:
        return {"version": 0, "segments": [], "removed": [], "n": 0, "tokens": 0, "branches": {}}
    return commits.read(spark, f"{root}/manifest", known[-1] if version is None else version)


def _commit(spark: SparkSession, root: str, new: dict) -> dict:
    return commits.commit(spark, f"{root}/manifest", new["version"], new)


def digests(docs: DataFrame) -> DataFrame:
    """`doc_id`, `digest` of all columns, `branch`; of a repeated id the greatest digest counts."""
    rest = sorted(c for c in docs.columns if c != "doc_id")
    own = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).cast("binary"), 256)
    found = docs.select("doc_id", own.alias("digest")).groupBy("doc_id").agg(F.max("digest").alias("digest"))
    return found.withColumn("branch", F.pmod(F.xxhash64("doc_id"), F.lit(BRANCHES)).cast("int"))


def branch_digests(rows: DataFrame) -> dict[str, str]:
    """A digest for each branch that does not depend on the order of its documents: count, sum and exclusive or of their hashes."""
    own = F.xxhash64("doc_id", "digest")
    found = rows.groupBy("branch").agg(F.count("*").alias("n"), F.sum(own.cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("digest", "doc_id")).alias("x"))
    return {str(r.branch): f"{r.n}/{r.s}/{r.x}" for r in found.collect()}  # BRANCHES rows at most


def _read(spark: SparkSession, root: str, names: list[str], part: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{part}").parquet(*(f"{root}/{part}/segment={s}" for s in names))


def removed(spark: SparkSession, root: str, known: dict) -> DataFrame | None:
    """`segment`, `shard`, `doc_id` of what later versions took away."""
    paths = [f"{root}/removed/{name}" for name in known["removed"]]
    return spark.read.parquet(*paths) if paths else None


def documents(spark: SparkSession, root: str, known: dict | None = None, branches: list[int] | None = None) -> DataFrame | None:
    """The documents of a version: segment, doc_id, digest, branch, excerpt and metadata; of some branches only, if given."""
    known = manifest(spark, root) if known is None else known
    if not known["segments"]:
        return None
    rows = _read(spark, root, known["segments"], "documents")
    rows = rows if branches is None else rows.filter(F.col("branch").isin(branches))
    gone = removed(spark, root, known)
    return rows if gone is None else rows.join(gone.select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")


def _write_segment(spark: SparkSession, root: str, docs: DataFrame, counts: DataFrame) -> str:
    """Lists and shards of `counts`, and the documents (with `digest` and `branch`) beside them."""
    name = uuid.uuid4().hex
    pack(counts).sortWithinPartitions("kind", "term").write.partitionBy("kind").parquet(f"{root}/index/segment={name}")
    shown = docs.select(*(c for c in docs.columns if c not in ("text", "segment")), *([F.substring("text", 1, 200).alias("excerpt")] if "text" in docs.columns else []))
    shown.repartition("branch").write.partitionBy("branch").parquet(f"{root}/documents/segment={name}")
    return name


def _size(spark: SparkSession, root: str, name: str) -> tuple[int, int]:
    found = _read(spark, root, [name], "index").filter("kind = 'shards'").agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return found[0] or 0, found[1] or 0


def stale(spark: SparkSession, root: str, docs: DataFrame) -> list[int]:
    """The branches of which the index does not hold exactly these documents; none: it is current."""
    old, new = manifest(spark, root)["branches"], branch_digests(digests(docs))
    return sorted(int(b) for b in old.keys() | new.keys() if old.get(b) != new.get(b))


def refresh(spark: SparkSession, root: str, docs: DataFrame) -> dict:
    """Bring the index to exactly `docs` (`doc_id`, `text`, metadata); returns the manifest, with `changes` by action.

    Without a difference no version is made. Of a repeated id the row of the greatest digest is indexed.
    """
    old = manifest(spark, root)
    fresh = digests(docs)
    tree = branch_digests(fresh)
    different = sorted(int(b) for b in old["branches"].keys() | tree.keys() if old["branches"].get(b) != tree.get(b))
    if not different:
        return old | {"changes": {}}
    wanted = fresh.filter(F.col("branch").isin(different))
    before = documents(spark, root, old, different)
    if before is None:
        before = spark.createDataFrame([], f"segment string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string")
    both = wanted.select("doc_id", F.col("digest").alias("new"), "branch").join(before.select("doc_id", F.col("digest").alias("old"), "segment"), "doc_id", "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    name = uuid.uuid4().hex
    both.withColumn("action", action).filter("action is not null").write.parquet(f"{root}/changes/{name}")
    changed = spark.read.parquet(f"{root}/changes/{name}")
    counts = {r.action: r.n for r in changed.groupBy("action").agg(F.count("*").alias("n")).collect()}
    new = old | {"version": old["version"] + 1, "branches": tree, "segments": list(old["segments"]), "removed": list(old["removed"])}
    if counts.get("update", 0) + counts.get("delete", 0):
        gone = changed.filter("old is not null").select("segment", "doc_id")
        places = _read(spark, root, old["segments"], "index").filter("kind = 'shards'").select("segment", "shard", F.explode(F.arrays_zip("ids", "lengths")).alias("d")).select("segment", "shard", F.col("d.ids").alias("doc_id"), F.col("d.lengths").alias("dl"))
        places.join(gone, ["segment", "doc_id"], "left_semi").write.parquet(f"{root}/removed/{name}")
        lost = spark.read.parquet(f"{root}/removed/{name}").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        new |= {"removed": [*new["removed"], name], "n": new["n"] - lost[0], "tokens": new["tokens"] - lost[1]}
    if counts.get("insert", 0) + counts.get("update", 0):
        own = changed.filter("new is not null").select("doc_id", F.col("new").alias("digest"), "branch")
        rest = sorted(c for c in docs.columns if c != "doc_id")
        digest = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).cast("binary"), 256)
        rows = docs.withColumn("digest", digest).join(own, ["doc_id", "digest"]).dropDuplicates(["doc_id"])
        segment = _write_segment(spark, root, rows, of_texts(rows))
        n, size = _size(spark, root, segment)
        new |= {"segments": [*new["segments"], segment], "n": new["n"] + n, "tokens": new["tokens"] + size}
    return _commit(spark, root, new) | {"changes": counts}


def compact(spark: SparkSession, root: str) -> dict:
    """Merge all segments into one, without what was removed; no text is read."""
    old = manifest(spark, root)
    if len(old["segments"]) < 2 and not old["removed"]:
        return old
    index = _shards(spark, root, old, None)
    id_type = index.id_type

    def flat(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("ids").combine_chunks().flatten()
        dead = right.column("dead").combine_chunks()
        alive = np.ones(len(ids), bool) if dead.null_count else ~pc.is_in(ids, value_set=dead.flatten()).to_numpy(zero_copy_only=False)
        terms = [[] for _ in range(len(ids))]
        freqs = [[] for _ in range(len(ids))]
        for term, slots, times in zip(left.column("term").to_pylist(), left.column("slots").to_pylist(), left.column("freqs").to_pylist()):
            for slot, f in zip(slots, times):
                terms[slot].append(term)
                freqs[slot].append(f)
        here = np.flatnonzero(alive).tolist()
        return pa.Table.from_arrays([ids.take(pa.array(here, pa.int64())), pa.array([True] * len(here), pa.bool_()), pa.array([terms[i] for i in here], pa.list_(pa.string())), pa.array([freqs[i] for i in here], pa.list_(pa.int32()))], ["doc_id", "kept", "terms", "freqs"])

    counts = index.lists.groupBy("segment", "shard").cogroup(index.own().groupBy("of", "at")).applyInArrow(flat, f"doc_id {id_type}, kept boolean, terms array<string>, freqs array<int>")
    name = _write_segment(spark, root, documents(spark, root, old), counts)
    return _commit(spark, root, old | {"version": old["version"] + 1, "segments": [name], "removed": []})


def _shards(spark: SparkSession, root: str, known: dict, keep: Column | None) -> Shards:
    rows = _read(spark, root, known["segments"], "index")
    allowed = None
    if keep is not None:
        places = rows.filter("kind = 'shards'").select("segment", "shard", F.explode("ids").alias("doc_id"))
        allowed = documents(spark, root, known).filter(keep).select("segment", "doc_id").join(places, ["segment", "doc_id"])
    return Shards(rows, removed(spark, root, known), allowed, (known["n"], known["tokens"]))


def search(spark: SparkSession, root: str, queries: DataFrame, top_k: int = 10, keep: Column | None = None, mode: str = "hybrid", vector_weight: float = 1.0, keyword_weight: float = 1.0, version: int | None = None) -> DataFrame:
    """`ranking.search` over the stored index: no text is read. `keep` may name metadata and `excerpt`."""
    known = manifest(spark, root, version)
    if not known["segments"]:
        raise ValueError(f"the index {root} is empty")
    channels = {"hybrid": ("keyword", "vector"), "keyword": ("keyword",), "vector": ("vector",)}[mode]
    found = rank(_shards(spark, root, known, keep), queries, ranking.POOL, channels)
    part = lambda c: found.filter(F.col("channel") == c).drop("channel")
    best = ranking.hits(ranking.fuse(part("vector"), part("keyword"), vector_weight, keyword_weight), clamped(top_k, MOST_HITS))
    shown = documents(spark, root, known).drop("segment", "digest", "branch")
    meta = [c for c in shown.columns if c not in ("doc_id", "excerpt")]
    return best.join(shown, "doc_id").select("query_id", "rank", "doc_id", F.bround("fused", 5).alias("fused_score"), F.bround("similarity", 3).alias("similarity"), F.bround("bm25", 3).alias("bm25"), *meta, "excerpt")


def bm25(spark: SparkSession, root: str, queries: DataFrame, k: int = ranking.POOL, keep: Column | None = None, version: int | None = None) -> DataFrame:
    """`query_id`, `rank`, `doc_id`, `score` of the k best documents of the stored index."""
    known = manifest(spark, root, version)
    if not known["segments"]:
        raise ValueError(f"the index {root} is empty")
    return rank(_shards(spark, root, known, keep), queries, k).drop("channel")
