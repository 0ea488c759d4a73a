"""The stored index against rankings over texts, its refresh, versions and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from noteweave.operators import browse, ranking, shards, stored_index

SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "你好", "世界", "eta9", "theta"]


def made(seed, n=120):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, weights=range(1, 11), k=rng.randint(1, 40))), rng.choice(["en", "de"]), f"s{i % 3}") for i in range(n)]
    return [*rows, (1000, "", "en", "s0"), (1001, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def asked(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, "theta 你好世界"), (3, "nothing"), (4, "eta9 eta9 zeta")], "query_id long, query string")


def same(left, right):
    key = lambda rows: sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows.select(sorted(rows.columns)).collect())
    assert key(left) == key(right)


def test_search_over_the_index_equals_search_over_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 16)
    docs, root = frame(spark, made(1)), str(tmp_path / "i")
    with pytest.raises(ValueError, match="empty"):
        stored_index.search(spark, root, asked(spark))
    stored_index.refresh(spark, root, docs)
    for keep, mode in ((None, "hybrid"), (browse.matches({"lang": "en", "source": {"contains": "1"}}), "hybrid"), (None, "keyword"), (browse.matches({"lang": "xx"}), "vector")):
        same(stored_index.search(spark, root, asked(spark), 10, keep, mode, 2.0), ranking.search(docs, asked(spark), 10, keep, mode, 2.0))
    same(stored_index.bm25(spark, root, asked(spark), 7), ranking.bm25(docs, asked(spark), 7))
    scan = stored_index.bm25(spark, root, asked(spark), 7)._jdf.queryExecution().toString()
    assert "In(term" in scan  # the terms reach the scan


def test_refresh_reads_and_writes_what_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 16)
    rows, root = made(2), str(tmp_path / "i")
    first = stored_index.refresh(spark, root, frame(spark, rows))
    assert first["version"] == 1 and first["changes"] == {"insert": 122} and first["n"] == 122
    assert stored_index.stale(spark, root, frame(spark, rows)) == []
    assert stored_index.refresh(spark, root, frame(spark, rows[::-1]))["version"] == 1  # the order does not matter
    changed = [(i, t + " beta" if i in (3, 50) else t, lang, s) for i, t, lang, s in rows if i not in (7, 8, 9)] + [(2000, "alpha new", "fr", "s9")]
    docs = frame(spark, [*changed, (2000, "alpha new", "fr", "s9")])  # a repeated row is one document
    branches = stored_index.stale(spark, root, docs)
    assert 1 <= len(branches) <= 6
    read = stored_index.documents(spark, root, first, branches)
    plan = read._jdf.queryExecution().toString()
    assert read.count() < 40 and "branch#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    second = stored_index.refresh(spark, root, docs)
    assert second["changes"] == {"insert": 1, "update": 2, "delete": 3} and second["n"] == 120
    written = stored_index._read(spark, root, second["segments"][1:], "index").filter("kind = 'shards'").select(F.explode("ids").alias("i"))
    assert sorted(r.i for r in written.collect()) == [3, 50, 2000]
    same(stored_index.search(spark, root, asked(spark)), ranking.search(frame(spark, changed), asked(spark)))
    # A reader of the first version sees it as it was.
    same(stored_index.search(spark, root, asked(spark), version=1), ranking.search(frame(spark, rows), asked(spark)))
    third = stored_index.compact(spark, root)
    assert (third["version"], len(third["segments"]), third["removed"], third["n"], third["tokens"]) == (3, 1, [], second["n"], second["tokens"])
    same(stored_index.search(spark, root, asked(spark)), ranking.search(frame(spark, changed), asked(spark)))
    assert stored_index.stale(spark, root, docs) == [] and stored_index.compact(spark, root)["version"] == 3
    assert stored_index.refresh(spark, root, docs.limit(0))["n"] == 0
    assert stored_index.bm25(spark, root, asked(spark)).count() == 0


def test_crashed_and_concurrent_runs(spark, tmp_path):
    """What was written without a manifest is not read, and two runs cannot commit the same version."""
    rows, root = made(3, 20), str(tmp_path / "i")
    known = stored_index.refresh(spark, root, frame(spark, rows))
    extra = frame(spark, [(500, "alpha alpha", "en", "s")]).join(stored_index.digests(frame(spark, [(500, "alpha alpha", "en", "s")])), "doc_id")
    stored_index._write_segment(spark, root, extra, shards.of_texts(extra))
    same(stored_index.bm25(spark, root, asked(spark)), ranking.bm25(frame(spark, rows), asked(spark)))
    with pytest.raises(RuntimeError, match="made by another"):
        stored_index._commit(spark, root, known)
    with pytest.raises(ValueError, match="no version"):
        stored_index.bm25(spark, root, asked(spark), version=9)


def test_blocks_of_queries_and_string_ids(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shards, "QUERY_BLOCK", 2)
    monkeypatch.setattr(shards, "LITERAL", 1)
    docs = frame(spark, made(4)).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    queries = asked(spark).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    found = ranking.bm25(docs, queries, 5)
    stored_index.refresh(spark, str(tmp_path / "i"), docs)
    same(found, stored_index.bm25(spark, str(tmp_path / "i"), queries, 5))
    assert {r.query_id for r in found.collect()} == {"q1", "q2", "q4"}
