"""Keyed state, joins of two streams and upserts, against their batch forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from noteweave.sources import commits
from noteweave.streaming import feedback as stream
from noteweave.streaming import keyed, table

SCHEMA = "k string, at timestamp, n long, v string"


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))


def event(k, minute, n, v="x"):
    return {"k": k, "at": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "n": n, "v": v}


def source(spark, folder, schema=SCHEMA):
    from pyspark.sql.types import StructType

    return spark.readStream.schema(StructType.fromDDL(schema)).option("maxFilesPerTrigger", 1).json(str(folder))


def test_keyed_state_equals_the_batch_query(spark, tmp_path):
    """Over several batches and a restart, with repeated and late events; a batch gives out its own keys only."""
    log, root, cp = tmp_path / "log", str(tmp_path / "t"), str(tmp_path / "cp")
    put(log, 1, [event("a", 0, 1), event("b", 1, 1), event("a", 2, 3, "y"), event("c", 3, 1)])
    put(log, 2, [event("a", 1, 2, "late"), event("a", 2, 3, "y"), event("b", 5, 2, "new")])
    run = lambda: table.sink(keyed.latest(source(spark, log), ["k"], ["n"], "at"), root, cp, ["k"], ["n"], mode="update", gone="expired").awaitTermination()
    run()
    put(log, 3, [event("d", 6, 1), event("b", 4, 1, "older")])
    run()
    got = sorted(map(tuple, table.read(spark, root).select("k", "n", "v").collect()))
    rows = spark.read.schema(SCHEMA).json(str(log))
    want = rows.groupBy("k").agg(F.max_by(F.struct("n", "v"), "n").alias("r")).select("k", "r.*")
    assert got == sorted(map(tuple, want.collect())) == [("a", 3, "y"), ("b", 2, "new"), ("c", 1, "x"), ("d", 1, "x")]
    touched = [len(commits.read(spark, f"{root}/log", n)["touched"]) for n in commits.numbers(spark, f"{root}/log")]
    assert touched[0] <= 3 and touched[1] <= 1 and touched[2] <= 1  # batch 2 changes b, batch 3 adds d


def test_state_expires(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "t")
    put(log, 1, [event("a", 0, 1), event("b", 0, 1)])
    put(log, 2, [event("b", 50, 2)])
    put(log, 3, [event("c", 90, 1)])
    put(log, 4, [event("d", 91, 1)])
    table.sink(keyed.latest(source(spark, log), ["k"], ["n"], "at", "1 minute", 3600), root, str(tmp_path / "cp"), ["k"], ["n"], mode="update", gone="expired").awaitTermination()
    assert sorted(r.k for r in table.read(spark, root).collect()) == ["b", "c", "d"]


def test_feedback_joined_with_what_was_served(spark, tmp_path):
    """Matched, never served, served too long ago and served twice: the rows of the stream are those of the tables."""
    shown, given = tmp_path / "shown", tmp_path / "given"
    put(shown, 1, [event("a", 0, 1, "ctx a"), event("b", 1, 1, ""), event("d", 2, 1, "one"), event("d", 3, 2, "two")])
    put(given, 1, [event("a", 10, 1, "own"), event("b", 11, 1, "own"), event("c", 12, 1, "own"), event("d", 13, 1, "own"), event("a", 70, 2, "own")])
    put(shown, 2, [event("z", 300, 9, "end")])
    put(given, 2, [event("z", 300, 9, "end")])
    join = lambda e, s: keyed.served(e, s, ["k"], ["v"], "at", "at", "1 hour", "5 minutes")
    query = join(source(spark, given), source(spark, shown)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    view = lambda df: sorted((r.k, r.n, r.v, r.matched) for r in df.filter("k <> 'z'").collect())
    got = view(spark.read.parquet(str(tmp_path / "out")))
    assert got == view(join(spark.read.schema(SCHEMA).json(str(given)), spark.read.schema(SCHEMA).json(str(shown))))
    assert got == [("a", 1, "ctx a", True), ("a", 2, "own", False), ("b", 1, "own", True), ("c", 1, "own", False), ("d", 1, "one", True), ("d", 1, "two", True)]


def test_upserts_by_buckets(spark, tmp_path):
    """Repeated batches, batches after a crash, deletions, and files that grow with the batch."""
    root = str(tmp_path / "t")
    rows = lambda values: spark.createDataFrame(values, "id long, n long, v string, dead boolean")
    put_ = lambda values, batch, name="s": table.apply(root, rows(values), ["id"], ["n"], name, batch, "dead")
    with pytest.raises(ValueError, match="no commit"):
        table.read(spark, root)
    put_([(i, 1, "a", False) for i in range(200)] + [(5, 0, "older", False)], 0)
    first = commits.newest(spark, f"{root}/log")
    second = put_([(3, 2, "b", False), (4, 2, "b", True), (999, 1, "c", False), (6, 0, "older", False)], 1)
    assert len(second["touched"]) <= 4 and sum(first["files"][b] == second["files"].get(b) for b in first["files"]) >= len(first["files"]) - 4
    assert put_([(3, 9, "again", False)], 1) == second  # the batch is in the log
    got = {r.id: (r.n, r.v) for r in table.read(spark, root).collect()}
    assert got == {i: (1, "a") for i in range(200) if i not in (3, 4)} | {3: (2, "b"), 999: (1, "c")}
    assert table.read(spark, root, 1).count() == 200  # an older commit, as it was
    (tmp_path / "t/data/crashed").mkdir()
    assert put_([(3, 3, "d", False)], 7, "other")["batches"] == {"s": 1, "other": 7}
    assert table.vacuum(spark, root, keep=1) >= 1 and not (tmp_path / "t/data/crashed").exists()
    assert table.read(spark, root).filter("id = 3").first().v == "d" and table.read(spark, root).count() == 200
    put_([(i, 99, "", True) for i in [*range(200), 999]], 2)
    assert table.read(spark, root).count() == 0


def test_windowed_adoption(spark, tmp_path):
    put(tmp_path / "log", 1, [event("a", 1, 1), event("b", 2, 0), event("c", 61, 1)])
    rows = stream.windowed_adoption(source(spark, tmp_path / "log").withColumn("ok", F.col("n") == 1), "at", "ok")
    got = stream.drain(rows, str(tmp_path / "cp"), str(tmp_path / "out")).select(F.col("window.start").alias("s"), "n", "adopted").collect()
    assert sorted((r.s, r.n, r.adopted) for r in got) == [(dt.datetime(2026, 1, 1, 0), 2, 1), (dt.datetime(2026, 1, 1, 1), 1, 1)]
