"""The loop as one call: its ledger rows, its state, crashes and repeated runs; triples with texts and drawn negatives."""

import json

import pytest
from pyspark.sql import functions as F

from noteweave.operators import closed_loop, feedback
from noteweave.sources import notes

CHUNKS = [(f"c{i}", f"{folder}/{name}.md", f"{name} > part {i}", i, text) for i, (folder, name, text) in enumerate([
    ("a", "cats", "cats purr and sleep all day"), ("a", "cats", "feeding cats twice a day"), ("a", "dogs", "dogs bark at night"), ("b", "birds", "birds sing in the morning"),
    ("b", "fish", "fish swim in the pond"), ("b", "fish", "cleaning the pond for fish"), ("c", "trees", "trees lose leaves in autumn"), ("c", "stone", "stones and sand by the river"),
])]
CASES = [("cats sleep", "cats"), ("bark night", "dogs"), ("pond", "fish"), ("autumn leaves", "trees")]
NOW = "2026-01-0{}T00:00:00"


@pytest.fixture
def chunked(spark):
    return spark.createDataFrame(CHUNKS, "id string, source_file string, header_path string, chunk_index int, text string")


@pytest.fixture
def cases(spark):
    return spark.createDataFrame(CASES, "query string, gold string")


def log(spark, rows):
    return spark.createDataFrame(rows, "query string, source_file string, header_path string, adopted boolean, timestamp string, model_version string")


GOOD = [("cats sleep", "a/cats.md", "cats > part 0", True, NOW.format(1), "notes")] * 9
BAD = [("cats sleep", "b/fish.md", "fish > part 4", False, NOW.format(1), "notes"), ("cats sleep", "zz.md", "", False, NOW.format(1), "notes"), ("alone", "c/stone.md", "gone", True, NOW.format(1), "notes"), ("none", "", "", True, NOW.format(1), "notes")]


def measured(values):
    return lambda chunked, cases, model: values[model] | {"n": 4}


HIGH, LOW = {"hit1": 0.9, "hit5": 0.9, "mrr": 0.9}, {"hit1": 0.1, "hit5": 0.5, "mrr": 0.2}
PASSES, FAILS = measured({"1.0,1.0": HIGH, "new": HIGH}), measured({"1.0,1.0": HIGH, "new": LOW})


def turn(spark, root, rows, chunked, cases, day, measure=PASSES, **kw):
    return closed_loop.run(spark, root, log(spark, rows), chunked, cases, NOW.format(day), measure=measure, train=lambda c, t, base: "new", **kw)


def test_ledger_of_a_life(spark, tmp_path, chunked, cases, monkeypatch):
    """Skip, dry run, promotion to a test, crash and re-run, online promotion, offline rollback: the rows and the state after each."""
    root = str(tmp_path / "loop")
    assert turn(spark, root, GOOD[:3], chunked, cases, 1)["event"] == "skip_insufficient_feedback" and closed_loop.state(spark, root) == closed_loop.FIRST | {"updated_at": None}
    dry = turn(spark, root, GOOD + BAD, chunked, cases, 2)
    assert (dry["action"], dry["version"], dry["applied"], dry["triple_source"], dry["candidate_collection"]) == ("promote_to_ab", 1, False, "feedback+bootstrap", "notes_ft_v1")
    assert not closed_loop.state(spark, root)["ab"]["enabled"]
    monkeypatch.setattr(closed_loop, "FEW", 1)  # the triples of feedback suffice from here on

    def crash(*a):
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        turn(spark, root, GOOD, chunked, cases, 3, apply=True, run_id="r3", measure=crash)
    assert len(closed_loop.ledger(spark, root)) == 2
    done = turn(spark, root, GOOD, chunked, cases, 3, apply=True, run_id="r3")
    assert (done["action"], done["version"], done["run_id"]) == ("promote_to_ab", 2, "r3")  # one more than any in the ledger
    assert turn(spark, root, [], chunked, cases, 9, apply=True, run_id="r3") == done and len(closed_loop.ledger(spark, root)) == 3
    now = closed_loop.state(spark, root)
    assert (now["active_collection"], now["ab"]["enabled"], now["ab"]["candidate_collection"], now["ab"]["traffic_ratio"], now["updated_at"]) == ("notes", True, "notes_ft_v2", 0.2, NOW.format(3))
    assert notes.read_collection(spark, f"{root}/collections", "notes_ft_v2").count() == len(CHUNKS)
    assert [r.role for r in spark.read.json(f"{root}/collection_info/notes_ft_v2").collect()] == ["candidate"]
    served = closed_loop.serving(spark, root, spark.range(400).select(F.col("id").cast("string").alias("k")), "k").groupBy("collection").count()
    assert {r.collection: 40 < r["count"] < 120 for r in served.collect()} == {"notes_ft_v2": True, "notes": False}

    arm = lambda name, good, n, day=4: [("q", "f", "h", i < good, NOW.format(day), name) for i in range(n)]
    few = closed_loop.monitor(spark, root, log(spark, arm("notes", 5, 10) + arm("notes_ft_v2", 9, 9) + arm("notes_ft_v2", 0, 9, 1)), NOW.format(4), apply=True)
    assert (few["action"], few["n_candidate"]) == ("keep_ab", 9)
    won = closed_loop.monitor(spark, root, log(spark, arm("notes", 5, 10) + arm("notes_ft_v2", 9, 10)), NOW.format(5), apply=True, run_id="m5")
    assert won["action"] == "promote_full" and closed_loop.monitor(spark, root, log(spark, arm("x", 1, 1)), NOW.format(9), run_id="m5") == won
    now = closed_loop.state(spark, root)
    assert (now["version"], now["active_collection"], now["active_model"], now["ab"]["enabled"]) == (1, "notes_ft_v2", "new", False)
    assert closed_loop.monitor(spark, root, log(spark, []), NOW.format(6)) == {"action": "no_ab"}
    assert [r["action"] for r in closed_loop.ledger(spark, root)] == ["skip", "promote_to_ab", "promote_to_ab", "keep_ab", "promote_full"]


def test_rollbacks_and_failures(spark, tmp_path, chunked, cases, monkeypatch):
    root = str(tmp_path / "loop")
    monkeypatch.setattr(closed_loop, "FEW", 1)
    assert turn(spark, root, [], chunked.limit(0), cases, 1, force=True)["action"] == "skip_no_triples"
    failed = closed_loop.run(spark, root, log(spark, GOOD), chunked, cases, NOW.format(1), build=lambda *a: {"built": False, "reason": "no room"}, train=lambda *a: "new", measure=PASSES)
    assert (failed["event"], failed["reason"]) == ("candidate_build_failed", "no room")
    assert turn(spark, root, GOOD, chunked, cases, 2, apply=True)["action"] == "promote_to_ab"
    lost = turn(spark, root, GOOD, chunked, cases, 3, measure=FAILS, apply=True)
    assert (lost["action"], lost["gate_verdict"], lost["gate_deltas"]) == ("rollback_offline", False, {"hit1": -0.8, "hit5": -0.4, "mrr": -0.7})
    assert closed_loop.state(spark, root)["ab"]["enabled"] is False
    assert turn(spark, root, GOOD, chunked, cases, 4, apply=True)["version"] == 4
    arm = lambda name, good: [("q", "f", "h", i < good, NOW.format(5), name) for i in range(10)]
    worse = closed_loop.monitor(spark, root, log(spark, arm("notes", 8) + arm("notes_ft_v4", 6)), NOW.format(5), apply=True)
    assert worse["action"] == "rollback_online" and closed_loop.state(spark, root)["ab"]["candidate_collection"] is None
    assert closed_loop.state(spark, root)["active_collection"] == "notes"


def test_a_turn_with_its_own_training(spark, tmp_path, chunked, cases, monkeypatch):
    """The weights are fitted and both models measured on the cases."""
    monkeypatch.setattr(closed_loop, "WEIGHTS", ((2.0, 1.0),))
    done = closed_loop.run(spark, str(tmp_path / "loop"), log(spark, GOOD), chunked, cases, NOW.format(1), apply=True)
    assert done["action"] == "promote_to_ab" and set(done["gate_deltas"]) == {"hit1", "hit5", "mrr"} and done["n_triples"] >= 6
    assert closed_loop.measure(chunked, cases, "1.0,1.0")["hit5"] == 1.0


def test_triples_with_texts(spark, chunked, cases):
    """Texts are looked up, named negatives come first, and draws fill up, at any partitioning."""
    rows = log(spark, GOOD + BAD)
    got = sorted(map(tuple, feedback.text_triples(rows, chunked).collect()))
    texts = {c[4] for c in CHUNKS}
    own = [t for t in got if t[0] == "cats sleep"]
    assert len(own) == 3 and (own[0][0], CHUNKS[0][4], CHUNKS[4][4]) in own and all(t[1] != t[2] and t[2] in texts for t in got)
    assert {t[1] for t in got if t[0] == "alone"} == {CHUNKS[7][4]} and len(got) == 6  # the file's first chunk; no row without a file
    assert sorted(map(tuple, feedback.text_triples(rows.repartition(7), chunked.repartition(5)).collect())) == got
    found = spark.createDataFrame([("pond", 1, "b/fish.md", CHUNKS[4][4]), ("pond", 2, "a/dogs.md", CHUNKS[2][4]), ("pond", 3, "c/stone.md", CHUNKS[7][4])], "query string, rank int, source_file string, text string")
    boot = sorted(map(tuple, feedback.case_triples(cases, chunked, found).collect()))
    pond = [t[2] for t in boot if t[0] == "pond"]
    assert len(boot) == 12 and len(pond) == 3 and {CHUNKS[2][4], CHUNKS[7][4]} <= set(pond) and not any("fish" in x for x in pond)
    heads = feedback.structural_triples(chunked.withColumn("text", F.concat("text", F.lit(" " * 40), F.lit("end"))), negatives=2).collect()
    assert len(heads) == 16 and all(r.pos != r.neg for r in heads)
    assert feedback.text_triples(rows.limit(0), chunked).count() == 0


def test_cases_and_triples_files(spark, tmp_path, cases):
    notes.write_cases(cases, str(tmp_path / "c"))
    assert sorted(map(tuple, notes.read_cases(spark, str(tmp_path / "c")).collect())) == sorted(CASES)
    (tmp_path / "t.json").write_text(json.dumps([["q", "p", "n"], ["q", "p", ["n1", "n2"]], ["short"]], indent=1))
    assert sorted(map(tuple, notes.read_triples(spark, str(tmp_path / "t.json")).collect())) == [("q", "p", "n"), ("q", "p", "n1"), ("q", "p", "n2")]
