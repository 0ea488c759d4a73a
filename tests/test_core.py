"""Exact unit fixtures for the core operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteweave.functions import text as tx
from noteweave.operators import audit, browse, evaluate, feedback, index, ingest, lsa, ranking
from noteweave.sources import notes as src
from noteweave.sources import state
from noteweave.streaming import feedback as stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("text, want", [
    ("你好世界", ["你好", "你好世", "好世", "好世界", "世界"]),
    ("你好, world 世界 ABC-12é", ["你好", "你好世", "好世", "好世界", "世界", "world", "abc", "12"]),
    ("单", []), ("", []), (None, []), ("Ünter éa b", ["nter", "a", "b"]),
])
def test_tokens(spark, text, want):
    assert frame(spark, [(text,)], "t string").select(tx.tokens(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("body, want", [
    ("# A\n### C", "A > C"), ("# A\n### C\n## B", "A > B"), ("# A\n### C\n## B\n### D", "A > B > D"),
    ("### C\n## B", "C > B"), ("# A\n###nope", "A"), ("x", ""),
])
def test_heading_stack(spark, body, want):
    found = ingest.sections(frame(spark, [("p", body)], "path string, body string")).orderBy(F.desc("section")).first()
    assert found.header_path == want


def test_chunks(spark):
    rows = [("d/a.md", "# H\n" + "x" * 20 + "\n## I\n" + "y" * 21), ("b.md", "z" * 30), ("c.md", "short"), ("e.md", "  ")]
    got = {r.source_file: r for r in ingest.chunks(frame(spark, rows, "path string, body string")).collect()}
    assert set(got) == {"d/a.md", "b.md", "c.md"}
    assert (got["d/a.md"].header_path, got["d/a.md"].chunk_index) == ("H > I", 0)
    assert got["b.md"].header_path == "b" and got["c.md"].text == "short"


def test_sections_keep_every_line(spark):
    """Against a plain loop over the lines, with odd line ends, empty titles and headings side by side."""
    import re

    bodies = ["", "\n", "a\n\n# H\n\nb\n", "# A\n# B\n\n## C\nx\n###nope\n####### no\n#### D \ny", "pre\r\n# T\r\nbody\r\n", "#\t\n## \nz", "# a\u2028b\ntext\n# c\u2028", "x\n# H", "# H\n", None]
    rows = ingest.sections(frame(spark, list(enumerate(bodies)), "path int, body string"))
    got = {(r.path, r.section): (r.header_path, r.text) for r in rows.collect()}
    want = {}
    for k, body in enumerate(bodies):
        stack, n, own = [], 0, {}
        for line in (body or "").split("\n"):
            found = re.match(r"(#{1,6})[ \t\r\x0b\f]+([^\r\u0085\u2028\u2029]*)[\r\u0085\u2028\u2029]?$", line)
            if found:
                n += 1
                stack = [*stack[: len(found[1]) - 1], found[2].strip(" ")]
            else:
                own.setdefault(n, []).append(line)
            own.setdefault(n, [])
            want[k, n] = (" > ".join(stack), None)
        want |= {(k, m): (want[k, m][0], "\n".join(lines)) for m, lines in own.items()}
    assert got == want
    plan = ingest.chunks(frame(spark, list(enumerate(bodies)), "path int, body string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_front_matter(spark):
    raw = "---\nmemory_type: fact\ntags: [a, 'b']\ndate_updated: 2026-01-02\n---\nbody\nmore"
    got = ingest.front_matter(frame(spark, [(raw,), ("no front",), (None,)], "raw string")).collect()
    assert (got[0].memory_type, got[0].tags, got[0].date_updated, got[0].body) == ("fact", "a|b", "2026-01-02", "body\nmore")
    assert (got[1].memory_type, got[1].body, got[1].has_front_matter) == ("unknown", "no front", False)
    assert got[2].body == ""


DOCS = [(0, "alpha beta beta"), (1, "alpha gamma"), (2, "delta")]


def test_bm25(spark):
    docs, asked = frame(spark, DOCS, "doc_id long, text string"), frame(spark, [(9, "alpha beta alpha"), (8, "nothing")], "query_id long, query string")
    got = [(r.query_id, r.rank, r.doc_id, r.score) for r in ranking.bm25(docs, asked).orderBy("query_id", "rank").collect()]
    assert got == [(9, 1, 0, 1.590851), (9, 2, 1, 0.470004)]
    assert ranking.bm25(docs.limit(0), asked).count() == 0


def test_bm25_equals_plain_python(spark):
    rows = [(i, " ".join("abcdefgh"[(i * j) % 8] for j in range(1, 3 + i % 5))) for i in range(30)]
    lists = {i: t.split() for i, t in rows}
    avg = sum(map(len, lists.values())) / len(lists)
    want = {}
    for i, words in lists.items():
        score = 0.0
        for term in {"b", "c", "h"}:
            df = sum(term in x for x in lists.values())
            f = words.count(term)
            if f:
                score += math.log(1 + (len(lists) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if score:
            want[i] = round(score, 6)
    got = ranking.bm25(frame(spark, rows, "doc_id long, text string"), frame(spark, [(0, "b c h b")], "query_id long, query string"))
    assert {r.doc_id: r.score for r in got.collect()} == pytest.approx(want)


def test_fusion(spark):
    v = frame(spark, [(1, 1, 1, 0.9), (1, 2, 2, 0.8)], "query_id long, rank int, doc_id long, score double")
    w = frame(spark, [(1, 1, 1, 3.0), (1, 2, 3, 2.0)], "query_id long, rank int, doc_id long, score double")
    got = [(r.doc_id, round(r.fused, 6)) for r in ranking.hits(ranking.fuse(v, w), 9).orderBy("rank").collect()]
    assert got == [(1, 0.032787), (2, 0.016129), (3, 0.016129)]
    heavy = [(r.doc_id, round(r.fused, 6)) for r in ranking.hits(ranking.fuse(v, w, 10, 0), 9).orderBy("rank").collect()]
    assert heavy == [(1, 0.163934), (2, 0.16129), (3, 0.0)]


def test_single_channels(spark):
    docs = frame(spark, DOCS, "doc_id long, text string")
    asked = frame(spark, [(1, "alpha beta")], "query_id long, query string")
    for mode, other in (("keyword", "similarity"), ("vector", "bm25")):
        got = ranking.search(docs, asked, 5, None, mode).collect()
        assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [0, 1] and all(r[other] is None for r in got)


def test_nearest(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, None)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ranking.nearest(spark, v, v.filter("vec_id = 3"), 2).collect()}
    assert got == {(3, 1): (3, 1.0), (3, 2): (2, 0.8)}
    far = ranking.nearest(spark, v, v.filter("vec_id = 1"), 3, metric="l2").collect()
    assert {r.vec_id: round(r.score, 5) for r in far} == {1: 1.0, 3: 0.2, 2: -1.0}


def test_gold_pairs(spark):
    docs = frame(spark, [(1, "one two three four"), (2, "zone two threes"), (3, "solo")], "doc_id long, text string")
    items = frame(spark, [(7, "one two three"), (8, "solo"), (9, "four five six")], "item_id long, text string")
    assert {tuple(r) for r in ranking.gold_pairs(docs, items).collect()} == {(7, 1), (7, 2), (8, 3)}


def test_predicate(spark):
    docs = frame(spark, [(1, "active", "dir/x.md"), (2, None, "y.md")], "doc_id long, status string, file string")
    count = lambda where: docs.filter(browse.matches(where)).count()
    assert [count({}), count({"status": "active"}), count({"file": {"contains": "x"}}), count({"status": ""}), count({"status": "active", "file": {"contains": "y"}})] == [2, 1, 1, 1, 0]


def test_metrics(spark):
    first = frame(spark, [(1, 1), (2, 3), (3, None), (4, 5)], "query_id long, first int")
    assert tuple(evaluate.metrics(first).first()) == (4, 0.25, 0.75, 0.383333)
    assert tuple(evaluate.metrics(first.limit(0)).first()) == (0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("base, hit5, mrr, want", [(0.90, 0.85, 0.88, True), (0.90, 0.85, 0.879, False), (0.90, 0.84, 0.95, False), (0.4, 0.9, 0.4, True)])
def test_gate(spark, base, hit5, mrr, want):
    assert feedback.gate(frame(spark, [(hit5, mrr, base)], "hit5 double, mrr double, base_mrr double")).first().passed is want


@pytest.mark.parametrize("row, want", [((9, 0.1, 50, 0.9), "keep"), ((20, 0.5, 20, 0.35), "rollback"), ((20, 0.5, 20, 0.45), "keep"), ((20, 0.5, 20, 0.5), "keep"), ((20, 0.5, 20, 0.55), "promote")])
def test_decision(spark, row, want):
    assert feedback.decide(frame(spark, [row], "n_base long, rate_base double, n_cand long, rate_cand double")).first().action == want


def test_feedback_stats(spark):
    rows = [("r1", True, "f1", 1), ("r2", False, "f1", 2), ("r1", False, "f1", 3), ("r3", True, "", 4)]
    last = feedback.latest(frame(spark, rows, "result_id string, adopted boolean, file string, seq long"), ["result_id"], ["seq"])
    assert tuple(feedback.totals(last).first()) == (3, 1, 2, 0.333333, "33.3%")
    assert {tuple(r) for r in feedback.by_file(last, "file").collect()} == {("f1", 0, 2), ("(none)", 1, 0)}
    assert feedback.totals(last.limit(0)).first().rate == 0.0


def test_difference_and_upsert(spark):
    old = frame(spark, [("a", "h1"), ("b", "h2"), ("c", "h3")], "id string, content_hash string")
    new = frame(spark, [("a", "h1"), ("b", "h9"), ("d", "h4")], "id string, content_hash string")
    assert {tuple(r) for r in ingest.difference(old, new).collect()} == {("a", "keep"), ("b", "update"), ("c", "delete"), ("d", "insert")}
    after = ingest.upsert(old, new)
    assert {tuple(r) for r in after.collect()} == {("a", "h1"), ("b", "h9"), ("d", "h4")}
    assert {r.action for r in ingest.difference(after, new).collect()} == {"keep"}


def test_audit(spark):
    rows = [("a", "fact", "", "2026/01/01", "1.2", None), ("b", "task_state", "x", "2025-12-31", "high", "2025-01-01"), ("c", "task_state", "x", "2026-01-01", "0.5", "2027-01-01")]
    d = frame(spark, rows, "file string, memory_type string, source string, date_updated string, confidence string, expiry string")
    names = lambda x: {(r.code, r.file) for r in x.collect()}
    assert names(audit.required_fields(d, {"fact": ("source",)}, "memory_type", "file")) == {("missing_field", "a")}
    assert names(audit.bad_dates(d, ("date_updated",), "file")) == {("bad_date", "a")}
    assert names(audit.bad_confidence(d, "confidence", "file")) == {("out_of_range", "a"), ("not_numeric", "b")}
    assert names(audit.stale(d, "memory_type", "date_updated", "file", "2026-01-31")) == {("stale", "b")}
    assert names(audit.expired(d, "expiry", "file", "2026-01-31")) == {("expired", "b")}
    assert names(audit.expiry_before_update(d, "expiry", "date_updated", "file")) == {("expiry_before_update", "b")}
    bodies = frame(spark, [("s", "x" * 49), ("l", "x" * 50)], "file string, body string")
    assert names(audit.short_bodies(bodies, "body", "file")) == {("short_body", "s")}


def test_links(spark):
    d = frame(spark, [("n", "[[X]] [[X#h]] [[X|alias]] [[note]] [[]]")], "file string, body string")
    known = frame(spark, [("dir/note",)], "name string")
    gone = audit.broken(audit.links(d, "file", "body"), known)
    assert [tuple(r) for r in audit.broken_summary(gone).collect()] == [("X", 3, 1, "n", False)]


def test_sources(spark, tmp_path):
    (tmp_path / "v/.trash").mkdir(parents=True)
    (tmp_path / "v/a.md").write_text("# A")
    (tmp_path / "v/.trash/b.md").write_text("# B")
    assert [tuple(r) for r in src.read_notes(spark, f"{tmp_path}/v").collect()] == [("a.md", "# A")]
    (tmp_path / "f.jsonl").write_text('{"result_id": "r1", "adopted": true}\n\nnot json\n{"result_id": "r2", "adopted": false}\n')
    assert src.read_jsonl(spark, f"{tmp_path}/f.jsonl", src.FEEDBACK).count() == 2
    (tmp_path / "c.json").write_text(json.dumps([{"query": "q", "source_file": "f"}]))
    assert tuple(src.read_cases(spark, f"{tmp_path}/c.json").first()) == ("q", "f")
    rows = frame(spark, [(1,)], "id long")
    src.write_collection(rows, f"{tmp_path}/t", "one")
    src.write_collection(rows.union(rows), f"{tmp_path}/t", "two")
    assert (src.read_collection(spark, f"{tmp_path}/t", "one").count(), src.read_collection(spark, f"{tmp_path}/t", "two").count()) == (1, 2)


def test_state(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"version": 3, "ab": {"enabled": True, "candidate_collection": "c4"}}))
    loaded = state.load(spark, f"{tmp_path}/s.json")
    assert (loaded.first().active_model, loaded.first().ab.traffic_ratio) == ("lexical", 0.2)
    after = state.transition(loaded, "promote", "now").first()
    assert (after.version, after.active_collection, after.ab.enabled) == (4, "c4", False)


def test_streams(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text('{"k": "a", "n": 1, "adopted": true}\nbad\n{"k": "a", "n": 2, "adopted": false}\n')
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("k string, n long, adopted boolean")
    last = stream.latest(stream.read_log(spark, f"{tmp_path}/log", schema), ["k"], ["n"], ["n", "adopted"])
    assert [tuple(r) for r in stream.drain(last, f"{tmp_path}/cp", f"{tmp_path}/rows").collect()] == [("a", 2, False)]


def test_corpus_digest_depends_on_tokens(spark):
    docs = frame(spark, DOCS, "doc_id long, text string")
    digest = lambda d: index.corpus_digest(index.tokenised(d)).collect()
    assert digest(docs) == digest(docs.orderBy(F.desc("doc_id"))) != digest(docs.withColumn("text", F.concat("text", F.lit(" x"))))


def test_lsa_equals_dense_svd(spark, sf):
    """Cosines in the latent space equal those of a dense SVD; signs and rotations are free."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    rows = lsa.weighted(docs).persist()
    got = {r.vec_id: np.array(r.embedding) for r in lsa.transform(spark, rows, lsa.fit(spark, rows, rank=5, rounds=30)).collect()}
    cells = rows.collect()
    terms = {t: i for i, t in enumerate(sorted({t for r in cells for t in r.terms}))}
    dense = np.zeros((len(cells), len(terms)))
    for n, r in enumerate(cells):
        dense[n, [terms[t] for t in r.terms]] = r.weights
    vectors = dense @ np.linalg.svd(dense, full_matrices=False)[2][:5].T
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    mine = np.stack([got[r.doc_id] for r in cells])
    assert np.abs(mine @ mine.T - vectors @ vectors.T).max() < 0.02


def test_lsa_as_registered(spark, sf):
    """The rank and rounds of the query: all but one component of 60 documents; the model as a table gives the same vectors."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    rows = lsa.weighted(docs).persist()
    model = lsa.fit(spark, rows)
    cells = rows.collect()
    assert model[1].shape == (len(model[0]), min(384, len(cells) - 1, len(model[0])))
    terms = {t: i for i, t in enumerate(model[0].to_pylist())}
    dense = np.zeros((len(cells), len(terms)))
    for n, r in enumerate(cells):
        dense[n, [terms[t] for t in r.terms]] = r.weights
    vectors = dense @ np.linalg.svd(dense, full_matrices=False)[2][: model[1].shape[1]].T
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    for held in (model, lsa.from_table(lsa.as_table(spark, model))):
        got = {r.vec_id: np.array(r.embedding) for r in lsa.transform(spark, rows, held).collect()}
        mine = np.stack([got[r.doc_id] for r in cells])
        assert np.abs(mine @ mine.T - vectors @ vectors.T).max() < 1e-3
    empty = rows.limit(0)
    assert lsa.transform(spark, empty, lsa.fit(spark, empty)).count() == 0


def test_truncated_svd_to_a_tolerance(spark):
    """Below the full rank: rounds end by the residual, and the vectors span what a dense decomposition gives."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[10 * (i % 6) : 10 * (i % 6) + 14], 30)) for i in range(120)]
    rows = lsa.weighted(frame(spark, list(enumerate(texts)), "doc_id long, text string")).persist()
    cells = rows.collect()
    model = lsa.fit(spark, rows, 5, rounds=40, tolerance=1e-4)
    assert lsa.residuals(spark, rows, model).max() <= 1e-4
    assert lsa.residuals(spark, rows, lsa.fit(spark, rows, 5, rounds=1, tolerance=1e-4)).max() > 1e-4
    terms = {t: i for i, t in enumerate(model[0].to_pylist())}
    dense = np.zeros((len(cells), len(terms)))
    for n, r in enumerate(cells):
        dense[n, [terms[t] for t in r.terms]] = r.weights
    want = np.linalg.svd(dense, full_matrices=False)[2][:5].T
    assert np.linalg.svd(want.T @ model[1])[1].min() > 0.999


def test_search_with_latent_vectors(spark):
    """Unseen queries are folded in, the predicate holds in both channels, and each hit names its channel."""
    animals, plants = "cat dog horse cow sheep".split(), "oak fern moss rose pine".split()
    rows = [(i, " ".join(g[(i + j) % 5] for j in range(3)), g[0]) for i in range(20) for g in [animals if i % 2 else plants]] + [(90, "unique oddity", "x")]
    docs = frame(spark, rows, "doc_id long, text string, kind string")
    idf = ranking.idf_table(docs).persist()
    model = lsa.fit(spark, lsa.folded(docs, idf).persist(), 2)
    asked = frame(spark, [(1, "horse horse unseen"), (2, "oddity"), (3, "unknown words")], "query_id long, query string")
    got = [r.asDict() for r in lsa.search(spark, docs, asked, idf, model, 30).collect()]
    one = [r for r in got if r["query_id"] == 1]
    without = [r for r in one if r["channel"] == "vector"]
    assert {r["doc_id"] % 2 for r in one if r["similarity"] and r["similarity"] > 0.5 and r["doc_id"] != 90} == {1} and without and all(r["bm25"] is None for r in without)
    assert any(r["channel"] == "both" for r in one) and [r["doc_id"] for r in got if r["query_id"] == 2 and r["bm25"]] == [90] and not [r for r in got if r["query_id"] == 3]
    few = lsa.search(spark, docs, asked, idf, model, 30, browse.matches({"kind": "oak"})).collect()
    assert few and all(r.doc_id % 2 == 0 and r.doc_id < 90 for r in few)


def test_gold_pairs_in_scripts_without_tokens(spark, monkeypatch):
    """Cyrillic, Greek, Thai and marks, in several automata, repeated and overlapping items: equal to a comparison of all."""
    import random

    monkeypatch.setattr(ranking, "SHORT_ITEMS", 7)
    rng = random.Random(5)
    alphabet = "абвгαβγกขค. "
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    items = ["".join(rng.choices(alphabet, k=rng.randint(1, 4))) for _ in range(40)] + ["", None, "абв", "абв", "бв"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ranking.gold_pairs(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted((r.item_id, r.doc_id) for r in rows.collect()) == sorted((k, i) for i, t in enumerate(texts) if t is not None for k, item in enumerate(items) if item is not None and item in t)
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()


def test_gold_pairs_are_containment(spark):
    """Short and mixed-script items, and items that begin or end inside a word."""
    from noteweave.operators import ranking

    texts = ["xabc 中文字 defg", "abc", "hello world", "say hello worlds", "中", "a b c d", "", "the mid word here", None]
    items = ["abc 中文字 def", "bc", "hello world", "中", "b", "b c", "id word her", "", "...", None, "文"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in ranking.gold_pairs(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).select("item_id", "doc_id").collect()}
    assert got == {(k, i) for i, t in enumerate(texts) if t is not None for k, item in enumerate(items) if item is not None and item in t}


NOTES = [
    ("a.md", "no front matter, and [[gone]] with [[b]] in a body that is long enough for the rules"),
    ("b.md", "---\nmemory_type: fact\nsource: s\ndate_updated: 2026-01-30\n---\n" + "words " * 20),
    ("c.md", "---\nstatus: odd\nconfidence: 2\nexpiry: 2025-01-01\n---\nshort"),
    ("模板/t.md", "---\nmemory_type: wrong\nexpiry: 2025-01-01\n---\n"),
    ("d/bad.md", "---\nmemory_type: [fact\n---\nshort [[nowhere]]"),
    ("d/empty.md", "---\n---\n" + "words " * 20 + "[[#here]] [[]] [[ ]] [[d\\bad|alias]] [[empty#a|b]]"),
    ("d/old.md", "---\nmemory_type: experience\ndate_updated: 2025-02-01\n---\n" + "words " * 20),
    ("d/older.md", "---\nmemory_type: preference\nowner: o\ndate_updated: 2025-07-31\n---\n" + "words " * 20),
    ("d/form.md", "---\nmemory_type: fact\nsource: s\ndate_updated: 2026/01/30\nexpiry: 2026-01-02x\n---\n" + "words " * 20),
    ("d/typed.md", "---\nmemory_type: task_state\nstatus: [active]\nconfidence: .5\ndate_updated: '2026-01-30'\nexpiry: 2026-01-29\n---\n" + "words " * 20),
]
ISSUES = [
    ("A", "no_front_matter", "a.md"), ("A", "missing_type", "c.md"), ("A", "missing_field", "c.md"), ("A", "bad_status", "c.md"), ("A", "out_of_range", "c.md"), ("A", "bad_type", "模板/t.md"),
    ("A", "bad_front_matter", "d/bad.md"), ("A", "no_front_matter", "d/empty.md"), ("A", "bad_date", "d/form.md"), ("A", "bad_date", "d/form.md"), ("A", "expiry_before_update", "d/typed.md"),
    ("B", "expired", "c.md"), ("B", "expired", "模板/t.md"), ("B", "expired", "d/typed.md"), ("B", "stale", "d/older.md"), ("C", "broken_link", "a.md"), ("D", "short_body", "c.md"), ("D", "short_body", "模板/t.md"),
]


def test_audit_run(spark):
    """Ages by type, templates, unparsable, empty and missing front matter, forms of dates, links without a target."""
    notes = ingest.front_matter(spark.createDataFrame(NOTES, "path string, raw string"))
    indexed = spark.createDataFrame([("b.md",), ("old.md",), ("d/older.md",), ("d/form.md",), ("d/typed.md",), ("d/old.md",), ("d/empty.md",)], "path string")
    got = sorted((r.dimension, r.code, r.file) for r in audit.run(notes, "2026-01-31", indexed).collect())
    assert got == sorted([*ISSUES, ("E", "index", "a.md"), ("E", "index", "old.md")])
    assert tuple(audit.coverage(notes).first()) == (10, 7, 5)
    lines = [r.line for r in audit.report_text(audit.run(notes, "2026-01-31"), 3).collect()]
    assert [x for x in lines if x.startswith("## ")] == ["## A. Front matter (11)", "## B. Expired and stale (4)", "## C. Broken links (1)", "## D. Contents (2)", "## E. Index (0)"]
    assert "- and 8 more" in lines and "- a.md: broken_link gone" in lines


def test_audit_of_a_folder(spark, tmp_path):
    root = tmp_path / "v"
    for path, raw in [*NOTES, ("x{1}/[a].md", "words " * 20 + "[[files/p.pdf]] [[p.pdf]] [[.trash/gone.md]]")]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(raw)
    for hidden in (".obsidian", ".trash", "d/.obsidian", "files"):
        (root / hidden).mkdir(parents=True, exist_ok=True)
    (root / "files/p.pdf").write_text("x")
    for hidden in (".obsidian/n.md", ".trash/gone.md", "d/.obsidian/n.md"):
        (root / hidden).write_text("---\nbad: [\n---\n")
        (root / hidden).chmod(0)
    got = sorted((r.dimension, r.code, r.file) for r in audit.vault(spark, str(root), "2026-01-31").collect())
    assert got == sorted([*ISSUES, ("A", "no_front_matter", "x{1}/[a].md")])
    assert [r.code for r in audit.vault(spark, str(tmp_path / "none"), "2026-01-31").collect()] == ["no_vault"]
    paths = [r.path for r in src.read_notes(spark, str(root), ordered=True).collect()]
    assert paths == sorted(p for p, _ in [*NOTES, ("x{1}/[a].md", "")] if not p.startswith("模板"))
    assert not any(x.rsplit("/", 1)[-1] in src.EXCLUDED for x in src.folders(spark, str(root)))
    assert src.read_notes(spark, str(tmp_path / "v/.trash"), excluded=("none",)).columns == ["path", "raw"]


@pytest.mark.parametrize("text, want", [
    ("a: 1\nb: -2.5\nc: true\nd: ~\ne: 2026-01-02\nf: '1'", {"a": 1, "b": -2.5, "c": True, "d": None, "e": "2026-01-02", "f": "1"}),
    ("m:\n  n:\n    k: v # note\n  l:\n  - 1\n  - x: y\n    z: [p, 'q, r']\nt: done", {"m": {"n": {"k": "v"}, "l": [1, {"x": "y", "z": ["p", "q, r"]}]}, "t": "done"}),
    ("a: |\n  one\n    two\n\n  three\nb: >-\n  x\n  y\n\n  z", {"a": "one\n  two\n\nthree\n", "b": "x y\nz"}),
    ('"q k": "a\\n\\"b"\nu: http://x.y/#z\nw: one\n  two\nl: [a,\n  b]\nf: {a: 1, b: [c]}', {"q k": 'a\n"b', "u": "http://x.y/#z", "w": "one two", "l": ["a", "b"], "f": {"a": 1, "b": ["c"]}}),
    ("# only a comment", None), ("", None), ("- a\n- - b\n", ["a", "- b"]),
])
def test_front_matter_values(text, want):
    from noteweave.functions import front_matter

    assert front_matter.parse(text) == want


@pytest.mark.parametrize("text", ["a: b: c", "a: [1", 'a: "x', "\ta: 1", "a: 1\n b: 2", "a: *x", "- a\nb: 1", "a: {b: 1", "a: 1\ntext", "a: 'x' y", "a: @x"])
def test_front_matter_errors(text):
    from noteweave.functions import front_matter

    with pytest.raises(front_matter.Malformed):
        front_matter.parse(text)


def test_front_matter_keeps_types(spark):
    raw = "---\nmemory_type: fact\nconfidence: 0.5\nnested:\n  k: [1, two]\n---\nbody"
    row = ingest.front_matter(spark.createDataFrame([(raw,), ("---\na: [\n---\nb",), ("---\ntext\n---\nb",)], "raw string"))
    got = row.select("has_front_matter", "front_matter_error", "confidence", F.variant_get("metadata", "$.nested.k[1]", "string").alias("k"), F.schema_of_variant(F.variant_get("metadata", "$.confidence", "variant")).alias("t"), "body").collect()
    assert (got[0].has_front_matter, got[0].confidence, got[0].k, got[0].body) == (True, "0.5", "two", "body") and got[0].t.startswith(("DECIMAL", "DOUBLE"))
    assert [(r.has_front_matter, r.front_matter_error is None, r.body) for r in got[1:]] == [(False, False, "b"), (False, True, "b")]


def test_upsert_of_repeated_ids(spark):
    old = spark.createDataFrame([(1, "a", "x")], "id long, content_hash string, v string")
    new = spark.createDataFrame([(1, "a", "y"), (1, "b", "z"), (2, "c", "c"), (2, "d", "d")], "id long, content_hash string, v string")
    after = ingest.upsert(old, new)
    assert sorted(map(tuple, after.collect())) == [(1, "b", "z"), (2, "d", "d")]
    assert {(r.id, r.action) for r in ingest.difference(old, new).collect()} == {(1, "update"), (2, "insert")}
    assert {r.action for r in ingest.difference(after, new).collect()} == {"keep"}


def test_summary_of_a_sync(spark, tmp_path):
    """Counted once, kept while the total agrees, and counted anew where it does not."""
    docs = frame(spark, [(1, "a", "fact"), (2, "a", None), (3, "b", "fact")], "doc_id long, file string, kind string")
    ask = lambda rows, now: browse.summary(spark, f"{tmp_path}/s", rows, "file", "kind", now).first()
    first = ask(docs, "one")
    assert (first.total_chunks, first.total_files, first.type_distribution, first.last_sync) == (3, 2, {"fact": 2, "unknown": 1}, "one")
    assert ask(docs, "two").last_sync == "one" and ask(docs.limit(2), "three").last_sync == "three"
    assert [browse.clamped(x, 50) for x in (-1, 0, 7, "60")] == [1, 1, 7, 50]


def test_sources_of_a_sync(spark, tmp_path):
    from noteweave.operators import feedback
    from noteweave.sources import notes

    counts = spark.createDataFrame([(3, "x")], "files long, at string")
    assert notes.read_summary(spark, f"{tmp_path}/s", counts.schema.simpleString()[7:-1].replace(":", " ")).count() == 0
    notes.write_summary(counts, f"{tmp_path}/s")
    assert [tuple(r) for r in notes.read_summary(spark, f"{tmp_path}/s", "files long, at string").collect()] == [(3, "x")]
    rows = spark.createDataFrame([("q", "p", "n"), ("q", "p", "m")], "query string, pos string, neg string")
    assert feedback.training_set(rows, rows, least=3).count() == 4 and feedback.training_set(rows, rows, least=2).count() == 2
    assert feedback.positive_pairs(rows).count() == 1 and feedback.newest(rows, ["neg"], 1).first().neg == "n"
