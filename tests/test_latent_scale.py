"""Latent vectors fold documents within their rows, keep earlier products, and count tokens in arrays."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noteweave.functions import words
from noteweave.functions.text import tokens
from noteweave.operators import index, lsa, ranking, shards

ODD = ["", None, "abc", "ABC def", "中", "中文", "a中b文c字", "Z", "9鿿一", "é中à文", "😀中😀文x", "x" * 50, "㐀䷿一鿿ꀀ中", "a", "İIK K", "the cat  the Cat"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_equal_tokens(spark, monkeypatch):
    """Texts that end and begin with letters, null, empty, CJK over gaps, other scripts; slices of any size."""
    want = [Counter(r.t) for r in spark.createDataFrame(list(enumerate(ODD)), "i int, text string").orderBy("i").select(tokens(F.col("text")).alias("t")).collect()]
    for most in (1, 20, 1 << 20):
        monkeypatch.setattr(words, "SLICE", most)
        for texts, expected in ((pa.array(ODD), want), (pa.array(ODD).slice(3), want[3:]), (pa.array([], pa.string()), [])):
            got = [Counter() for _ in texts]
            for start, part in words.slices(texts):
                row, word, freq, own = words.counted(part)
                for r, w, f in zip(row.tolist(), own.take(pa.array(word)).to_pylist(), freq.tolist(), strict=True):
                    got[start + r][w] += f
            assert got == expected


def test_vectors_are_folded_within_rows(spark, monkeypatch):
    """No shuffle of unique ids; repeated and null ids are one document each; equal to postings joined with idf."""
    monkeypatch.setattr(index, "HELD_WORDS", 3)
    unique = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    again = unique.union(spark.createDataFrame([(3, "more def abc"), (3, "xyz uvw"), (None, "abc"), (None, "def abc")], "doc_id long, text string"))
    for docs in (unique, again, unique.limit(0)):
        each = index.postings(index.tokenised(docs))
        counts = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("total"))
        assert sorted(index.term_counts(docs).collect()) == sorted(counts.collect())
        idf = ranking.idf_table(docs, 12).persist()
        flat = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, t, round(w, 9)) for r in rows for t, w in zip(r.terms, r.weights, strict=True))
        got = lsa.folded(docs, idf).collect()
        assert flat(got) == sorted((r.doc_id is None, r.doc_id or 0, r.term, round(r.weight, 9)) for r in ranking.weights(each, idf).collect())
        assert len(got) == len({r.doc_id for r in got})
    idf = ranking.idf_table(unique).persist()
    idf.count()
    assert "Exchange" not in plan(lsa.folded(unique, idf))


def test_rounds_keep_earlier_products(spark, monkeypatch):
    """A flat spectrum: the vectors reach the tolerance after fewer products than by repeated multiplication, and have no less of the matrix."""
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 1501) ** 0.8
    texts = [" ".join(f"w{i}" for i in rng.choice(1500, 30, p=share / share.sum())) for _ in range(1000)]
    rows, vocabulary = lsa.numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), idf := ranking.idf_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).persist())
    rows = rows.persist()
    dense = np.zeros((len(texts), len(vocabulary)))
    for r in rows.collect():
        dense[r.doc_id, r.numbers] = r.weights
    columns, rank, tolerance = [], 20, 1e-3
    product = lsa._product
    monkeypatch.setattr(lsa, "_product", lambda *a: columns.append(len(a[1])) or product(*a))
    names, found = lsa.fit(spark, rows, rank, rounds=40, tolerance=tolerance, vocabulary=vocabulary)
    monkeypatch.undo()
    x = np.linalg.qr(np.random.default_rng(42).standard_normal((len(vocabulary), rank + 10)))[0]
    for rounds in range(1, 41):
        y = dense.T @ (dense @ x)
        values, turn = np.linalg.eigh(x.T @ y)
        off = np.linalg.norm(y @ turn - x @ turn * values, axis=0)[::-1] / values[-1]
        if off[:rank].max() <= tolerance:
            break
        x = np.linalg.qr(y)[0]
    assert lsa.residuals(spark, rows, (names, found)).max() <= tolerance * 1.01
    assert sum(columns) < rounds * (rank + 10)
    assert np.linalg.norm(dense @ found) ** 2 >= values[::-1][:rank].sum() * 0.999
    assert np.abs(found.T @ found - np.eye(rank)).max() < 1e-4


def test_large_multiplicity_and_low_rank(spark):
    """Many equal singular values, and fewer than the rank: the vectors stay orthonormal, and hold the matrix as far as their rank allows."""
    apart = [(i, f"t{i % 40} t{i % 40}") for i in range(80)]
    few = [(i, "same words here") for i in range(30)]
    for rows, rank, held in ((apart, 25, 50), (apart, None, 80), (few, 2, 30), (few, None, 30)):
        cells = lsa.weighted(spark.createDataFrame(rows, "doc_id long, text string")).persist()
        names, found = lsa.fit(spark, cells, rank)
        number = {t: i for i, t in enumerate(names.to_pylist())}
        assert np.abs(found.T @ found - np.eye(found.shape[1])).max() < 1e-4
        mine = [np.array(r.weights) @ found[[number[t] for t in r.terms]] for r in cells.collect()]
        assert abs(np.linalg.norm(mine) ** 2 - held) < 0.01


def test_nearest_in_slices(spark, monkeypatch):
    """Ties, scores that are no number, and a best list that fills over several slices."""
    monkeypatch.setattr(ranking, "VECTORS", 3)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (40, 2)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, [float("nan"), 1.0]), (91, [float("inf"), 0.0]), (92, [1.0]), (93, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ranking.nearest(spark, df, df.filter("vec_id < 5"), 7).orderBy("query_id", "rank").collect()]
    every = {i: np.array(v) for i, v in rows if v and len(v) == 2}
    want = []
    with np.errstate(invalid="ignore"):
        for q in range(5):
            scores = {i: float(v @ every[q]) for i, v in every.items()}
            order = sorted((i for i, s in scores.items() if s == s and s > -np.inf), key=lambda i: (-scores[i], i))[:7]
            want += [(q, n + 1, i) for n, i in enumerate(order)]
    assert got == want


def test_shards_of_texts_cut_in_arrays(spark, monkeypatch):
    """The keyword channel of `search` reads texts once, without the JVM's tokens; shards, lists and statistics are those of `pack`."""
    monkeypatch.setattr(shards, "SHARD", 3)
    monkeypatch.setattr(words, "SLICE", 30)
    docs = spark.createDataFrame([(i, t, "x" if i % 2 else None) for i, t in enumerate(ODD * 2)], "doc_id int, text string, kind string").coalesce(1)
    wanted = {"abc", "中文", "the", "nowhere"}
    keep = F.col("kind") == "x"
    new, old = shards.pack_texts(docs, wanted, keep), shards.pack(shards.of_texts(docs, keep), wanted)
    assert new.schema == old.schema
    shown = lambda df: sorted(str([[round(y, 9) if isinstance(y, float) else y for y in x] if isinstance(x, list) else x for x in r]) for r in df.collect())
    assert shown(new) == shown(old)
    assert "regexp_extract_all" not in plan(new)
    queries = spark.createDataFrame([(1, "the abc 中文"), (2, "nowhere"), (3, "")], "query_id long, query string")
    few = shards.Shards(shards.pack(shards.of_texts(docs, keep), wanted))
    for channel in ("keyword", "vector"):
        rows = [sorted(shards.rank(x, queries, 4, (channel,)).collect()) for x in (few, shards.shards_of_texts(docs, queries, keep))]
        assert rows[0] == rows[1] and rows[0]
