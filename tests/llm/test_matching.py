"""SimHash, near-duplicates, decontamination and top-k search against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from noteweave.llm import bitsliced, decontaminate, simhash, simhash_dedup


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_golay_code():
    code = simhash.golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    near = code.near(words)
    assert set((near >= 0).sum(axis=1)) <= {1, 6}
    for bit in range(23):
        assert (code.nearest(words)[:, None] == code.near(words ^ (1 << bit))).any(axis=1).all()


@pytest.mark.parametrize("crowd", [5, 200])
def test_links_are_whole(spark, crowd):
    """Components equal brute force, also where a key is shared by more than the pairwise limit."""
    rng = random.Random(crowd)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(crowd):
            value = centre
            for bit in rng.sample(range(20), rng.randint(1, 4)) if crowd > 9 else rng.sample(range(64), rng.randint(1, 3)):
                value ^= 1 << bit
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame(list(zip(signed, range(len(values)), strict=True)), "fp long, node long")
    found = simhash.links(frame)
    pairs = {tuple(r) for r in found.collect()}
    close = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 2}
    assert pairs <= {p for p in close} | {(a, b) for a, b in pairs}
    assert groups(range(len(values)), pairs) == groups(range(len(values)), close)
    got = {r.node: r.component for r in simhash.components(found).collect()}
    assert {n: got.get(n, n) for n in range(len(values))} == groups(range(len(values)), close)


def test_near_duplicates_edges(spark):
    rows = [(5, None, 1), (4, "", 1), (3, " \t", 1), (2, "One two", 1), (7, "one TWO", 1), (9, "É b c d", 1), (10, "é b c d", 1), (7, "one two", 1), (None, "alone here now", 1)]
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    of = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert len(got) == len(rows)
    assert {c for (i, f), c in of.items() if f == "0" * 16} == {3}
    assert of[2, f"{xxh64_intdigest(b'one two', 42):016x}"] == 2 and {c for (i, _), c in of.items() if i == 7} == {2}
    assert simhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_deduplicate(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for g in range(40):
        words = rng.choices(vocabulary, k=rng.randint(30, 150))
        for c in range(rng.randint(1, 6)):
            edited = list(words)
            for _ in range(rng.choice([0, 0, 1, len(words) // 60])):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(edited), "x", g))
    rows += [(900, None, "x", 0), (901, None, "x", 0), (902, "", "x", 0), (0, rows[0][1], "x", rows[0][3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, third int")
    got = simhash_dedup.deduplicate(spark, docs)
    assert got.columns == docs.columns
    sets = {i: shingles(t or "") for i, t, _, _ in rows if i < 900}
    close = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {n for n, c in groups(sets, close).items() if n == c} | {900, 902}
    kept = sorted(r.doc_id for r in got.collect())
    assert kept == sorted(want)


def _check_groups(spark, texts):
    """Against brute force over all pairs."""

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {i: shingles(t) for i, t in enumerate(texts)}
    close = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash_dedup.deduplicate(spark, docs).collect())
    assert kept == sorted(n for n, c in groups(sets, close).items() if n == c)
    return sets, close


def test_deduplicate_finds_each_kind_of_edit(spark):
    """Appended, truncated, preceded and inserted blocks and swapped words at similarities from 0.81."""
    rng = random.Random(12)
    fresh = iter(f"w{i}" for i in range(1_000_000))
    texts = []
    for n in (60, 200, 500):
        for share in (0.81, 0.85):
            for edit in range(5):
                base = [next(fresh) for _ in range(n)]
                extra, left_out = [next(fresh) for _ in range(int((n - 8) / share) - n)], int((n - 4) * (1 - share))
                copy = [base + extra, base[: n - left_out], extra + base, base[: n // 2] + extra + base[n // 2 :], list(base)][edit]
                if edit == 4:
                    for at in rng.sample(range(0, n, 10), int((n - 4) * (1 - share) / (1 + share) / 5)):
                        copy[at] = next(fresh)
                texts += [" ".join(base), " ".join(copy)]
    _, close = _check_groups(spark, texts)
    assert len(close) == len(texts) // 2


def test_deduplicate_splits_hot_keys(spark, monkeypatch):
    """Near copies whose only shared keys are hot ones with smaller texts below 0.8 to all of them."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16, raising=False)
    fresh = iter(f"w{i}" for i in range(1_000_000))
    template = [next(fresh) for _ in range(104)]
    smaller = [template[:at] + template[at + 26 :] for at in (0, 26, 52, 78)]
    copies = [template + [next(fresh) for _ in range(10)] for _ in range(60)]
    _, close = _check_groups(spark, [" ".join(x) for x in smaller + copies])
    assert len(close) == 60 * 59 // 2 and min(map(min, close)) == 4


def test_leaks_of_short_and_unspaced_items(spark):
    """Items below five words match exactly; Chinese, Japanese and Thai by letters, within the edits."""
    long = "水稻的起源可以追溯到一万年前的长江中下游地区"
    items = [(1, "Quick brown fox"), (2, long), (3, "東京は日本の首都です"), (4, "ปลาวาฬอาศยอยในทะเล"), (5, "42")]
    rows = [
        (10, "the quick, brown FOX ran"),
        (11, "the quick red fox ran, brown"),
        (20, f"众所周知{long[:5]}地{long[6:]}而且"),
        (21, f"众所周知{long[:3]}甲乙丙丁戊己{long[9:]}而且"),
        (30, "実は東京は日本の首都です。"),
        (40, "กขคปลาวาฬอาศยอยในทะเลงจ"),
        (50, "answer: 42."),
        (51, "answer: 421"),
    ]
    docs, frame = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(spark, docs, frame).collect()}
    assert got == {(10, 1, 0), (20, 2, 1), (30, 3, 0), (40, 4, 0), (50, 5, 0)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(spark, docs, frame).collect()) == [11, 21, 51]


def test_leaks(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(6, 60)))) for k in range(30)] + [(98, "too short"), (99, None)]
    rows, planted = [], set()
    for i in range(120):
        body = rng.choices(vocabulary, k=200)
        if i % 2:
            k, text = rng.choice(items[:30])
            words = text.split()
            for _ in range(rng.randint(0, decontaminate.allowed(len(words)))):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [] if rng.random() < 0.3 else [rng.choice(vocabulary)]
            body[90:90] = words
            planted.add((i, k))
        rows.append((i, " ".join(body).upper()))
    rows += [(500, None), (501, ""), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(spark, docs, frame).collect()}

    def exact(item, text):
        a, b = decontaminate.words(item), decontaminate.words(text)
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    texts = dict(rows)
    want = {(i, k): d for i, t in texts.items() if t for k, item in items[:30] if (d := exact(item, t)) <= decontaminate.allowed(len(decontaminate.words(item)))}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and planted & set(want) == planted & set(got)
    left = {r.doc_id for r in decontaminate.without_leaks(spark, docs, frame).collect()}
    assert left == set(texts) - {i for i, _ in got}
    assert decontaminate.leaks(spark, docs, frame.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(700, 16))
    vectors[100:400] = vectors[100]  # ties
    rows = [(i, [float(x) for x in v], "a") for i, v in enumerate(vectors)] + [(1000, None, "a"), (1001, [1.0, None], "a"), (1002, [float("nan")] * 16, "a"), (1050, [1.0] * 8, "a"), (100, rows_ := [float(x) for x in vectors[100]], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in bitsliced.top_k(spark, frame, frame.filter("vec_id % 50 = 0")).collect()}
    whole = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = {}
    for q, w in {i: v for i, v in whole if i % 50 == 0}.items():
        scored = sorted((-int(v @ w), i) for i, v in whole if i != q and len(v) == len(w))
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(scored[:5], 1)}
    assert got == want
    assert bitsliced.top_k(spark, frame.limit(0), frame.limit(0)).count() == 0
    assert frame.filter(F.col("vec_id") == 100).count() == 2


def test_buckets_alone_find_items_at_the_edit_limit():
    """Without the filter by runs, the LSH buckets hold nearly all items at the largest distance, and few others."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    for n, passed in ((5, 1.0), (15, 0.5), (40, 0.15), (120, 0.05)):
        found = other = 0
        for _ in range(60):
            item = rng.choices(vocabulary, k=n)
            copy = list(item)
            for at in sorted(rng.sample(range(n), decontaminate.allowed(n)), reverse=True):
                copy[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocabulary)]])
            index = decontaminate.Index([(1, item)])
            group = index.groups[0]
            group.windows = lambda known: np.arange(len(known))
            group.need = 0
            for own, text in ((True, rng.choices(vocabulary, k=50) + copy + rng.choices(vocabulary, k=50)), (False, rng.choices(item, k=200))):
                numbers = np.array([index.vocabulary.get(w, 0) for w in text])
                starts = group.candidates(numbers, np.zeros(0, np.int64), np.zeros(0, np.int64))
                if own:
                    found += index.best(0, sorted(starts[0]), numbers) is not None
                else:
                    other += len(starts[0]) / 400
        assert found >= 0.97 * 60 and other / 60 <= passed


@pytest.mark.parametrize("n", [5, 12, 40, 90, 128, 150, 260, 400, 1000, 2000])
@pytest.mark.parametrize("kind", ["scattered", "head", "tail", "both ends", "cut", "middle"])
def test_recall_by_length_and_place_of_the_edits(n, kind):
    """All allowed edits in one place: 0.9 of such copies are found at least (by search, not only by the filter)."""
    rng = random.Random(f"{n} {kind}")
    vocabulary = [f"w{i}" for i in range(3000)]
    e, trials = decontaminate.allowed(n), 10
    places = {"head": range(e), "tail": range(n - e, n), "both ends": [*range(e // 2), *range(n - (e - e // 2), n)], "middle": range((n - e) // 2, (n - e) // 2 + e)}
    found = 0
    for _ in range(trials):
        item = rng.choices(vocabulary, k=n)
        if kind == "cut":
            copy = item[e // 2 : n - (e - e // 2)]
        else:
            edited = set(places.get(kind) or rng.sample(range(n), e))
            copy = [x for i, w in enumerate(item) for x in (rng.choice([[], [rng.choice(vocabulary)], [rng.choice(vocabulary), w]]) if i in edited else [w])]
        text = " ".join(rng.choices(vocabulary, k=60) + copy + rng.choices(vocabulary, k=60))
        found += bool(decontaminate.Index([(1, item)]).hits(text))
    assert found >= 0.9 * trials


def test_leaks_in_edge_cases(spark):
    """Very long texts and items, items in several blocks, clashing names, no documents."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    long = rng.choices(vocabulary, k=3000)
    copy = list(long)
    for at in rng.sample(range(3000), 300):
        copy[at] = "x"
    rows = [(1, " ".join(rng.choices(vocabulary, k=30000) + copy), "a", "b"), (2, " ".join(rng.choices(vocabulary, k=3000)), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, c0 string")
    items = spark.createDataFrame([(7, " ".join(long)), (7, " ".join(long))], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.leaks(spark, docs, items).collect()]
    assert len(got) == 2 and {(i, k) for i, k, *_ in got} == {(1, 7)} and all(x[2] <= 300 for x in got)
    unnamed = spark.createDataFrame([(None, "w1"), (None, " ".join(long[:10]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(spark, docs, unnamed).collect()} >= {(1, None, 0), (2, None, 0)}
    assert decontaminate.without_leaks(spark, docs, unnamed).count() == 0
    left = decontaminate.without_leaks(spark, docs, items)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
    assert decontaminate.without_leaks(spark, docs.limit(0), items).count() == 0 == decontaminate.leaks(spark, docs.limit(0), items).count()
    assert decontaminate.without_leaks(spark, docs, items.limit(0)).count() == 2


def test_top_k_of_large_components_and_repeated_queries(spark):
    """On each side of the former limit, beyond a long, and with one ranking for each row of a repeated query id."""
    big = [[1.0, 1.0], [5000.0, 1.0], [4095.99, 0.5], [4096.0, 0.0], [-9000.0, 2.0], [1e6, -1e6], [2.0**51, 1.0], [2.0**53, -(2.0**53)], [1e200, -1e200], [0.0, 0.0], [3.0, -7.0]]
    rows = [(i, v) for i, v in enumerate(big)] + [(0, [2.0, -1.0]), (50, [2.0**53, 2.0**53]), (100, [1e200, 1e200])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in bitsliced.top_k(spark, frame, frame.filter("vec_id % 50 = 0")).collect()]
    whole = [(i, [int(np.floor(x * 256)) if abs(x) < 2**40 else int(x) * 256 for x in v]) for i, v in rows]
    want, top = [], (1 << 63) - 1
    for q, w in ((i, v) for i, v in whole if i % 50 == 0):
        clipped = [(min(max(sum(a * b for a, b in zip(v, w, strict=True)), -top - 1), top), i) for i, v in whole if i != q]
        want += [(q, n, i, s) for n, (s, i) in enumerate(sorted(clipped, key=lambda x: (-x[0], x[1]))[:5], 1)]
    assert sorted(got) == sorted(want)
