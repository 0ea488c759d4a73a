"""The source audit, phrase mining and the rule ledger against brute force, with odd rows, and their parts."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from noteweave.llm import collocations, quality_rules, source_audit

ODD = "doc_id long, text string, lang string, source string, n long, rank int, term string, phrase string, failed string"


def frame(spark, rows):
    """Rows of (text, lang, source) with further columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, *r, i, 3, "x", "y", "z") for i, r in enumerate(rows)], ODD)


def random_rows(seed, n=150, langs=("en", "de", None), sources=("a", "b", "é", "", None)):
    rng = random.Random(seed)
    words = ["Der", "the", "THE", "über", "x-y", "don't", "a1b", "straße", "日本", "cat.", "dog,", "of", "it"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(1, 30))) + rng.choice(["", "\n", "\r\n of the cat", "\t;"]), rng.choice(langs), rng.choice(sources)) for _ in range(n)]
    hot = [(rows[0][0], "en", "a")] * (n // 2)
    return [*rows, *hot, (None, "en", "a"), ("", None, None), ("12 ...", "fr", "lonely"), (None, "fr", "other")]


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_audit(rows, least, ranks):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: counts[lang, s] for g, s in groups if g == lang}
        whole = sum(own.values(), Counter())

        def share(count, whole_count=None):
            total = sum(whole_count[t] for t in kept)
            return 1 + 1_000_000_000 * (count + 2) // (total + 2 * len(kept))

        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in own:
            pair = sorted((-sum(f(share(own[s][t], own[s]), share(own[o][t], own[o])) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -v, n) for n, (v, o) in enumerate(pair, 1)]
            above = [(share(own[s][t], own[s]), share(whole[t], whole), t) for t in kept if own[s][t]]
            term = sorted((-f(p, q), t.encode()) for p, q, t in above if p > q)
            out += [(lang, s, "term", t.decode(), -v, n) for n, (v, t) in enumerate(term[:ranks], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, ranks", [(10, 10), (1, 3), (1000, 10)])
def test_audit_equals_brute_force(spark, least, ranks):
    rows = random_rows(least)
    got = source_audit.audit(spark, frame(spark, rows).repartition(5), least, ranks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, least, ranks)


def test_audit_over_several_blocks_of_sources(spark, monkeypatch):
    """More sources than a block, many flushes of counts, and no documents."""
    monkeypatch.setattr(source_audit, "BLOCK", 3)
    monkeypatch.setattr(source_audit, "HELD", 5)
    rows = random_rows(4, 200, ("en",), tuple("abcdefgh"))
    assert sorted(map(tuple, source_audit.audit(spark, frame(spark, rows), 5).collect())) == plain_audit(rows, 5, 10)
    assert source_audit.audit(spark, frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband_equals_counting_dominators(k):
    rng = np.random.default_rng(k)
    terms = [f"t{x}".encode() for x in rng.permutation(1500)]
    high, low = rng.integers(1, 9, 1500), rng.integers(1, 200, 1500)
    keep = {terms[i] for i in source_audit.dominated(terms, high, low, k)}
    dominators = lambda i: sum(high[j] >= high[i] and low[j] <= low[i] and terms[j] < terms[i] for j in range(1500))
    assert keep == {terms[i] for i in range(1500) if dominators(i) < k}
    assert len(source_audit.dominated([], high[:0], low[:0], k)) == 0


def plain_phrases(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or ("und" if lang is None else lang)] += len(words)
            for d in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, first, budget", [(10, 2000, 1 << 20), (2, 2000, 40), (3, 7, 300)])
def test_phrases_equal_brute_force(spark, least, first, budget):
    """Also with groups so small that first words and pairs are extended."""
    rows = random_rows(budget)
    got = collocations.mine(spark, frame(spark, rows).repartition(4), least, first, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, first)


def test_phrases_of_very_long_texts_and_none(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(collocations, "CHUNK", 500)
    rows = [(" ".join(rng.choices("abcdefgh", k=40_000)), "en", "s"), (" ".join(rng.choices("ab.", k=100)), "en", "s")]
    assert sorted(map(tuple, collocations.mine(spark, frame(spark, rows), 30, budget=5000).collect())) == plain_phrases(rows, 30, 2000)
    for few in (frame(spark, rows).limit(0), frame(spark, [(None, None, None), ("", "en", ""), ("a b c", "en", "")])):
        assert collocations.mine(spark, few).count() == 0


def test_tuples_beyond_one_number_are_counted_whole():
    """Where the numbers of three words do not fit one integer."""
    import pyarrow as pa

    words = pa.array([str(i).encode() for i in range(1 << 21)], pa.binary())
    rng = np.random.default_rng(0)
    columns = [rng.integers(-1, 3, 200) for _ in range(3)]
    want = Counter(zip(*(x.tolist() for x in columns)))
    _, a, b, c, n = collocations.counted("en", words, columns)
    got = {tuple(int(x) if x else -1 for x in t): k for *t, k in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), n.to_pylist())}
    assert got == want


RULED = [
    "word " * 60, " ".join(f"w{i}" for i in range(60)), "a b c " * 40, " ".join(f"w{i}" for i in range(49)), "", None, " \t\n\x0b", "A!! B!! " * 30, "# $ %" * 30, "same line\n" * 30 + "\n \nsame line",
    "\n".join(f"line {i} is here" for i in range(20)), "x" * 5000 + " y" * 60, "é日本 𝒳𝒴 ß" * 30, " ".join(f"w{i} |" for i in range(60)), "a b c d a b c", " nbsp  one\x0btwo\x0cthree",
]


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    places = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places)


def test_ledger_equals_plain_measures(spark):
    rng = random.Random(1)
    texts = RULED + ["".join(rng.choices(["a ", "b ", "c\n", "\n", "# ", "D! "], k=rng.randint(1, 400))) for _ in range(60)] + ["very long " + " ".join(rng.choices("abcdefghijkl", k=30_000))]
    rows = quality_rules.verdicts(quality_rules.ledger(frame(spark, [(t, "en", "s") for t in texts])))
    got = {r.doc_id: r for r in rows.collect()}
    for i, text in enumerate(texts):
        want = plain_measures(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) == bool(r.failed & 3)
        assert r.kept == (r.failed == 0)
    assert quality_rules.ledger(frame(spark, [(None, None, None)]).limit(0)).count() == 0


def test_policies_and_ablation(spark):
    """Ablations from the bits equal those from applying each policy again without the rule."""
    bits = [0, 0, 1, 3, 2, 4, 5, 64, 68, 0]
    rows = spark.createDataFrame([(i, b, "s" if i % 2 else "t") for i, b in enumerate(bits)], "doc_id long, failed long, source string")
    got = {(r.version, r.rule): r for r in quality_rules.ablation(rows).collect()}
    assert set(got) == {(v, name) for v, names in quality_rules.POLICIES.items() for name in names}
    for (version, name), r in got.items():
        whole, bit = quality_rules.mask(version), quality_rules.BIT[name]
        assert r.rows == len(bits) and r.failing == sum(bool(b & bit) for b in bits)
        assert r.kept == sum(not b & whole for b in bits) and r.kept_without == sum(not b & (whole & ~bit) for b in bits)
        assert r.alone == r.kept_without - r.kept
    common = {r.source: (r.all_fail, r.any_fails, r.n) for r in quality_rules.common_bits(rows, "source").collect()}
    own = {s: [b for i, b in enumerate(bits) if ("s" if i % 2 else "t") == s] for s in "st"}
    for s, (every, some, n) in common.items():
        both = list(itertools.accumulate(own[s], lambda a, b: a & b))[-1]
        assert (every, some, n) == (both, list(itertools.accumulate(own[s], lambda a, b: a | b))[-1], len(own[s]))
    assert all(r.rows == 0 and r.kept == 0 for r in quality_rules.ablation(rows.limit(0)).collect())


def test_ledger_of_labelled_documents(spark, sf):
    """No document labelled as good is rejected by the rules beyond the base, and those labelled as bad are rejected."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules.verdicts(quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet"))).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_no_python_in_the_ledger(spark, sf):
    plan = quality_rules.verdicts(quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
