"""Automaton coding, trie counts, chat repair and LM scoring against brute force."""

import gc
import hashlib
import itertools
import math
import random
import weakref
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noteweave.llm import bpe_automaton, chat_repair, lm_scoring, trie_counts
from noteweave.llm.registry import PIECES, VOCABULARY


@pytest.fixture(scope="module")
def coder():
    return bpe_automaton.Coder(bpe_automaton.Automaton.load(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_coder_equals_library(coder, library):
    rng = random.Random(5)
    pools = [[chr(i) for i in range(32, 127)], [chr(i) for i in range(0x300)], list("aab '\n\t s"), list("the ing er ANDS'lltion12"), ["<|endoftext|>", "a", " ", "<|endoftext|"], ["ha"], [chr(i) for i in range(0x4E00, 0x4F00)], ["😀", " ", "é"]]
    for _ in range(4000):
        text = "".join(rng.choices(rng.choice(pools), k=rng.randint(0, 40)))
        ids = coder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_batches_equal_library_and_keep_their_tables(coder, library, monkeypatch):
    """Whole batches, with words side by side and alone, over restarts of the table, and none where a corpus fits it."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçабвгд日本語中文"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(700)) for _ in range(140)]
    texts += [None, "", "<|endoftext|>", "a<|endoftext|><|endoftext|> a\n", "中" * 3000 + " " + "ха" * 2000, "😀 " * 50, texts[0]]
    fills, step = [], bpe_automaton.Coder.step
    monkeypatch.setattr(bpe_automaton.Coder, "step", lambda self, *key: fills.append(key) or step(self, *key))
    for kept, bits, chunk, lanes in ((400_000, 20, 1 << 17, 100), (5_000, 18, 1 << 17, 100), (5_000, 14, 3_000, 1), (50, 9, 70, 4)):
        for name, value in (("KEPT_STEPS", kept), ("SLOT_BITS", bits), ("CHUNK", chunk), ("LANES", lanes)):
            monkeypatch.setattr(bpe_automaton, name, value)
        fresh, texts = bpe_automaton.Coder(coder.automaton), texts if kept == 400_000 else texts[-15:]
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        ids, ends = fresh.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == want
        assert fresh.decode_all(ids, ends).to_pylist() == [t or "" for t in texts]
        if kept == 400_000:
            assert len(fills) > 150_000
            fills.clear()
            fresh.encode_all(texts)
            assert not fills
    cut = next(t for t, b in coder.automaton.labels.items() if b == b"\xc3")
    assert fresh.decode_all(np.array([cut, cut], np.int32), np.array([1, 2])).to_pylist() == ["\ufffd", "\ufffd"] == [coder.decode([cut])] * 2


def test_coder_goes_with_its_broadcast(coder):
    """A worker has one coder for a broadcast, and none once later tasks have made it drop that."""

    class Shared:
        value = coder.automaton

    shared = Shared()
    made = bpe_automaton._coder(shared)
    assert bpe_automaton._coder(shared) is made
    gone = weakref.ref(made)
    del made, shared
    gc.collect()
    assert gone() is None


def test_gadgets_forbid_exactly_the_merged_pairs():
    """On a small vocabulary, accepted sequences are exactly what merging in rank order produces."""
    letters = {i: bytes([97 + i]) for i in range(2)}
    merges, labels = [], dict(letters)
    rng = random.Random(1)
    while len(merges) < 7:
        u, v = rng.choice(sorted(labels)), rng.choice(sorted(labels))
        if labels[u] + labels[v] not in labels.values():
            labels[len(labels)] = labels[u] + labels[v]
            merges.append((u, v, len(labels) - 1))
    small = bpe_automaton.Coder(bpe_automaton.Automaton(labels, merges, {}))
    for n in range(1, 10):
        for letters_ in itertools.product(b"ab", repeat=n):
            word = [x - 97 for x in letters_]
            for u, v, w in merges:
                out = []
                for t in word:
                    if out and (out[-1], t) == (u, v):
                        out[-1] = w
                    else:
                        out.append(t)
                word = out
            assert list(small.word(bytes(letters_))) == word


def test_round_trip_edges(spark, library):
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (3, "hello world " * 20_000, 9), (None, "x", 9)]
    got = bpe_automaton.digest(bpe_automaton.round_trip(spark, spark.createDataFrame(rows, "doc_id long, text string, ids int"), VOCABULARY)).collect()
    assert len(got) == 5
    long = next(r for r in got if r.doc_id == 3)
    ids = library.encode(rows[3][1], add_special_tokens=False).ids
    assert (long.n_tokens, long.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got if r.doc_id in (1, 2))
    assert bpe_automaton.round_trip(spark, spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
    back = bpe_automaton.decode(spark, bpe_automaton.encode(spark, spark.createDataFrame(rows[3:4], "doc_id long, text string, ids int"), VOCABULARY), VOCABULARY)
    assert back.first().decoded == rows[3][1]


def test_trie_equals_plain_dynamic_programme(spark, sf):
    pieces = trie_counts.scores(PIECES)
    trie = trie_counts.Trie(pieces)

    def plain(token):
        word = trie_counts.START + token
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(-(best[end - 1][0] + trie.unknown), best[end - 1][1] + 1)]
            ways += [(-(best[b][0] + pieces[word[b:end]]), best[b][1] + 1) for b in range(end) if word[b:end] in pieces]
            best.append((-min(ways)[0], min(ways)[1]))
        return best[-1][1]

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]
    for token in {w for t in texts for w in t.split()} | {"日本語", "x" * 60, "▁"}:
        assert trie.terminal_count(token) == plain(token)
    rows = spark.createDataFrame([(1, None), (2, " \n"), (3, "in the in"), (3, "in the in")], "doc_id long, text string")
    got = [tuple(r) for r in trie_counts.count_tokens(spark, rows, PIECES).orderBy("doc_id").collect()]
    assert got[:2] == [(1, 0, 0), (2, 0, 0)] and got[2] == got[3] and got[2][2] == 3


def cheapest(roles):
    """Brute force over all action sequences of a short conversation."""
    best = None
    for picks in itertools.product(*(range(len(chat_repair.MOVES[r])) for r in roles)):
        state, cost = 0, 0
        for role, pick in zip(roles, picks, strict=True):
            move = chat_repair.MOVES[role][pick]
            if move[0] != state:
                break
            state, cost = move[1], cost + move[2]
        else:
            cost += chat_repair.END[state]
            best = cost if best is None else min(best, cost)
    return best


def test_repair_is_cheapest_and_legal():
    for n in (1, 2, 3):
        for roles in itertools.product(range(4), repeat=n):
            path = chat_repair.chosen(list(roles), 0, None)
            spent = sum(next(m[2] for m in chat_repair.MOVES[r] if (m[0], m[1], m[3], m[4]) == step) for r, step in zip(roles, path, strict=True))
            assert spent + chat_repair.END[path[-1][1]] == cheapest(roles)
            out = []
            for _, after, between, action in path:
                if action != "merge":
                    out += [between] * bool(between) + [after]
            out += {0: [2, 3], 1: [2, 3], 2: [3], 3: []}[path[-1][1]]
            assert out[out[0] == 1 :] == [2, 3] * ((len(out) - (out[0] == 1)) // 2)


def test_long_conversation_in_blocks_costs_the_same(spark):
    rng = random.Random(2)
    names = ["user", "assistant", "system", "tool", None]
    rows = [(7, t, rng.choice(names), f"t{t}") for t in range(1300)] + [(8, 0, "user", "hi"), (8, 0, "user", "hi"), (None, None, None, None), (9, 5, "human", "<|end|>")]
    got = chat_repair.repair(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    long = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.turn)
    roles = [chat_repair.role_number(x[2]) for x in rows[:1300]]
    path = chat_repair.chosen(roles, 0, None)
    whole = sum(next(m[2] for m in chat_repair.MOVES[r] if (m[0], m[1], m[3], m[4]) == step) for r, step in zip(roles, path, strict=True)) + chat_repair.END[path[-1][1]]
    assert sum(r.cost for r in long) == whole
    text = "".join(r.piece for r in long)
    said = [line[2:-2] for line in text.split("\n") if line in ("<|user|>", "<|assistant|>", "<|system|>")]
    said = said[said[0] == "system" :]
    assert said == ["user", "assistant"] * (len(said) // 2)
    two = sorted(r.action for r in got if r.conv_id == 8)
    assert two == ["keep", "merge"]
    assert "< |end|>" in next(r.piece for r in got if r.conv_id == 9)
    assert chat_repair.repair(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_crowded_blocks_are_cut(spark, monkeypatch):
    """Turns without a number, or all of one number, or one repeated turn, at the cost of the whole conversation."""
    for name, value in (("BLOCK", 16), ("GROUP", 4), ("CROWDED", 50)):
        monkeypatch.setattr(chat_repair, name, value)
    rng = random.Random(5)
    names = ["user", "assistant", "system", "tool", None]
    rows = [(None, None, rng.choice(names), f"t{i}", 1) for i in range(400)] + [(3, 7, rng.choice(names), f"u{i}", 1) for i in range(300)]
    rows += [(4, 0, "user", "again", 1)] * 300 + [(5, t, rng.choice(names), f"v{t}", 1) for t in range(700)] + [(6, 0, "user", "hi", 1), (6, 1, "assistant", "yes", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c int")
    repaired = chat_repair.repair(spark, frame)
    got = repaired.collect()
    assert sorted(((r.conv_id or 0, r.turn or 0, r.role or "") for r in got)) == sorted(((c or 0, n or 0, r or "") for c, n, r, _, _ in rows))
    for conv in (None, 3, 4, 5, 6):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
        roles = [chat_repair.role_number(r[2]) for r in own]
        path = chat_repair.chosen(roles, 0, None)
        whole = sum(next(m[2] for m in chat_repair.MOVES[r] if (m[0], m[1], m[3], m[4]) == step) for r, step in zip(roles, path, strict=True)) + chat_repair.END[path[-1][1]]
        assert sum(r.cost for r in got if r.conv_id == conv) == whole
    text = {r.conv_id: r.text for r in chat_repair.rendered(repaired).collect()}
    assert text[6] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n" and text[4].count("again") == 300


def test_lm_words_of_a_batch_are_those_of_split():
    """Hashes of whole batches: one for each word of `str.lower().split()`, whatever text and place it stands in."""
    rng = random.Random(6)
    texts = [None, "", " ", "a", "A b\u3000c\xa0d\x1fe", "İst ß x", "x" * 300 + " y", "x" * 256, "x" * 257 + "\x85z", "\n\na b a b a"]
    texts += ["".join(rng.choices("abcDE \u3000é\x1c\u200b日\r", k=rng.randint(0, 60))) for _ in range(2000)] + ["".join(rng.choices("ab", k=n)) for n in range(600)]
    hashes, sizes = lm_scoring.words(texts)
    split = [(t or "").lower().split() for t in texts]
    assert sizes.tolist() == [len(x) for x in split]
    of = dict(zip((w for x in split for w in x), hashes.tolist(), strict=True))
    assert len(set(of.values())) == len(of) and [of[w] for x in split for w in x] == hashes.tolist()
    keys, n, place = lm_scoring.entries(hashes, sizes)
    for k, x in enumerate(split):
        pairs, contexts = Counter(zip(["<s>", *x], x, strict=False)), Counter(["<s>", *x][: len(x)])
        odd = keys[place == k] & 1 == 1
        assert sorted(n[place == k][odd]) == sorted(pairs.values()) and sorted(n[place == k][~odd]) == sorted(contexts.values())


def test_lm_counts_beyond_the_kept_losses(spark, monkeypatch):
    """Keys that occur thousands of times in one text and go through the buckets."""
    monkeypatch.setattr(lm_scoring, "HEAVY", 1)
    docs = spark.createDataFrame([(1, "a b " * 2000), (2, "a b " * 1500), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(spark, docs, docs.filter("doc_id = 1")).collect()}
    loss = lambda pair, context: math.log(context + 4) - math.log(pair + 4 / 3)
    want = {i: (loss(2, 3) + n * loss(3500, 3500) + (n - 1) * loss(3498, 3498)) / (2 * n) for i, n in ((1, 2000), (2, 1500))}
    assert {i: got[i].background_loss for i in want} == pytest.approx(want)
    assert got[1].target_loss == pytest.approx((loss(1, 1) + 2000 * loss(2000, 2000) + 1999 * loss(1999, 1999)) / 4000)
    assert got[3].target_loss == pytest.approx(loss(0, 1))


@pytest.mark.parametrize("heavy, held, bucket", [(500_000, 1 << 22, 1 << 22), (20, 64, 50), (1, 1, 7)])
def test_lm_scores_equal_plain_models(spark, monkeypatch, heavy, held, bucket):
    """Equal where all keys are broadcast, where some go to many buckets from many parts, and where nearly all do."""
    for name, value in (("HEAVY", heavy), ("HELD", held), ("PACKED", held), ("BUCKET", bucket)):
        monkeypatch.setattr(lm_scoring, name, value)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("a b c d e".split(), weights=[5, 4, 3, 2, 1 + i % 2 * 6], k=40))) for i in range(20)] + [(20, None), (21, ""), (5, "a b a")]
    good = {i for i in range(0, 20, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in good] + [(0,), (None,)], "doc_id long")
    got = lm_scoring.score(spark, docs, targets).collect()
    assert len(got) == len(rows)

    size = len({w for _, t in rows for w in (t or "").split()})

    def model(texts):
        pairs, before = Counter(), Counter()
        for t in texts:
            w = ["<s>", *(t or "").split()]
            pairs.update(zip(w, w[1:], strict=False))
            before.update(w[:-1])
        return lambda u, w: (pairs[u, w] + lm_scoring.PRIOR / size) / (before[u] + lm_scoring.PRIOR)

    target, background = model([t for i, t in rows if i in good]), model([t for _, t in rows])
    for r in got:
        texts = [t for i, t in rows if i == r.doc_id and len((t or "").split()) == r.n_tokens]
        if not r.n_tokens:
            assert r.score is None
            continue
        w = ["<s>", *texts[0].split()]
        loss = [-sum(math.log(m(a, b)) for a, b in zip(w, w[1:], strict=False)) / r.n_tokens for m in (target, background)]
        assert (r.target_loss, r.background_loss, r.score) == pytest.approx((loss[0], loss[1], loss[0] - loss[1]))
    means = [sum(r.score for r in got if r.n_tokens == 40 and r.doc_id % 2 == odd) for odd in (0, 1)]
    assert means[0] < means[1]
    assert lm_scoring.score(spark, docs.limit(0), targets).count() == 0


def test_trie_edges(spark):
    """Very long pre-tokens and texts, null and empty texts, clashing names, an empty table."""
    rows = [(1, "é" * 5000 + " the", "a"), (2, None, None), (3, " \n", "b"), (4, "the and " * 30000, "c"), (4, "the", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(tuple(r) for r in trie_counts.count_tokens(spark, docs, PIECES).collect())
    trie = trie_counts.Trie(trie_counts.scores(PIECES))
    word = "ab" * 100
    assert trie.plain(trie_counts.START + word) == trie.terminal_count(word)
    assert [(i, p) for i, _, p in got] == [(1, 2), (2, 0), (3, 0), (4, 1), (4, 60000)] and got[4][1] == 60000 and got[1][1] == 0
    assert trie_counts.count_tokens(spark, docs.limit(0), PIECES).count() == 0


def test_splitting_of_every_character():
    """Each code point before an 's, after a space and beside a letter, a digit and a mark is cut as the tokenizers library does."""
    import public_tokenizers
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    find = bpe_automaton.splitter()
    codes = [c for c in (*range(0x32400), *range(0x32400, 0xE0000, 97), *range(0xE0000, 0xE0200), *range(0xE0200, 0x110000, 997)) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(codes), 10_000):
        text = "".join(f"{chr(c)}'s {chr(c)}a{chr(c)}1{chr(c)}!\n" for c in codes[start : start + 10_000])
        ends, at = [], 0
        for piece in find(text):
            at += len(piece)
            ends.append(at)
        assert ends == [stop for _, (_, stop) in cut(text)]
