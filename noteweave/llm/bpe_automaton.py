"""BPE encoding and decoding with a deterministic tokenization automaton.

The automaton reads *tokens*. It starts as one state with an arc for each byte; every merge
(u, v) -> w, in rank order, applies a merge gadget:

* the state that u's arcs lead to is copied without its v arc, and u's arcs now lead to the copy, so
  that u followed by v can no longer be read;
* an arc labelled w is added beside every u arc that is left, and it leads where v led before.

After all gadgets the automaton accepts exactly the token sequences that BPE produces, and the state
reached depends on the last label alone. A copy differs from its original by one missing arc, so a
state is stored as the short list of gadgets it went through, ``(label, rank)``, and an arc's presence is
looked up once and then kept in a transition table.

A word is encoded by running the automaton over its bytes. While it reads, several arcs can be under
way, each a pair of (state it leaves, node of the labels' trie); that set is determinised into one row of
a byte transition table, filled as it is used. Each prefix has one accepted path, so each byte position
is entered by one arc at most and the path is read off backwards. A byte costs one table look-up, and
long words need no merge queue. The different words of a batch of texts go through the table side by side, one
byte of each at a time, in arrays; words longer than most go alone. Decoding emits the labels of the arcs.

Defined results: null text counts as empty; empty text gives no tokens; repeated rows and ties are
independent rows; an empty table gives an empty result; columns beside the two named ones are not
read, so clashing names do no harm.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.common import prepare, small_batches

#: Fixed value: the byte-level pre-splitting pattern that the vocabulary was made with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Byte transitions that a worker keeps, beyond which the table starts anew; bits of its slots, which hold those of a chunk more;
#: bytes of words in a chunk; words that are worth an array.
KEPT_STEPS, SLOT_BITS, CHUNK, LANES = 400_000, 20, 1 << 17, 100


#: What Unicode 16.0 has beyond 15.1 among letters and among numbers, as the library's tables have it too.
LATER_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
LATER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def char_classes(last: int) -> tuple[str, str, str]:
    """The letters, numbers and white space up to a code point, as the ranges of a character class.

    By the tables of Unicode 15.1, which the standard library has, and the additions above: the library that the vocabulary
    is made for has the same.
    """
    later = [[tuple(int(x, 16) for x in span.split("-")) for span in spans.split()] for spans in (LATER_LETTERS, LATER_NUMBERS)]
    kinds = bytearray(last + 1)
    for code in range(last + 1):
        kinds[code] = {"L": 1, "N": 2}.get(unicodedata.category(chr(code))[0], 0)
    for code in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        kinds[code] = 3
    for kind, spans in enumerate(later, 1):
        for low, high in spans:
            kinds[low : min(high, last) + 1] = bytes([kind]) * (min(high, last) + 1 - low) if low <= last else b""
    return tuple("".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(bytes([kind]) + b"+", bytes(kinds))) for kind in (1, 2, 3))


@functools.cache
def splitter() -> Callable[[str], list[str]]:
    """A function that cuts a text by SPLIT.

    The classes are spelled out for the standard library's engine: those up to U+FFFF alone, which it tests by a table,
    for texts without characters beyond, nearly all; all of them for the others.
    """

    def pattern(last: int) -> Callable[[str], list[str]]:
        letter, number, space = char_classes(last)
        return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    plain, whole = pattern(0xFFFF), functools.cache(lambda: pattern(0x10FFFF))
    astral = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: plain(text) if text.isascii() or not astral(text) else whole()(text)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The compiled automaton. `labels[t]` are the bytes of token t, `rules[(u, v)]` is a gadget's rank."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], specials: dict[str, int]):
        self.labels, self.specials = labels, specials
        self.rules: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = {}
        states: list[tuple[tuple[int, int], ...]] = [()]
        known = {(): 0}
        self.states, self.target = states, {t: 0 for t, b in labels.items() if len(b) == 1}
        for rank, (u, v, w) in enumerate(merges):
            if w in self.target or (u, v) in self.rules:
                raise ValueError("two merges give one token; such a vocabulary has no single gadget for it")
            if u not in self.target or v not in self.target or not self.allows(self.target[u], v):
                continue  # the pair can no longer be read, so the merge never fires
            reached, went = self.target[v], states[self.target[u]]
            copy = ((u, rank), *went[went[:1] != () and went[0][0] == u :])
            self.rules[u, v] = rank
            self.target[u] = known.setdefault(copy, len(states))
            if self.target[u] == len(states):
                states.append(copy)
            self.target[w], self.left[w], self.born[w] = reached, u, rank
        self.trie: dict[int, int] = {}
        self.token_at = [-1]
        for t in self.target:
            node = 0
            for byte in labels[t]:
                node = self.trie.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = t
        self.inner = {key >> 8 for key in self.trie}  # nodes that lead on

    def allows(self, state: int, token: int) -> bool:
        """Whether `state` has an arc labelled `token`: no gadget took it or the arc it was built on away."""
        rules, path, made = self.rules, self.states[state], 1 << 60
        while True:
            for owner, until in path:
                rank = rules.get((owner, token))
                if rank is not None and rank <= until and rank <= made:
                    return False
            if token not in self.left:
                return True
            made, token = self.born[token], self.left[token]

    @classmethod
    def load(cls, path: str) -> Automaton:
        """Compile the byte-level BPE vocabulary of a tokenizers JSON file."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items() if token not in added}
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], added)


class Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


class Coder:
    """Encodes and decodes texts with the tables of an automaton; lives in one worker."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.emit = automaton.labels | {i: s.encode() for s, i in automaton.specials.items()}
        top = max(self.emit, default=-1) + 1
        self.lengths = np.zeros(top, np.int64)
        for token, label in automaton.labels.items():
            self.lengths[token] = len(label)
        self.shown = pa.array([self.emit.get(t, b"") for t in range(top)], pa.binary())
        self.find = splitter()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(automaton.specials, key=len, reverse=True))) + ")") if automaton.specials else None
        self.start_anew()

    def start_anew(self, arcs: bytes | None = None) -> int:
        """An empty byte table, with a row for `arcs` if given, whose number is returned.

        A row is the arcs under way (state << 32 | node) and the arc that just ended (-1: none). Transitions are keyed by
        row << 8 | byte, in slots probed one after the other; numpy and plain code see the same memory.
        """
        first = array("q", (0, -1)).tobytes()
        self.rows, self.known, self.steps = [first], {first: 0}, 0
        self.entered, self.key, self.to = array("i", [-1]), array("q", [-1]) * (1 << SLOT_BITS), array("i", [0]) * (1 << SLOT_BITS)
        self.keys, self.tos, self.enters = np.frombuffer(self.key, np.int64), np.frombuffer(self.to, np.int32), np.full(1, -1, np.int32)
        return 0 if arcs is None else self.row_of(arcs)

    def row_of(self, arcs: bytes) -> int:
        found = self.known.setdefault(arcs, len(self.rows))
        if found == len(self.rows):
            self.rows.append(arcs)
            self.entered.append(array("q", arcs)[-1])
        return found

    def step(self, key: int) -> int:
        """Fill in one byte transition."""
        auto, byte, under_way, ended = self.automaton, key & 255, array("q"), -1
        trie, inner, token_at, allows = auto.trie, auto.inner, auto.token_at, auto.allows
        for arc in array("q", self.rows[key >> 8])[:-1]:
            if (node := trie.get((arc & 0xFFFFFFFF) << 8 | byte)) is not None:
                state = arc >> 32
                if node in inner:
                    under_way.append(state << 32 | node)
                if ended < 0 and (token := token_at[node]) >= 0 and allows(state, token):
                    ended = token
        if ended >= 0:
            under_way.append(auto.target[ended] << 32)
        under_way.append(ended)
        found = self.row_of(under_way.tobytes())
        slot = self.slot(key)
        while self.key[slot] >= 0:
            slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
        self.key[slot], self.to[slot] = key, found
        self.steps += 1
        return found

    @staticmethod
    def slot(key):
        """Where to look for a key, or keys, first."""
        return (key ^ key >> 17 ^ key >> 9) * 0x9E3779B1 >> 10 & ((1 << SLOT_BITS) - 1)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The rows that the transitions lead to; those not known yet are filled in."""
        slots = self.slot(keys)
        out, open_ = self.tos[slots], np.flatnonzero(self.keys[slots] != keys)
        while len(open_):
            at, own = slots[open_], keys[open_]
            there = self.keys[at]
            new, done = there < 0, there == own
            if new.any():
                for key in np.unique(own[new]).tolist():
                    if self.find_step(key) < 0:
                        self.step(key)
            out[open_[done]] = self.tos[at[done]]
            passed = ~(new | done)
            slots[open_[passed]] = (at[passed] + 1) & ((1 << SLOT_BITS) - 1)
            open_ = open_[~done]
        return out

    def find_step(self, key: int) -> int:
        """The row that a known transition leads to, or -1."""
        slot = self.slot(key)
        while (there := self.key[slot]) >= 0:
            if there == key:
                return self.to[slot]
            slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
        return -1

    def word(self, data: bytes) -> tuple[int, ...]:
        """A word alone."""
        row, ended, lengths = 0, [], self.lengths
        for byte in data:
            if (following := self.find_step(row << 8 | byte)) < 0:
                if self.steps >= KEPT_STEPS:
                    row = self.start_anew(self.rows[row])
                following = self.step(row << 8 | byte)
            row = following
            ended.append(self.entered[row])
        path, n = [], len(data)
        while n:
            path.append(token := ended[n - 1])
            n -= int(lengths[token])
        return tuple(path[::-1])

    def chunk(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words that stand one after the other in `data`, and the number of each word's."""
        if self.steps >= KEPT_STEPS:
            self.start_anew()
        ended, last = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
        order = np.argsort(-sizes, kind="stable")
        begin, left = starts[order], sizes[order]
        longest = int(left[LANES - 1]) if len(left) >= LANES else 0
        alone = int(np.searchsorted(-left, -longest))  # so many are longer
        for start, size in zip(begin[:alone].tolist(), left[:alone].tolist()):
            path = np.array(self.word(data[start : start + size].tobytes()), np.int64)
            ends = start + np.cumsum(self.lengths[path]) - 1
            ended[ends], last[ends] = path, True
        if self.steps >= KEPT_STEPS:
            self.start_anew()
        begin, left = begin[alone:], left[alone:].copy()
        row = np.zeros(len(begin), np.int64)
        for place in range(longest):
            n = int(np.searchsorted(-left, -place))  # so many reach this byte
            at = begin[:n] + place
            row[:n] = self.follow(row[:n] << 8 | data[at])
            if len(self.enters) < len(self.entered):
                self.enters = np.array(self.entered, np.int32)
            ended[at] = self.enters[row[:n]]
        begin, left = begin[left > 0], left[left > 0]
        while len(begin):
            at = begin + left - 1
            last[at] = True
            left -= self.lengths[ended[at]]
            begin, left = begin[left > 0], left[left > 0]
        before = np.concatenate([[0], np.cumsum(last)])
        return ended[last], before[starts + sizes] - before[starts]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the words, one after the other, and the number of each word's."""
        held = pa.array(words, pa.large_binary())
        ends = np.frombuffer(held.buffers()[1], np.int64)[: len(words) + 1]
        data = np.frombuffer(held.buffers()[2], np.uint8) if ends[-1] else np.zeros(0, np.uint8)
        tokens, counts, first = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while first < len(words):
            stop = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, side="right")) - 1)
            found, n = self.chunk(data[ends[first] : ends[stop]], ends[first:stop] - ends[first], np.diff(ends[first : stop + 1]))
            tokens.append(found)
            counts.append(n)
            first = stop
        return np.concatenate(tokens), np.concatenate(counts)

    def parts(self, text: str | None) -> list[str]:
        """A text's words and special tokens."""
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self.find(text)
        return [x for part in self.special.split(text) for x in ([part] if part in self.automaton.specials else self.find(part))]

    def encode_all(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each end."""
        numbers, codes, sizes = Words(), array("i"), []
        for text in texts:
            found = self.parts(text)
            codes.extend(map(numbers.__getitem__, found))
            sizes.append(len(found))
        # A special token, which no word holds, stands there as one byte, which is one token.
        specials = [(numbers[s], i) for s, i in self.automaton.specials.items() if s in numbers]
        words = list(numbers)
        for number, _ in specials:
            words[number] = "a"
        tokens, counts = self.words(words)
        starts = np.cumsum(counts) - counts
        for number, token in specials:
            tokens[starts[number]] = token
        codes = np.frombuffer(codes, np.int32)
        n = counts[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = tokens[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.cumsum(np.array(sizes, np.int64))]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.emit.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids that `encode_all` gave."""
        shown = self.shown.take(pa.array(ids))
        at = np.frombuffer(shown.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        out = pa.StringArray.from_buffers(len(ends), pa.py_buffer(at[np.concatenate([[0], ends])].tobytes()), shown.buffers()[2])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([self.decode(x.tolist()) for x in np.split(ids, ends[:-1])], pa.string())
        return out


def _coder(shared) -> Coder:
    """One coder for each worker and automaton, which goes with the broadcast once later tasks no longer use that."""
    if not hasattr(shared, "coder"):
        shared.coder = Coder(shared.value)
    return shared.coder


def round_trip(spark: SparkSession, df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `ids` (array of int) and `decoded` (the text that the ids decode to) for each row."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(Automaton.load(vocabulary))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in small_batches(batches, "t"):
            ids, ends = coder.encode_all(batch.column("t").to_pylist())
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("i"), listed, coder.decode_all(ids, ends)], ["i", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("i", id_col)


def encode(spark: SparkSession, df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `ids` for each row."""
    return round_trip(spark, df, vocabulary, id_col, text_col).drop("decoded")


def decode(spark: SparkSession, df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and `decoded` for each row's array of ids; null counts as empty."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(Automaton.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([coder.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())], ["i", "decoded"])

    rows = df.select(F.col(id_col).alias("i"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, decoded string").withColumnRenamed("i", id_col)


def digest(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and digests of the ids and of the decoded text."""
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
