"""Token counts under a unigram vocabulary by dynamic programming over a shared trie.

A pre-token's best segmentation maximises the sum of its pieces' scores. The forward value of a prefix (the
best score of its segmentations, and how many pieces that takes) does not depend on what follows, so
the different pre-tokens are inserted in a trie and each node's forward value is computed once, from the
values of the nodes above it; a terminal node stores the pre-token's count. A document's count is the sum
over its pre-tokens. Each worker keeps one trie of at most KEPT nodes and starts anew beyond that, and pre-tokens of
more than LONGEST characters go through the same recursion without nodes, so memory is bounded and nothing is shuffled.

The vocabulary is a public tokenizer's file; nothing is trained. Pieces are scored by their rank in the
file, -log(rank + 1) - log(harmonic sum), Zipf's law, since such files carry ranks and not probabilities.

Defined results: null and empty texts, and texts of white space, have no pre-tokens and count zero; a
character outside the vocabulary is one unknown piece; ties between segmentations go to fewer pieces;
repeated rows are independent; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.common import prepare, small_batches

#: Trie nodes, and pre-tokens with a stored count, that a worker keeps.
KEPT = 400_000
#: Longer pre-tokens are not inserted.
LONGEST = 256
#: The mark of a pre-token's start in the vocabulary.
START = "▁"


def scores(path: str) -> dict[str, float]:
    """Piece -> score, of a sentencepiece model file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 1) - total for rank, piece in enumerate(pieces)}


class Trie:
    """Forward values of all prefixes seen. Node 0 is the empty prefix."""

    def __init__(self, pieces: dict[str, float]):
        self.longest = max(map(len, pieces), default=1)
        # Pieces by their reversed text: a step of the forward recursion reads backwards from its end.
        self.pieces = pieces
        self.ends: dict[str, int] = Counter(p[-1] for p in pieces)
        self.suffixes = {p[i:] for p in pieces for i in range(len(p))}
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.above, self.depth, self.best, self.count = [-1], [0], [0.0], [0]
        self.terminal: dict[str, int] = {}

    def terminal_count(self, token: str) -> int:
        """The pre-token's number of pieces; inserts it if it is new."""
        found = self.terminal.get(token)
        if found is not None:
            return found
        if len(self.above) > KEPT or len(self.terminal) > KEPT:
            self.clear()
        if len(token) > LONGEST:
            return self.plain(START + token)
        node, child, word = 0, self.child, START + token
        for end, letter in enumerate(word, 1):
            following = child.get((node, letter))
            node = self.insert(node, letter, word, end) if following is None else following
        self.terminal[token] = self.count[node]
        return self.count[node]

    def plain(self, word: str) -> int:
        """The same recursion for one long word, without nodes."""
        values = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            score, count = values[-1][0] + self.unknown, values[-1][1] + 1
            begin = end - 1
            while begin >= 0 and (part := word[begin:end]) in self.suffixes:
                if (own := self.pieces.get(part)) is not None:
                    new, n = values[begin][0] + own, values[begin][1] + 1
                    if new > score or new == score and n < count:
                        score, count = new, n
                begin -= 1
            values.append((score, count))
        return values[-1][1]

    def insert(self, node: int, letter: str, word: str, end: int) -> int:
        """A new node below `node`; its forward value comes from the nodes on the way up."""
        score, count = self.best[node] + self.unknown, self.count[node] + 1
        at, begin, pieces, suffixes = node, end - 1, self.pieces, self.suffixes
        while begin >= 0 and (part := word[begin:end]) in suffixes:
            if (own := pieces.get(part)) is not None:
                new = self.best[at] + own
                if new > score or new == score and self.count[at] + 1 < count:
                    score, count = new, self.count[at] + 1
            at, begin = self.above[at], begin - 1
        self.child[node, letter] = made = len(self.above)
        self.above.append(node)
        self.best.append(score)
        self.count.append(count)
        return made

    def tokens(self, text: str | None) -> tuple[int, int]:
        """(pieces, pre-tokens) of a text."""
        found = text.split() if text else []
        look = self.terminal_count
        return sum(map(look, found)), len(found)


def count_tokens(spark: SparkSession, df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `n_tokens` and `n_pretokens` for each row."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(scores(vocabulary))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in small_batches(batches, "t"):
            found = np.array([trie.tokens(t) for t in batch.column("t").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["i", "n_tokens", "n_pretokens"])

    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, n_tokens long, n_pretokens long").withColumnRenamed("i", id_col)
