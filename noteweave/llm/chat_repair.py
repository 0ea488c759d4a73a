"""Chat formatting with minimum-cost role repair.

A conversation is legal if it may open with a system turn, then alternates user and assistant turns
beginning with user, and ends with assistant: an automaton of four states (nothing yet, system, user,
assistant). For each turn a dynamic programme chooses, at least cost over the whole conversation, to keep it,
to merge it into the turn before, to relabel it, or to insert an empty turn before it; at the end an
empty answer may be added. Then the repaired sequence is rendered.

A conversation need not fit in one task. It is cut into blocks by turn number, and a block of turns acts on
the four states as a 4 x 4 matrix of least costs, so long conversations are solved in three steps: the
blocks' matrices, in parallel; then the states at the blocks' borders, first those between groups of blocks and then
those inside each group; and the blocks' turns between fixed states, in parallel again. Where turn numbers are missing
or repeated so often that a block would be crowded, its conversation is dealt by the order of its turns instead, over many
tasks, and cut into blocks there. Texts are shuffled once otherwise. The result has one row for each input turn, with
the piece it adds to the rendered text; pieces in order make up the conversation (`rendered`).

Defined results: turns are ordered by number, then role, then text, with null numbers last, so ties have
one order; repeated rows are turns of their own; unknown and null roles are relabelled at a lower cost;
null texts count as empty; null conversation ids form one conversation; the markers' opening is escaped in
texts; equal costs prefer keep, then merge, relabel, insert, and the state named first; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noteweave.llm.common import checkpoint, prepare, spread_join, stored

#: Turn numbers in a block, blocks in a group, and turns in a block that make it crowded.
BLOCK, GROUP, CROWDED = 512, 512, 4096
STATES = ("", "system", "user", "assistant")
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
NAMES = {"system": 1, "user": 2, "human": 2, "assistant": 3, "gpt": 3, "bot": 3, "model": 3}
MERGE, RELABEL, UNKNOWN, INSERT = 2, 7, 1, 4
FAR = 1 << 40


def moves(role: int) -> list[tuple[int, int, int, int, str]]:
    """(state, next state, cost, role inserted before or 0, action) for a turn; the preferred first."""
    out = []
    for state in range(4):
        if state and role == state:
            out.append((state, state, MERGE, 0, "merge"))
        elif state:
            out.append((state, state, MERGE + (RELABEL if role else UNKNOWN), 0, "merge"))
        for new in (1, 2, 3):
            label = 0 if new == role else RELABEL if role else UNKNOWN
            if new in LEGAL[state]:
                out.append((state, new, label, 0, "keep" if new == role else "relabel"))
            for between in LEGAL[state]:
                if new in LEGAL[between]:
                    out.append((state, new, label + INSERT, between, "insert" if new == role else "insert+relabel"))
    rank = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3, "insert+relabel": 4}
    return sorted(out, key=lambda m: (m[2], rank[m[4]], m[0], m[1]))


MOVES = [moves(role) for role in range(4)]
#: Cost of ending in a state: an answer is added after a user turn; the others need both turns.
END = (2 * INSERT, 2 * INSERT, INSERT, 0)


def role_number(role: str | None) -> int:
    return NAMES.get((role or "").strip().lower(), 0)


def forward(roles: list[int], start: list[int]) -> list[list[int]]:
    """Least costs of the states before each turn and after the last."""
    out = [start]
    for role in roles:
        before, after = out[-1], [FAR] * 4
        for state, new, cost, _, _ in MOVES[role]:
            if before[state] + cost < after[new]:
                after[new] = before[state] + cost
        out.append(after)
    return out


def block_matrix(roles: list[int]) -> list[int]:
    """Least cost from each state to each state over a block's turns, row by row."""
    return [cost for state in range(4) for cost in forward(roles, [0 if i == state else FAR for i in range(4)])[-1]]


def chosen(roles: list[int], start: int, end: int | None) -> list[tuple[int, int, int, str]]:
    """(state before, state after, inserted role, action) of each turn, from `start` to `end` (None: any)."""
    costs = forward(roles, [0 if i == start else FAR for i in range(4)])
    state = min(range(4), key=lambda s: (costs[-1][s] + END[s], s)) if end is None else end
    path = []
    for at in range(len(roles) - 1, -1, -1):
        for before, after, cost, between, action in MOVES[roles[at]]:
            if after == state and costs[at][before] < FAR and costs[at][before] + cost == costs[at + 1][state]:
                path.append((before, after, between, action))
                state = before
                break
    return path[::-1]


def piece(text: str | None, before: int, after: int, between: int, action: str) -> str:
    """What a turn adds to the rendered conversation."""
    text = (text or "").replace("<|", "< |")
    if action == "merge":
        return "\n\n" + text
    closing = "<|end|>\n" if before else ""
    inserted = f"<|{STATES[between]}|>\n<|end|>\n" if between else ""
    return f"{closing}{inserted}<|{STATES[after]}|>\n{text}"


def ending(state: int) -> str:
    added = {0: (2, 3), 1: (2, 3), 2: (3,), 3: ()}[state]
    return ("<|end|>\n" if state else "") + "".join(f"<|{STATES[s]}|>\n<|end|>\n" for s in added)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal `names`."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            here = tuple(row[n] for n in names)
            if rows and here != key:
                yield key, rows
                rows = []
            key = here
            rows.append(row)
    if rows:
        yield key, rows


def path(steps: np.ndarray, enter: int, leave: int | None) -> list[tuple[int, int]]:
    """The states before and after each of a row of matrices, at least cost from `enter` to `leave` (None: any)."""
    costs = [np.where(np.arange(4) == enter, 0, FAR)]
    for step in steps:
        costs.append(np.minimum((costs[-1][:, None] + step).min(axis=0), FAR))
    state = int(np.argmin(costs[-1] + np.array(END))) if leave is None else leave
    ends = []
    for at in range(len(steps) - 1, -1, -1):
        before = int(np.argmin(costs[at] + steps[at][:, state]))
        ends.append((before, state))
        state = before
    return ends[::-1]


def spread(rows: DataFrame) -> DataFrame:
    """`rows` (c, g, b, n, r, t), the conversations with crowded blocks cut into blocks `b` by the order of their turns."""
    kind = rows.schema["c"].dataType
    block, c_type = BLOCK, to_arrow_type(kind)
    marked = rows.withColumns({"k": F.coalesce(F.col("c").cast("string"), F.lit("")), "z": F.col("c").isNull()})
    crowded = checkpoint(marked.groupBy("k", "z", "b").agg(F.count("*").alias("size")).filter(F.col("size") > CROWDED).select("k", "z").distinct())
    if crowded.isEmpty():
        return rows
    marked = spread_join(marked, crowded.withColumn("crowded", F.lit(True)), ["k", "z"], "left")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, part = (), 0, TaskContext.get().partitionId()
        for batch in batches:
            blocks = []
            for c in batch.column("c").to_pylist():
                conv, at = (c, at + 1) if c == conv else (c, 0)
                blocks.append((part << 32) + at // block)
            columns = [batch.column("c").cast(c_type), pa.array(np.full(len(blocks), part, np.int64)), pa.array(blocks, pa.int64()), *(batch.column(x) for x in ("n", "r", "t"))]
            yield pa.RecordBatch.from_arrays(columns, ["c", "g", "b", "n", "r", "t"])

    # Repeated rows are told apart by a number, so that a range can be split anywhere.
    order = ["z", "k", F.col("n").asc_nulls_last(), "r", "t", "turn"]
    many = marked.filter("crowded").withColumn("turn", F.monotonically_increasing_id())
    ranged = many.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    cut = stored(ranged.select("c", "n", "r", "t").mapInArrow(number, f"c {kind.simpleString()}, g long, b long, n long, r string, t string"))
    return marked.filter("crowded is null").select(*rows.columns).unionByName(cut)


def borders(long: DataFrame) -> DataFrame:
    """`c`, `b`, `enter`, `leave` and `last` of each block of `long` conversations (c, g, b, n, r)."""
    kind = long.schema["c"].dataType
    name, c_type = kind.simpleString(), to_arrow_type(kind)

    def rows_of(keys: list, columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, c_type), *(pa.array(x, t) for x, t in columns.values())], ["c", *columns])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, group, number), found in _runs(batches, ("c", "g", "b")):
            yield rows_of([conv], {"g": ([group], pa.int64()), "b": ([number], pa.int64()), "m": ([block_matrix([role_number(x["r"]) for x in found])], pa.list_(pa.int64()))})

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, group), found in _runs(batches, ("c", "g")):
            whole = np.array(found[0]["m"]).reshape(4, 4)
            for x in found[1:]:
                whole = np.minimum((whole[:, :, None] + np.array(x["m"]).reshape(4, 4)).min(axis=1), FAR)
            yield rows_of([conv], {"g": ([group], pa.int64()), "m": ([whole.ravel().tolist()], pa.list_(pa.int64()))})

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), found in _runs(batches, ("c",)):
            ends = path(np.array([x["m"] for x in found], np.int64).reshape(-1, 4, 4), 0, None)
            yield rows_of([conv] * len(found), {"g": ([x["g"] for x in found], pa.int64()), "enter": ([e[0] for e in ends], pa.int64()), "leave": ([e[1] for e in ends], pa.int64()), "last": ([i == len(ends) - 1 for i in range(len(ends))], pa.bool_())})

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), found in _runs(batches, ("c", "g")):
            border = found.pop(0)
            ends = path(np.array([x["m"] for x in found], np.int64).reshape(-1, 4, 4), border["enter"], border["leave"])
            last = [border["last"] and i == len(ends) - 1 for i in range(len(ends))]
            yield rows_of([conv] * len(found), {"b": ([x["b"] for x in found], pa.int64()), "enter": ([e[0] for e in ends], pa.int64()), "leave": ([e[1] for e in ends], pa.int64()), "last": (last, pa.bool_())})

    found = checkpoint(long.repartition("c", "b").sortWithinPartitions("c", "g", "b", F.col("n").asc_nulls_last(), "r").mapInArrow(matrices, f"c {name}, g long, b long, m array<long>"))
    groups = found.repartition("c", "g").sortWithinPartitions("c", "g", "b").mapInArrow(products, f"c {name}, g long, m array<long>")
    fixed = groups.repartition("c").sortWithinPartitions("c", "g").mapInArrow(between, f"c {name}, g long, enter long, leave long, last boolean")
    both = found.unionByName(fixed, allowMissingColumns=True).repartition("c", "g").sortWithinPartitions("c", "g", F.col("enter").asc_nulls_last(), "b")
    return checkpoint(both.mapInArrow(inside, f"c {name}, b long, enter long, leave long, last boolean"))


def repair(spark: SparkSession, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_col`, `turn_col`, `role_col`, `action`, `out_role`, `inserted`, `cost` and `piece` for each turn."""
    prepare(spark)
    block: Column = F.coalesce(F.floor(F.col(turn_col) / BLOCK), F.lit(1 << 52)).cast("long")
    rows = turns.select(F.col(conv_col).alias("c"), F.floor(block / GROUP).alias("g"), block.alias("b"), F.col(turn_col).cast("long").alias("n"), F.col(role_col).cast("string").alias("r"), F.col(text_col).cast("string").alias("t"))
    rows = spread(rows)
    kind = rows.schema["c"].dataType.simpleString()
    # Long conversations: the states at the borders of their blocks.
    spans = rows.groupBy(F.col("c").alias("spanning")).agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low < high")
    key = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit("null")).alias("k")
    fixed = borders(spread_join(rows.select("c", "g", "b", "n", "r", key("c")), spans.select(key("spanning")), ["k"]).drop("k"))
    types = {"c": to_arrow_type(rows.schema["c"].dataType)}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), found in _runs(batches, ("c", "b")):
            border = found.pop(0) if found[0]["enter"] is not None else None
            roles = [role_number(x["r"]) for x in found]
            path = chosen(roles, border["enter"], border["leave"]) if border else chosen(roles, 0, None)
            pieces = [piece(x["t"], *step) for x, step in zip(found, path, strict=True)]
            spent = [next(m[2] for m in MOVES[role] if m[0] == step[0] and m[1] == step[1] and m[3:] == step[2:]) for role, step in zip(roles, path, strict=True)]
            if border is None or border["last"]:
                pieces[-1] += ending(path[-1][1])
                spent[-1] += END[path[-1][1]]
            columns = [[conv] * len(found), [x["n"] for x in found], [x["r"] for x in found], [p[3] for p in path], [STATES[p[1]] for p in path], [STATES[p[2]] for p in path], spent, pieces]
            kinds = [types["c"], pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["c", "n", "r", "action", "out_role", "inserted", "cost", "piece"])

    every = rows.drop("g").withColumns({"enter": F.lit(None).cast("long"), "leave": F.lit(None).cast("long"), "last": F.lit(None).cast("boolean")})
    both = every.unionByName(fixed, allowMissingColumns=True)
    dealt = both.repartition("c", "b").sortWithinPartitions("c", "b", F.col("enter").asc_nulls_last(), F.col("n").asc_nulls_last(), "r", "t")
    out = dealt.mapInArrow(solve, f"c {kind}, n long, r string, action string, out_role string, inserted string, cost long, piece string")
    return out.select(F.col("c").alias(conv_col), F.col("n").alias(turn_col), F.col("r").alias(role_col), "action", "out_role", "inserted", "cost", "piece")


def rendered(repaired: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """`conv_col` and `text`: each conversation's pieces joined in order; for conversations that fit in a row."""
    pieces = F.sort_array(F.collect_list(F.struct(F.col(turn_col).isNull().alias("z"), F.col(turn_col).alias("n"), F.col(role_col).alias("r"), "at", "piece")))
    numbered = repaired.withColumn("at", F.monotonically_increasing_id())
    return numbered.groupBy(conv_col).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))
