"""Keyed state that a batch touches only where it has events: the last row of each key, with a time to live.

Against the aggregation in `feedback.latest`, whose complete output is the whole state, a batch here costs its own keys: the
state of a key is looked up, changed if the event is newer, and given out as an update. A key without events for `ttl`
of event time is forgotten by a timer and given out once more as expired.

Defined results: an event that is not newer by `sequence` than the key's state changes nothing, so repeated and late events are without
effect while the key lives; events behind the watermark are dropped by Spark before they come here only where another operator
does so, else they count by their sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Last(StatefulProcessor):
    """The last row of a key by its sequence; a timer at its event time plus `ttl` forgets it."""

    def __init__(self, columns: list[str], key: list[str], sequence: list[str], time: str, schema: T.StructType, ttl: int | None):
        self.columns, self.key, self.sequence, self.time, self.schema, self.ttl = columns, key, sequence, time, schema, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = Row(*self.columns)(*self.last.get()) if self.last.exists() else None
        order = lambda r: tuple(r[c] for c in self.sequence)
        best = held
        for row in rows:
            if best is None or order(row) > order(best):
                best = row
        if best is held:
            return
        self.last.update(tuple(best[c] for c in self.columns))
        if self.ttl is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(best[self.time].timestamp() * 1000) + self.ttl)
        yield Row(**{c: best[c] for c in self.columns}, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            held = Row(*self.columns)(*self.last.get())
            self.last.clear()
            yield Row(**{c: held[c] for c in self.columns}, expired=True)

    def close(self) -> None:
        pass


def latest(stream: DataFrame, key: list[str], sequence: list[str], time: str, late: str = "10 minutes", ttl_seconds: int | None = None) -> DataFrame:
    """Updates of the last row of each key: all columns and `expired`; to be written in update mode.

    `time` is the timestamp that the watermark and the time to live go by.
    """
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)  # what keeps such state; read when the query starts
    columns = stream.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    out = T.StructType([*schema.fields, T.StructField("expired", T.BooleanType())])
    processor = Last(columns, key, sequence, time, schema, None if ttl_seconds is None else ttl_seconds * 1000)
    marked = stream.withWatermark(time, late)
    return marked.groupBy(*key).transformWithState(processor, out, "Update", "EventTime" if ttl_seconds is not None else "None")


def served(events: DataFrame, shown: DataFrame, key: list[str], fields: list[str], at: str, shown_at: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Feedback events with the context of what was served, for two streams or two tables.

    An event meets the servings of its `key` that came no later than it and no more than `within` before it; a context value
    that is not empty wins. An event whose result was served several times gives a row for each; one that was never served, or too
    long ago, keeps its own values and has `matched` false: in a stream once the watermarks show that no serving can come any more.
    Events and servings behind their watermark are dropped.
    """
    left = [F.col(c).alias(f"e_{c}") for c in events.columns]
    right = [F.col(c).alias(f"s_{c}") for c in dict.fromkeys([*key, shown_at, *fields])]
    if events.isStreaming:
        events, shown = events.withWatermark(at, late), shown.withWatermark(shown_at, late)
    same = [F.col(f"e_{k}") == F.col(f"s_{k}") for k in key]
    span = (F.col(f"s_{shown_at}") <= F.col(f"e_{at}")) & (F.col(f"s_{shown_at}") >= F.col(f"e_{at}") - F.expr(f"interval {within}"))
    test = span
    for one in same:
        test = test & one
    met = events.select(*left).join(shown.select(*right), test, "left_outer")
    value = lambda c: F.coalesce(F.when(F.col(f"s_{c}").cast("string") != "", F.col(f"s_{c}")), F.col(f"e_{c}")) if c in fields else F.col(f"e_{c}")
    return met.select(*(value(c).alias(c) for c in events.columns), F.col(f"s_{shown_at}").isNotNull().alias("matched"))
