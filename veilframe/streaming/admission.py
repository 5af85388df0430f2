"""Streaming sliding-window admission with keyed state (``transformWithStateInPandas``).

State per key is the list of admitted times still inside the window, with how many
requests each holds (never more than ``limit`` in all).  The requests of a key in a
micro-batch are replayed in (t, id) order.  Admission goes by arrival, so there is no
watermark and no row is dropped: a row older than the newest admitted entry of the
batches before it is decided as of that entry's time and marked ``late``
(``late_rows`` is the side output).  In a continuous stream ``idle_ms`` sets a
processing-time timer, moved on by every batch, that clears a key silent for so long.
Without it a silent key keeps its at most ``limit`` entries; a run over the data
available now needs it so, because timers keep Spark waiting for them.
"""

from __future__ import annotations

import sys
import time
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilframe.functions import replay
from veilframe.functions.replay import decide
from veilframe.operators.ratelimit import WINDOW_MS

OUTPUT = "rl_key string, event_id long, t long, admitted boolean, current int, retry_after_ms long, late boolean"
EMIT = 100_000  # rows of one emitted frame
# the state store that keyed list state and timers need; Spark's, not ours
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Admission(StatefulProcessor):
    """Keyed replay; ``limit`` is a number or, if None, the input's ``limit`` column."""

    def __init__(self, limit: int | None, window_ms: int, idle_ms: int | None):
        self.limit, self.window_ms, self.idle_ms = limit, window_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "t long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["t"].to_numpy(np.int64), f["event_id"].to_numpy(np.int64),
                  np.full(len(f), self.limit) if self.limit is not None else f["limit"].to_numpy(np.int64)) for f in rows]
        t, ids, limits = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((ids, t))
        t, ids, limits = t[order], ids[order], limits[order]
        live = deque((int(e[0]), int(e[1])) for e in self.entries.get()) if self.entries.exists() else deque()
        newest = live[-1][0] if live else None
        late = np.zeros(len(t), dtype=bool) if newest is None else t < newest
        ok, current, retry = decide(t if newest is None else np.maximum(t, newest), limits, self.window_ms, live)
        if live:
            self.entries.put(list(live))
        else:
            self.entries.clear()
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(time.time() * 1000) + self.idle_ms)
        for a in range(0, len(t), EMIT):
            b = slice(a, a + EMIT)
            yield pd.DataFrame({"rl_key": pd.Series([key[0]] * len(t[b]), dtype="object"), "event_id": ids[b], "t": t[b], "admitted": ok[b],
                                "current": current[b].astype("int32"), "retry_after_ms": retry[b].astype("int64"), "late": late[b]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, limit: int | str, window_ms: int = WINDOW_MS, idle_ms: int | None = None) -> DataFrame:
    """``events(rl_key, t, event_id)`` -> one decision per request, in append mode.

    ``limit`` is a number for all keys or the name of a column with each key's own limit (0 admits
    nothing).  ``idle_ms``, at least the window, is how long a silent key keeps its state.  Sets the
    session's state store provider to the one that this state needs."""
    events.sparkSession.conf.set(*STATE_STORE)
    # Spark also loads the processor in a helper process on the driver, which sees no shipped
    # package: the processor and what it calls travel by value
    for module in (replay, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    column = isinstance(limit, str)
    rows = events.select("rl_key", "t", "event_id", *([F.col(limit).cast("long").alias("limit")] if column else []))
    processor = Admission(None if column else limit, window_ms, None if idle_ms is None else max(idle_ms, window_ms))
    return rows.groupBy("rl_key").transformWithStateInPandas(processor, OUTPUT, "append", "None" if idle_ms is None else "ProcessingTime")


def late_rows(decisions: DataFrame) -> DataFrame:
    """The side output: decisions on rows that came after newer ones had been admitted."""
    return decisions.where("late")


def request_counts_stream(events: DataFrame, ts_col: str, window: str, watermark: str, keys) -> DataFrame:
    """M6: per-window counters on event time; late rows beyond the watermark
    are dropped, windows are emitted once closed (append mode)."""
    return (events.withWatermark(ts_col, watermark)
                  .groupBy(F.window(ts_col, window), *keys)
                  .agg(F.count(F.lit(1)).alias("n")))


def mapping_ttl_join(mappings: DataFrame, responses: DataFrame, ttl_seconds: int, watermark: str) -> DataFrame:
    """A6/A7 streaming: a response may use a request's mapping only while the
    mapping lives (``staged_at <= sent_at <= staged_at + ttl``).  Watermarks
    on both sides let Spark drop join state once no match is possible."""
    m = mappings.withWatermark("staged_at", watermark).alias("m")
    r = responses.withWatermark("sent_at", watermark).alias("r")
    cond = ((F.col("m.request_id") == F.col("r.request_id"))
            & (F.col("r.sent_at") >= F.col("m.staged_at"))
            & (F.col("r.sent_at") <= F.col("m.staged_at") + F.expr(f"INTERVAL {ttl_seconds} SECONDS")))
    return m.join(r, cond, "inner")
