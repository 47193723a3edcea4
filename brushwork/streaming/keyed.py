"""Per-key state in Spark's state store: a gap-collapsed clock that is right for late rows too.

`clocked` holds each key's rows by pane of time until the watermark has passed the pane; a timer then takes the pane's rows in time
order, adds their clock and lets go of them. What stays per key is its last time and its clock, and nothing of a key that has been
still for `idle`: its clock then begins anew. So state is bounded by the rows within the watermark's delay and one row per live key.
Rows later than the watermark allows are dropped by Spark, which counts them (`feeds.run` returns their number). A key's open panes
are read one at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PaneClock(StatefulProcessor):
    """Emits (key, id, at, clock) when a pane has closed."""

    def __init__(self, gap: float, pane_ms: int, idle_ms: int | None):
        self.gap, self.pane_ms, self.idle_ms = gap, pane_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "at double, clock double, pane long")
        self.held = handle.getMapState("held", "pane long", "at array<double>, id array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            pane = batch["ms"].to_numpy() // self.pane_ms
            for p in np.unique(pane).tolist():
                mine = batch[pane == p]
                old = self.held.getValue((p,)) if self.held.containsKey((p,)) else ([], [])
                self.held.updateValue((p,), (list(old[0]) + mine["at"].tolist(), list(old[1]) + mine["id"].tolist()))
                self.handle.registerTimer((p + 1) * self.pane_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        p = due // self.pane_ms - 1
        if self.held.containsKey((p,)):
            at, ids = self.held.getValue((p,))
            order = np.lexsort((ids, at))
            at, ids = np.array(at, float)[order], np.array(ids, np.int64)[order]
            last, clock = self.end.get()[:2] if self.end.exists() else (at[0], 0.0)
            clocks = clock + np.cumsum(np.clip(np.diff(at, prepend=last), 0.0, self.gap))
            self.end.update((float(at[-1]), float(clocks[-1]), p))
            self.held.removeKey((p,))
            if self.idle_ms is not None:
                self.handle.registerTimer(due + self.idle_ms)
            yield pd.DataFrame({"key": key[0], "id": ids, "at": at, "clock": clocks})
        elif self.idle_ms is not None and self.end.exists() and due - (self.end.get()[2] + 1) * self.pane_ms >= self.idle_ms:
            self.end.clear()

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """State by key and timers need the store on local disks with checkpoints in the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def clocked(stream: DataFrame, key: str, row_id: str, ts: str, at: str, gap: float, pane_seconds: int, watermark: str, idle_seconds: int | None = None) -> DataFrame:
    """key, id, at, clock of a stream's rows, as their panes close; `at` is the time `ts` as a number in the unit of `gap`. Rows without a key share one;
    rows without a time have no clock and are left out."""
    use_state_store(stream.sparkSession)
    rows = (stream.withWatermark(ts, watermark).where(F.col(at).isNotNull() & F.col(ts).isNotNull())
            .select(ts, F.col(key).cast("string").alias("key"), F.col(row_id).cast("long").alias("id"), F.col(at).cast("double").alias("at"), F.unix_millis(ts).alias("ms")))
    return rows.groupBy("key").transformWithStateInPandas(
        PaneClock(gap, pane_seconds * 1000, None if idle_seconds is None else idle_seconds * 1000), "key string, id long, at double, clock double", "Append", "EventTime")
