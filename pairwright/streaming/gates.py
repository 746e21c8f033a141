"""A gate over a stream of samples: streaks in keyed state, cut by silence through event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


COLUMNS = ["_key", "_ts", "_tie", "_over", "_at"]


@contextmanager
def timers_allowed(spark: SparkSession):
    """Queries that start in here keep their state in the store that has timers."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Gate(StatefulProcessor):
    """``need`` samples in a row over the limit open the gate; more than ``silence`` milliseconds without a sample end a streak."""

    def __init__(self, need: int, silence: int) -> None:
        self.need, self.silence = need, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("streak", "streak int, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, last = self.state.get() if self.state.exists() else (0, 0)
        if streak:
            self.handle.deleteTimer(last + self.silence)
        out = []
        # frames may come without the columns' names; a key has few rows, for which whole frames are slow to join and sort
        parts = [[f.iloc[:, COLUMNS.index(c)].to_numpy() for c in ("_at", "_tie", "_over")] for f in rows]
        ats, ties, overs = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ties, ats))
        for at, over in zip(ats[order].tolist(), overs[order].tolist()):
            if streak and at - last > self.silence:
                out.append((key[0], last + self.silence, "silent", streak))
                streak = 0
            streak, last = (streak + 1 if over else 0), int(at)
            if streak == self.need:
                out.append((key[0], last, "open", streak))
        if streak:
            self.state.update((streak, last))
            self.handle.registerTimer(last + self.silence)
        else:
            self.state.clear()
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            streak, last = self.state.get()
            out.append((key[0], last + self.silence, "silent", streak))
            self.state.clear()
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "at", "event", "streak"])

    def close(self) -> None:
        pass


def gate_events(samples: DataFrame, key: str, ts: str, tie: str, over, need: int, silence_ms: int, late: str) -> DataFrame:
    """key, at (epoch milliseconds), event (open or silent) and streak, from a stream of samples.

    Samples of a batch are taken in order of time, and batches are expected in that order; what is later than the
    watermark is dropped. A key that falls silent is told of when the watermark passes its time-out, even if no sample of it comes any
    more. Start the query within ``timers_allowed``.
    """
    timed = samples.select(
        F.col(key).cast("bigint").alias("_key"), F.col(ts).cast("timestamp").alias("_ts"), F.col(tie).cast("bigint").alias("_tie"), F.coalesce(over, F.lit(False)).alias("_over")
    )
    timed = timed.withColumn("_at", F.unix_millis("_ts")).withWatermark("_ts", late)
    timed = timed.select(*COLUMNS)
    return timed.groupBy("_key").transformWithStateInPandas(Gate(need, silence_ms), "key bigint, at bigint, event string, streak int", "Append", "EventTime")
