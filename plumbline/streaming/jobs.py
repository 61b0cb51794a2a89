"""Job states with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("done", "error")
STATES = "job string, state string, ts timestamp, orphan boolean"


class JobStates(StatefulProcessor):
    """The last state of one job. While that is not a final one, a timer stands `patience` after its last event; when the watermark passes it,
    the job is an orphan of a process that died, and becomes an error. A final state stands, whatever comes after."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, ts bigint")

    def _drop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _row(self, key: tuple, state: str, ts: int, orphan: bool) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "state": [state], "ts": [pd.Timestamp(ts, unit="ms")], "orphan": [orphan]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.timestamp() * 1000), s) for pdf in rows for t, s in zip(pdf["ts"], pdf["state"], strict=True)]
        before = self.last.get() if self.last.exists() else None
        if before is not None and before[0] in TERMINAL:
            return
        ts, state = max(new + ([(before[1], before[0])] if before is not None else []), key=lambda r: (r[1] in TERMINAL, r))
        if before is not None and (state, ts) == (before[0], before[1]):
            return
        self.last.update((state, ts))
        self._drop_timers()
        if state not in TERMINAL:
            self.handle.registerTimer(ts + self.patience)
        yield self._row(key, state, ts, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] not in TERMINAL:
            at = expiredTimerInfo.getExpiryTimeInMs()
            self.last.update(("error", at))
            yield self._row(key, "error", at, True)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, patience: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Changes of job states (job, state, ts, orphan) of a stream (job, state, ts). Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass), as timers are kept there. State is a row a job."""
    ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    rows = events.select("job", "state", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("job").transformWithStateInPandas(JobStates(ms), STATES, "Update", "EventTime")
