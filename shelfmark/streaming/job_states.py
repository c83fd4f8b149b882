"""Jobs over a stream: queued, running, and one end each, by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: kind: submitted (deadline, items: how many results it waits for, partial_ok), result (item, status) or stopped; at: when.
EVENTS = "job string, kind string, at timestamp, item string, status string, deadline timestamp, items long, partial_ok boolean"
STATES = "job string, state string, accepted long, completed timestamp"
#: The state store that timers and maps need; a session that starts these streams sets it under spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


class Job(StatefulProcessor):
    """One job's state: what was submitted, its results by item, whether it has ended. A timer at its end (the deadline, an earlier stop, or the
    last result once all are there) fires when the watermark has passed, so that every result in time has been seen whatever the order of
    arrival; it then ends by the rules of the batch plan. What comes later is discarded. `keep` milliseconds after that, nothing is held."""

    def __init__(self, keep: int):
        self._keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", "deadline long, items long, partial_ok boolean")
        self._stop = handle.getValueState("stop", "at long")
        self._ended = handle.getValueState("ended", "at long")
        self._results = handle.getMapState("results", "item string", "status string, at long")

    def _timer(self, at: int) -> None:
        self._handle.registerTimer(at)

    def _say(self, key, state: str, accepted: int, completed: int | None = None) -> pd.DataFrame:
        when = pd.Series([None if completed is None else pd.Timestamp(completed, unit="ms")], dtype="datetime64[ns]")
        return pd.DataFrame({"job": [key[0]], "state": [state], "accepted": [accepted], "completed": when})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self._ended.exists():
            return
        known, had = self._job.exists(), next(iter(self._results.keys()), None) is not None
        for batch in rows:
            for r in batch.itertuples(index=False):
                at = _millis(r.at)
                self._timer(at + self._keep)  # nothing outlives its job's last event by more, submitted or not
                if r.kind == "submitted" and not self._job.exists():
                    self._job.update((_millis(r.deadline), int(r.items), bool(r.partial_ok)))
                    self._timer(_millis(r.deadline))
                elif r.kind == "stopped":
                    if not self._stop.exists() or self._stop.get()[0] > at:
                        self._stop.update((at,))
                        self._timer(at)
                elif r.kind == "result":
                    # of an item's results the first by time counts
                    old = self._results.getValue((r.item,)) if self._results.containsKey((r.item,)) else None
                    if old is None or old[1] > at:
                        self._results.updateValue((r.item,), (r.status, at))
                        self._timer(at)
        if not known and self._job.exists():
            yield self._say(key, "queued", 0)
        if not had and next(iter(self._results.keys()), None) is not None:
            yield self._say(key, "running", 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self._ended.exists():
            if now >= self._ended.get()[0] + self._keep:
                self._clear()
            return
        if not self._job.exists():
            last = max((v[1] for v in self._results.values()), default=0)
            if now >= max(last, self._stop.get()[0] if self._stop.exists() else 0) + self._keep:
                self._clear()
            return
        deadline, items, partial_ok = self._job.get()
        stop = self._stop.get()[0] if self._stop.exists() else None
        stops = stop is not None and stop < deadline
        end = stop if stops else deadline
        timely = [tuple(v) for v in self._results.values() if v[1] <= end]
        whole = len(timely) == items
        done = max((at for _, at in timely), default=end) if whole else end
        if now < done:
            return
        good = sum(status == "succeeded" for status, _ in timely)
        some = sum(status in ("succeeded", "partial") for status, _ in timely)
        if not whole:
            state = "canceled" if stops else "timed_out"
        elif timely and good == len(timely):
            state = "succeeded"
        else:
            state = "partial" if partial_ok and some else "failed"
        yield self._say(key, state, len(timely), done if timely or not whole else None)
        self._results.clear()
        self._ended.update((now,))
        self._timer(now + self._keep)

    def _clear(self) -> None:
        for state in (self._job, self._stop, self._ended, self._results):
            state.clear()


def job_states(events: DataFrame, late: str = "1 hour", keep_seconds: int = 86_400) -> DataFrame:
    """job, state, accepted, completed: a row when a job is queued, one when its first result comes, one when it ends. events: a stream of EVENTS
    that may be `late` out of order; later ones are dropped. A job's state fits its results' number and goes `keep_seconds` after its end, by
    event time."""
    timed = events.withWatermark("at", late)
    return timed.groupBy("job").transformWithStateInPandas(Job(1000 * keep_seconds), outputStructType=STATES, outputMode="Append", timeMode="EventTime")


def ends(states: DataFrame) -> DataFrame:
    """The rows of jobs that have ended."""
    return states.filter(~F.col("state").isin("queued", "running"))
