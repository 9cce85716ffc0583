"""Jobs watched until they end: the lifecycle fold with deadlines and forgetting.

A job's state is one value, and its observations of a micro-batch go through it one after the other, in order of arrival.
A job that hasn't ended has a timer; one that isn't heard of until then is given out once as timed out. An ended job is
kept for a while, for late observations, and then forgotten. State lies in RocksDB, so it may be larger than memory.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..errors import ValidationError
from ..operators.lifecycle import KEYS, STATE, advance
from ..schemas import TERMINAL_STATUSES
from .lifecycle import plain

EVENT = "event string"
OUT = f"{STATE}, {EVENT}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_TIMES = ("first_seen_at", "last_observed_at", "terminal_at", "updated_at")
_COUNTS = ("observation_order", "total_requests", "completed_requests", "failed_requests")


def _dump(state: dict[str, Any]) -> str:
    return json.dumps({n: state[n].isoformat() if n in _TIMES and state[n] is not None else state[n] for n in _NAMES})


def _load(text: str) -> dict[str, Any]:
    return {n: pd.Timestamp(v).to_pydatetime() if n in _TIMES and v is not None else v for n, v in json.loads(text).items()}


class JobWatch(StatefulProcessor):
    """One key is one job. wait: milliseconds from a job's last observation to its deadline. keep: milliseconds that an ended job is kept."""

    def __init__(self, wait: int, keep: int) -> None:
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "job string, deadline long")
        self.ended = handle.getValueState("ended", "job string", self.keep)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.open.get()
        late = None if held else self.ended.get()
        now = _load(held[0]) if held else _load(late[0]) if late else None
        parts = [r.sort_values("arrival", kind="stable").to_dict("records") for r in rows]
        for r in heapq.merge(*parts, key=lambda r: r["arrival"]):
            r = {k: plain(v) for k, v in r.items() if k != "errors"}
            for n in _COUNTS:
                r[n] = int(r[n])
            now = advance(now, r)
        if held:
            self.handle.deleteTimer(held[1])
        if now["batch_status"] in TERMINAL_STATUSES:
            if held:
                self.open.clear()
            self.ended.update((_dump(now),))
        else:
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.open.update((_dump(now), deadline))
            self.handle.registerTimer(deadline)
        yield _frame(now, "observed")

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The job stays open: a later observation goes on from its state, with a new deadline."""
        if held := self.open.get():
            yield _frame(_load(held[0]), "timed_out")

    def close(self) -> None:
        return None


def _frame(state: dict[str, Any], event: str) -> pd.DataFrame:
    out = pd.DataFrame([[*(state[n] for n in _NAMES), event]], columns=[*_NAMES, "event"])
    for n in _TIMES:
        out[n] = pd.to_datetime(out[n])
    return out


def prepare(spark: SparkSession) -> None:
    """Keep the session's streaming state in RocksDB, which timers and forgetting need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def watched(clean: DataFrame, wait_seconds: float = 3600.0, keep_seconds: float = 86_400.0) -> DataFrame:
    """Normalised observations -> a job's state after each micro-batch that has observations of it (event: observed), and once when
    it isn't heard of for wait_seconds and hasn't ended (timed_out).

    Observations with errors are left out. keep_seconds after it has ended a job is forgotten; what comes still later begins a
    new one. Call prepare() before the query starts.
    """
    wait, keep = (round(1000 * s) for s in (wait_seconds, keep_seconds))
    if wait <= 0 or keep <= 0:
        raise ValidationError("waiting and keeping take some time", wait=wait_seconds, keep=keep_seconds)
    fine = clean.where("size(errors) = 0")
    return fine.groupBy(*KEYS).transformWithStateInPandas(JobWatch(wait, keep), OUT, "Update", "ProcessingTime")
