"""The lifecycle fold over a stream of normalised observations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import KEYS, STATE, advance

_NAMES = [c.split()[0] for c in STATE.split(", ")]
_TIMES = ("first_seen_at", "last_observed_at", "terminal_at", "updated_at")


def plain(value: object) -> object:
    if isinstance(value, pd.Timestamp):
        return None if value is pd.NaT else value.to_pydatetime()
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def current_stream(clean: DataFrame) -> DataFrame:
    """A job's state after each micro-batch that has observations of it; they are folded in order of arrival.

    Observations with errors are left out. The rules are those of the batch form, of which this uses the step.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(_NAMES, state.get, strict=True)) if state.exists else None
        if now is not None:
            now = {k: plain(v) for k, v in now.items()}
        rows = pd.concat(list(parts)).sort_values("arrival", kind="stable")
        for r in rows.to_dict("records"):
            r = {k: plain(v) for k, v in r.items() if k != "errors"}
            for n in ("observation_order", "total_requests", "completed_requests", "failed_requests"):
                r[n] = int(r[n])
            now = advance(now, r)
        state.update(tuple(now[n] for n in _NAMES))
        out = pd.DataFrame([[now[n] for n in _NAMES]], columns=_NAMES)
        for n in _TIMES:
            out[n] = pd.to_datetime(out[n])
        yield out

    fine = clean.where("size(errors) = 0")
    return fine.groupBy(*KEYS).applyInPandasWithState(update, STATE, STATE, "update", GroupStateTimeout.NoTimeout)
