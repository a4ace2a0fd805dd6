"""A stream of migration records put in order and checked, whatever order they come in.

A history's state is the number and hash that come next, and the records that came before their turn.  Those wait until what is missing
is there, or until the stream's time (its watermark) is ``patience`` past the first of them; then they are told as standing
behind a gap, and the history goes on from them.  A history without records for ``forget`` leaves the state; if it goes on later,
its records are behind a gap.

Outcomes: ok; broken (the parent isn't the hash before it); gap (what stood before it never came in time); repeated (its place
in the history has been told already).  Every record gets one, once.

State: one row for each live history, and its waiting records, which patience bounds by the stream's rate.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import ZERO

_FIELDS = ["seq", "id", "parent_hash", "resulting_hash"]
_STATE = "next long, last string, waiting string, since long, seen long"


def _judged(rows: pd.DataFrame, next_: int, last: str) -> tuple[pd.DataFrame, pd.DataFrame, int, str]:
    """Records told, those that wait, and what comes next then; rows in the order of their arrival."""
    rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
    again = (rows["seq"] < next_) | rows["seq"].duplicated()
    told = [rows[again].assign(outcome="repeated")]
    rest = rows[~again].reset_index(drop=True)
    run = int(np.argmin(np.append(rest["seq"].to_numpy() == next_ + np.arange(len(rest)), False)))
    now, wait = rest[:run], rest[run:]
    if run:
        want = np.array([last, *now["resulting_hash"][:-1]], object)
        told.append(now.assign(outcome=np.where(now["parent_hash"].to_numpy() == want, "ok", "broken")))
        next_, last = int(now["seq"].iloc[-1]) + 1, now["resulting_hash"].iloc[-1]
    return pd.concat(told), wait, next_, last


def _given_up(wait: pd.DataFrame) -> tuple[pd.DataFrame, int, str]:
    """Waiting records whose turn doesn't come: the first of each run stands behind a gap, others are checked against it."""
    seq = wait["seq"].to_numpy()
    first = np.append(True, seq[1:] != seq[:-1] + 1)
    fits = np.append(True, wait["parent_hash"].to_numpy()[1:] == wait["resulting_hash"].to_numpy()[:-1])
    return wait.assign(outcome=np.where(first, "gap", np.where(fits, "ok", "broken"))), int(seq[-1]) + 1, wait["resulting_hash"].iloc[-1]


def track(records: DataFrame, time: str = "ts", patience_s: int = 3600, forget_s: int = 30 * 86400) -> DataFrame:
    """history_id, seq, id, outcome of every record of a stream (history_id, seq, id, parent_hash, resulting_hash and a time with a watermark)."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_, last, text, since, seen = state.get if state.exists else (1, ZERO, "", 0, 0)
        kinds = {"seq": "int64", "id": str, "parent_hash": str, "resulting_hash": str}
        wait = pd.read_json(io.StringIO(text), orient="split", dtype=kinds) if text else pd.DataFrame(columns=_FIELDS).astype({"seq": "int64"})
        if state.hasTimedOut:
            if not len(wait):
                state.remove()
                return
            told, next_, last = _given_up(wait)
            wait = wait[:0]
        else:
            new = pd.concat(list(frames), ignore_index=True)
            seen = max(seen, int(new[time].max().value // 1_000_000))
            had = bool(len(wait))
            told, wait, next_, last = _judged(pd.concat([wait, new[_FIELDS]], ignore_index=True) if had else new[_FIELDS], next_, last)
            since = since if had else seen
        state.update((next_, last, wait.to_json(orient="split", index=False) if len(wait) else "", since, seen))
        due = since + patience_s * 1000 if len(wait) else seen + forget_s * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if len(told):
            yield pd.DataFrame({"history_id": [key[0]] * len(told), "seq": told["seq"].astype("int64").to_numpy(), "id": told["id"].to_numpy(), "outcome": told["outcome"].to_numpy()})

    kind = records.schema["history_id"].dataType.simpleString()
    return records.groupBy("history_id").applyInPandasWithState(step, f"history_id {kind}, seq long, id string, outcome string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
