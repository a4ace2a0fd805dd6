"""Streams of migration records: each record is checked against the one before it in its history as it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import ZERO


def watch_chain(records: DataFrame) -> DataFrame:
    """history_id, seq, id, ok of every record of a stream of history_id, seq, id, parent_hash, resulting_hash.

    The state is one hash for each history.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ZERO
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            out.append((key[0], r.seq, r.id, r.parent_hash == last))
            last = r.resulting_hash
        state.update((last,))
        yield pd.DataFrame(out, columns=["history_id", "seq", "id", "ok"])

    kind = records.schema["history_id"].dataType.simpleString()
    return records.groupBy("history_id").applyInPandasWithState(step, f"history_id {kind}, seq long, id string, ok boolean", "last string", "append", GroupStateTimeout.NoTimeout)
