"""Keyed state with a time to live, as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = "key STRING, value STRING, writes BIGINT"
KEPT = "value STRING, writes BIGINT"


def remembered(stream: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """(key, value, writes): the value last written under each key and how often, while it lives.

    ``stream`` has key, value and ts.  A key not written for ``ttl_seconds``
    is forgotten; written again, it starts anew.  Of one key only the latest
    value and the count are held.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, writes = state.get if state.exists else (None, 0)
        latest = None
        for part in parts:
            if len(part):
                row = part.sort_values("ts").iloc[-1]
                if latest is None or row["ts"] >= latest:
                    latest, value = row["ts"], row["value"]
                writes += len(part)
        state.update((value, writes))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({"key": [key[0]], "value": [value], "writes": [writes]})

    return stream.groupBy("key").applyInPandasWithState(update, LATEST, KEPT, "update", GroupStateTimeout.ProcessingTimeTimeout)
