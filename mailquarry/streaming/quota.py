"""Sliding call quotas per key: rejected calls are not recorded."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MINUTE_CALLS, DAY_CALLS = 4, 500


class Window:
    """The admitted calls of one key, oldest first."""

    def __init__(self, times: list[float] | None = None):
        self.times = deque(times or [])

    def admit(self, at: float) -> bool:
        while self.times and self.times[0] <= at - 86_400:
            self.times.popleft()
        recent = sum(t > at - 60 for t in list(self.times)[-MINUTE_CALLS:])
        if recent >= MINUTE_CALLS or len(self.times) >= DAY_CALLS:
            return False
        self.times.append(at)
        return True


def admitted_calls(calls: DataFrame) -> DataFrame:
    """(key, call_id, admitted) of calls (key, call_id, ts) in order of time, then id.

    At most 4 admitted calls in the last 60 seconds and 500 in the last 24
    hours of a key. Memory of a key is its window, not its calls: the rows
    come sorted and go through one at a time. A call without a key or a time
    is refused. What is admitted depends on all admitted before it, so one key
    is sequential by nature.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, Window()
        for f in frames:
            out = []
            for k, at in zip(f["key"], f["at"], strict=True):
                if k != key:
                    key, window = k, Window()
                out.append(window.admit(at))
            yield pd.DataFrame({"key": f["key"], "call_id": f["call_id"], "admitted": out})

    rows = calls.where("key is not null and ts is not null").selectExpr("key", "call_id", "unix_micros(ts) / 1000000D AS at")
    refused = calls.where("key is null or ts is null").selectExpr("key", "call_id", "false AS admitted")
    return rows.repartition("key").sortWithinPartitions("key", "at", "call_id").mapInPandas(run, "key string, call_id long, admitted boolean").unionByName(refused)
