"""Sliding-log admission control on a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.operators.limiter import accept_times
from evidentia.streaming.runs import with_state_store

#: Rows of one client handed on at once.
_SLICE = 100_000
_OUT = "namespace string, client string, request_id bigint, ts_us bigint, accepted boolean"


class SlidingLog(StatefulProcessor):
    """State per client: the accepted times inside the window, never more than the limit."""

    def __init__(self, window_seconds: int, forget_seconds: int | None):
        self.width = window_seconds * 1_000_000
        self.ttl_ms = None if forget_seconds is None else forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "ts_us bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Of a client's rows in a micro-batch only time and id are held, 16 bytes each; they arrive in any order.
        times, ids, limit = [], [], 0
        for part in rows:
            times.append(part["ts_us"].to_numpy())
            ids.append(part["request_id"].to_numpy())
            limit = int(part["minute_limit"].iloc[0])
        times, ids = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        held = deque(row[0] for row in self.log.get()) if self.log.exists() else deque()
        accepted = np.zeros(len(times), dtype=bool)
        accepted[accept_times(times, limit, self.width, held)] = True
        if held:
            self.log.put([(t,) for t in held])
        for low in range(0, len(times), _SLICE):
            part = slice(low, low + _SLICE)
            yield pd.DataFrame(
                {"namespace": key[0], "client": key[1], "request_id": ids[part], "ts_us": times[part], "accepted": accepted[part]}
            )

    def close(self) -> None:
        pass


def stream_limit(requests: DataFrame, window_seconds: int = 60, forget_seconds: int | None = None) -> DataFrame:
    """Decides every request as it arrives; requests of one micro-batch are taken in time order.

    With ``forget_seconds`` a client's state goes that long, in clock time, after its last accepted request. It
    should be the window and the longest outage to be expected. Such a stream needs a trigger that runs on;
    one that ends with the available input keeps its states.
    """
    if forget_seconds is not None and forget_seconds < window_seconds:
        raise ValueError("a state must outlive the window")
    with_state_store(requests.sparkSession)
    narrow = requests.select(
        "namespace", "client", "request_id", F.unix_micros("ts").alias("ts_us"), "minute_limit"
    )
    return narrow.groupBy("namespace", "client").transformWithStateInPandas(
        statefulProcessor=SlidingLog(window_seconds, forget_seconds), outputStructType=_OUT, outputMode="append",
        timeMode="None" if forget_seconds is None else "ProcessingTime",
    )
