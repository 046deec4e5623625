"""Rolling conversation memory and stale answers as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.functions.text import estimate_tokens_ws, summary_line
from evidentia.operators.conversations import SHORTEST_LINE
from evidentia.streaming.runs import with_state_store

_OUT = (
    "conversation_id bigint, summary string, summarized_through_sequence int,"
    " recent_sequences array<int>, recent_messages array<struct<role:string,content:string>>"
)


class RollingMemory(StatefulProcessor):
    """State per conversation: the newest messages and the summary of all before them."""

    def __init__(self, n: int, budget: int, max_chars: int, head: int = 600):
        self.n, self.budget, self.max_chars, self.head = n, budget, max_chars, head

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState(
            "recent", "sequence_no int, role string, content string, line string, tokens bigint"
        )
        self.summary = handle.getValueState("summary", "summary string, through int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        summary, through = self.summary.get() if self.summary.exists() else ("", 0)
        for row in self._arrived(rows).itertuples(index=False, name=None):
            recent.append(row)
            if len(recent) > self.n:
                oldest = recent.pop(0)
                summary = "\n".join(part for part in (summary, oldest[3]) if part).strip()
                if len(summary) > self.max_chars:
                    summary = summary[: self.head] + "\n…\n" + summary[-(self.max_chars - self.head - 3):]
                through = oldest[0]
        self.recent.put([(int(s), r, c, l, int(t)) for s, r, c, l, t in recent])
        self.summary.update((summary, int(through)))
        kept, used = [], 0
        for row in reversed(recent):
            if kept and used + row[4] > self.budget:
                break
            kept.insert(0, row)
            used += row[4]
        yield pd.DataFrame(
            {
                "conversation_id": [key[0]], "summary": [summary], "summarized_through_sequence": [int(through)],
                "recent_sequences": [[int(r[0]) for r in kept]],
                "recent_messages": [[{"role": r[1], "content": r[2]} for r in kept]],
            }
        )

    def _arrived(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The messages in order; of very many in one micro-batch only those at both ends.

        A clipped summary keeps its head and its tail, and a line takes ``SHORTEST_LINE`` characters at least. So the
        first ``ends`` messages fill the head, the last ones the tail, and what lies between never shows.
        """
        ends = self.max_chars // SHORTEST_LINE + self.n + 2
        first = last = None
        for part in rows:
            part = part[["sequence_no", "role", "content", "line", "tokens"]]
            first = (part if first is None else pd.concat([first, part])).nsmallest(ends, "sequence_no")
            last = (part if last is None else pd.concat([last, part])).nlargest(ends, "sequence_no")
        return pd.concat([first, last[~last["sequence_no"].isin(first["sequence_no"])]]).sort_values("sequence_no")

    def close(self) -> None:
        pass


def stream_memory(messages: DataFrame, n: int = 8, budget: int = 2500, max_chars: int = 4000) -> DataFrame:
    """Memory of each conversation after every micro-batch that touched it.

    The summary is clipped after every message, so a long one differs from a single
    batch step over the same messages.
    """
    with_state_store(messages.sparkSession)
    prepared = messages.where(F.col("status") == "completed").select(
        F.col("conversation_id").cast("long").alias("conversation_id"), "sequence_no", "role", "content",
        summary_line(F.col("role"), F.col("content")).alias("line"),
        estimate_tokens_ws(F.col("content")).alias("tokens"),
    )
    return prepared.groupBy("conversation_id").transformWithStateInPandas(
        statefulProcessor=RollingMemory(n, budget, max_chars), outputStructType=_OUT, outputMode="append", timeMode="None"
    )


#: Answers share this many groups, each with one state and one timer; a call of the processor serves a whole group.
STALE_GROUPS = 1024


class StaleAnswers(StatefulProcessor):
    """State per group of answers: which are open and since when. A timer reports those that did not end in time."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Two arrays of 64-bit numbers, so that a group is read and written in one call.
        self.open = handle.getValueState("open", "generation_ids binary, started_ms binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        events = pd.concat(list(rows))[["generation_id", "phase", "ts_ms"]].sort_values(["ts_ms", "phase"], ascending=[True, False])
        # What is open comes first, as a start; the last start of an answer counts, and an end in time after it.
        known = held.rename(columns={"started_ms": "ts_ms"}).assign(phase="started")
        events = pd.concat([known, events], ignore_index=True)
        events["place"] = events.index
        starts = events[events["phase"] == "started"].drop_duplicates("generation_id", keep="last")
        ends = events[events["phase"] != "started"].merge(starts, on="generation_id", suffixes=("", "_start"))
        ended = ends[(ends["place"] > ends["place_start"]) & (ends["ts_ms"] - ends["ts_ms_start"] <= self.timeout_ms)]
        left = starts[~starts["generation_id"].isin(ended["generation_id"])]
        self._keep(held, left.rename(columns={"ts_ms": "started_ms"}))
        yield held[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        stale = held["started_ms"] + self.timeout_ms <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        # The timer that has fired is gone, so none is left to delete.
        self._keep(held[:0], held[~stale])
        found = held[stale]
        yield found.assign(generation_id=None) if key[0] is None else found

    def _held(self) -> pd.DataFrame:
        ids, starts = self.open.get() if self.open.exists() else (b"", b"")
        return pd.DataFrame({"generation_id": np.frombuffer(ids, "<i8"), "started_ms": np.frombuffer(starts, "<i8")})

    def _keep(self, before: pd.DataFrame, after: pd.DataFrame) -> None:
        """``after`` is what is open now; the group's timer stands at the first of them."""
        old, new = (int(t["started_ms"].min()) if len(t) else None for t in (before, after))
        if old is not None and old != new:
            self.handle.deleteTimer(old + self.timeout_ms)
        if new is not None and old != new:
            self.handle.registerTimer(new + self.timeout_ms)
        if len(after):
            self.open.update(tuple(after[c].to_numpy("<i8").tobytes() for c in ("generation_id", "started_ms")))
        elif self.open.exists():
            self.open.clear()

    def close(self) -> None:
        pass


def stream_stale(generations: DataFrame, timeout_seconds: int = 120, delay: str = "0 seconds") -> DataFrame:
    """Answers (``generation_id, phase, ts``) without an end within the timeout, by event time.

    Answers are grouped by a hash of their id, so a micro-batch calls Python once per group and not once per answer.
    """
    with_state_store(generations.sparkSession)
    answer = F.col("generation_id")
    # Events without an id are one answer, in a group of their own.
    group = F.when(answer.isNotNull(), F.pmod(F.xxhash64(answer), F.lit(STALE_GROUPS)))
    keyed = generations.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        group.alias("answers"), F.coalesce(answer, F.lit(0)).cast("long").alias("generation_id"), "phase",
        F.unix_millis("ts").alias("ts_ms"), "ts",
    )
    return keyed.groupBy("answers").transformWithStateInPandas(
        statefulProcessor=StaleAnswers(timeout_seconds * 1000),
        outputStructType="generation_id bigint, started_ms bigint", outputMode="append", timeMode="EventTime",
    )
