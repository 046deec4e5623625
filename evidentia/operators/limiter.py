"""Sliding-log admission control with daily caps.

A request is accepted iff fewer than ``minute_limit`` accepted requests of its
client lie in the window before it. Whether one is accepted depends on earlier
acceptances, so no plain window function can decide it. Time is cut into cells of
one window length; counts per cell (a small pre-aggregate) show which cells cannot
reach the limit even together with the cell before. Their requests are accepted
without looking at single rows, and they separate the rest into independent runs.
Only runs of busy cells are replayed in order, streaming, with at most ``limit``
timestamps in memory, so neither a client nor a run is ever held as a whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from evidentia.session import broadcast_if_small, cut_lineage


def sliding_log_limit(requests: DataFrame, window_seconds: int = 60) -> DataFrame:
    """``requests`` plus ``accepted``.

    Needs ``request_id, namespace, client, ts, minute_limit``. Requests of a client
    are taken in (ts, request_id) order.
    """
    width = window_seconds * 1_000_000
    placed = _placed(requests, width)
    quiet = placed.where("_quiet").select(*requests.columns, F.lit(True).alias("accepted"))
    return quiet.unionByName(_replayed(placed, width).select(*requests.columns, "accepted"))


_KEY = ["namespace", "client"]


def _placed(requests: DataFrame, width: int) -> DataFrame:
    """``requests`` with ``_us``, ``_quiet`` (accepted whatever happens) and ``_run`` (null: none)."""
    rows = requests.withColumn("_us", F.unix_micros("ts")).withColumn("_cell", F.floor(F.col("_us") / width))
    cells = _runs(rows.groupBy(*_KEY, "_cell").agg(F.count("*").alias("_n"), F.max("minute_limit").alias("_limit")), _KEY)
    # Many cells hold a row or two, so salting all of them would cost more than it
    # saves; a cell with very many rows is split by the adaptive skew join.
    return rows.join(cells, [*_KEY, "_cell"]).drop("_cell")


def _replayed(placed: DataFrame, width: int) -> DataFrame:
    """The rows of busy cells with ``accepted``, run by run."""
    ordered = (
        placed.where(F.col("_run").isNotNull())
        .repartition(*_KEY, "_run")
        .sortWithinPartitions(*_KEY, "_run", "_us", "request_id")
    )
    schema = T.StructType([*placed.schema.fields, T.StructField("accepted", T.BooleanType())])
    return ordered.mapInPandas(_replay(width, placed.columns), schema)


def _runs(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells with ``_quiet`` and the ``_run`` they are replayed in (null: none).

    A quiet cell right before a busy one belongs to its run as the starting state.
    """
    order = W.partitionBy(*key).orderBy("_cell")
    adjacent = F.lag("_cell").over(order) == F.col("_cell") - 1
    before = F.coalesce(F.when(adjacent, F.lag("_n").over(order)), F.lit(0))
    marked = cells.withColumn("_quiet", F.col("_n") + before <= F.col("_limit"))
    follows = adjacent & ~F.lag("_quiet").over(order)
    starts = ~F.col("_quiet") & ~F.coalesce(follows, F.lit(False))
    feeds = (F.lead("_cell").over(order) == F.col("_cell") + 1) & ~F.lead("_quiet").over(order)
    numbered = marked.withColumn("_starts", starts.cast("int")).withColumn(
        "_feeds", F.coalesce(feeds, F.lit(False))
    )
    run = F.sum("_starts").over(order.rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn(
        "_run", F.when(~F.col("_quiet"), run).when(F.col("_feeds"), run + 1)
    ).drop("_n", "_limit", "_starts", "_feeds")


def accept_times(times, limit: int, width: int, held: deque) -> list[int]:
    """Positions accepted among sorted ``times``; ``held`` is the log before and after.

    Steps from one acceptance to the next, not from request to request.
    """
    accepted = []
    at, n = 0, len(times)
    while at < n and limit > 0:
        while held and times[at] - held[0] >= width:
            held.popleft()
        if len(held) >= limit:
            at = max(at + 1, int(times.searchsorted(held[0] + width, side="left")))
            continue
        held.append(int(times[at]))
        accepted.append(at)
        at += 1
    return accepted


def _replay(width: int, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for batch in batches:
            keys = [batch[c].to_numpy() for c in ("namespace", "client", "_run")]
            quiet, times = batch["_quiet"].to_numpy(), batch["_us"].to_numpy()
            limits = batch["minute_limit"].to_numpy()
            accepted = quiet.copy()
            # Rows are sorted, so a run is a stretch of equal keys; it may go on in the next batch.
            changes = np.zeros(len(batch), dtype=bool)
            changes[:1] = True
            for values in keys:
                changes[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(changes)
            for start, end in zip(starts, np.append(starts[1:], len(batch))):
                key = tuple(values[start] for values in keys)
                if key != current:
                    current, held = key, deque()
                # Rows of a quiet cell come first: all accepted, they fill the log.
                first = start + int(quiet[start:end].sum())
                held.extend(times[start:first].tolist())
                if first < end:
                    hits = accept_times(times[first:end], int(limits[first]), width, held)
                    accepted[first + np.array(hits, dtype="int64")] = True
            out = batch[columns].copy()
            out["accepted"] = accepted
            # Quiet rows are answered outside; here they only gave the starting state.
            yield out[~quiet]

    return run


def daily_caps(accepted: DataFrame, max_daily: int) -> DataFrame:
    """``namespace, day, cap_ts, cap_id``: the request that used up the day's budget.

    ``accepted``: namespace, ts, request_id, daily_limit, where no limit exceeds
    ``max_daily``: each task keeps at most that many requests of a day before the
    shuffle.
    """
    day = accepted.where(F.col("daily_limit").isNotNull()).withColumn("day", F.to_date("ts"))
    order = W.partitionBy("namespace", "day").orderBy("ts", "request_id")
    return (
        day.select("namespace", "day", "ts", "request_id", "daily_limit")
        .withColumn("_rn", F.row_number().over(order))
        .where((F.col("_rn") <= max_daily) & (F.col("_rn") == F.col("daily_limit")))
        .select("namespace", "day", F.col("ts").alias("cap_ts"), F.col("request_id").alias("cap_id"))
    )


def daily_cap(accepted: DataFrame, limit: int) -> DataFrame:
    """Adds ``within_cap``: the request is among the first ``limit`` of its namespace and day."""
    limited = accepted.withColumn("daily_limit", F.lit(limit))
    return _mark(accepted, daily_caps(limited, limit))


def _mark(requests: DataFrame, caps: DataFrame) -> DataFrame:
    day = requests.withColumn("day", F.to_date("ts"))
    after = (F.col("ts") > F.col("cap_ts")) | (
        (F.col("ts") == F.col("cap_ts")) & (F.col("request_id") > F.col("cap_id"))
    )
    return (
        day.join(broadcast_if_small(caps), ["namespace", "day"], "left")
        .withColumn("within_cap", ~F.coalesce(after, F.lit(False)))
        .drop("day", "cap_ts", "cap_id")
    )


def admit_by_policy(
    requests: DataFrame, policies: DataFrame, window_seconds: int = 60
) -> DataFrame:
    """Sliding log and daily cap together, per namespace: ``requests`` plus ``accepted``.

    ``requests``: request_id, namespace, client, ts. ``policies``: namespace,
    minute_limit, daily_limit (null: not counted by day). A request whose namespace has no
    policy stays, with ``accepted`` null.

    A request refused for the day takes no place in the log, which matters just
    after midnight. So requests after a day's cap are taken out and the log is
    computed again until the caps no longer change; two rounds are usual, and each
    round settles at least one more day. A round replays only runs that hold a request which a changed
    cap takes out or lets in: runs are independent, and removing requests never joins them. Caps are
    counted again only for days that such a run or a changed cap touches.
    """
    width = window_seconds * 1_000_000
    ruled = requests.join(broadcast_if_small(policies.withColumn("_known", F.lit(True))), "namespace", "left")
    open_ = ruled.where(F.col("_known").isNull()).drop("_known").withColumn("accepted", F.lit(None).cast("boolean"))
    known = ruled.where("_known").drop("_known")
    columns = known.columns
    max_daily = policies.agg(F.max("daily_limit")).first()[0] or 0
    placed = cut_lineage(_placed(known, width).withColumn("day", F.to_date("ts")))
    decided = cut_lineage(_replayed(placed, width))
    quiet = placed.where("_quiet").withColumn("accepted", F.lit(True))
    caps = cut_lineage(daily_caps(quiet.unionByName(decided).where("accepted"), max_daily))
    old = caps.limit(0)
    while True:  # a round settles one more day at least, so days bound the rounds
        changed = cut_lineage(_changed_caps(old, caps))
        if changed.isEmpty():
            break
        near = placed.where(F.col("_run").isNotNull()).join(broadcast_if_small(changed), ["namespace", "day"])
        flipped = near.where(F.struct("ts", "request_id") > F.struct("from_ts", "from_id"))
        dirty = broadcast_if_small(cut_lineage(flipped.select(*_KEY, "_run").distinct()))
        again = placed.join(dirty, [*_KEY, "_run"], "left_semi")
        decided = cut_lineage(
            decided.join(dirty, [*_KEY, "_run"], "left_anti").unionByName(_replayed(_within(again, caps), width).select(decided.columns))
        )
        days = broadcast_if_small(cut_lineage(again.select("namespace", "day").unionByName(changed.select("namespace", "day")).distinct()))
        touched = lambda rows: rows.join(days, ["namespace", "day"], "left_semi")
        live = _within(touched(quiet), caps).select(decided.columns).unionByName(touched(decided))
        found = daily_caps(live.where("accepted"), max_daily)
        old, caps = caps, cut_lineage(caps.join(days, ["namespace", "day"], "left_anti").unionByName(found.select(caps.columns)))
    marked = _mark(placed.drop("day"), caps)
    refused = marked.where(~F.col("within_cap")).select(*columns, F.lit(False).alias("accepted"))
    free = marked.where(F.col("within_cap") & F.col("_quiet")).select(*columns, F.lit(True).alias("accepted"))
    return free.unionByName(decided.select(*columns, "accepted")).unionByName(refused).unionByName(open_, allowMissingColumns=True)


def _within(rows: DataFrame, caps: DataFrame) -> DataFrame:
    kept = _mark(rows.drop("day"), caps).where("within_cap").drop("within_cap")
    return kept.withColumn("day", F.to_date("ts"))


def _changed_caps(old: DataFrame, new: DataFrame) -> DataFrame:
    """``namespace, day, from_ts, from_id``: days whose cap differs, and the earlier of both caps."""
    key = ["namespace", "day"]
    at = F.struct(F.col("cap_ts").alias("ts"), F.col("cap_id").alias("id"))
    both = old.select(*key, at.alias("a")).join(new.select(*key, at.alias("b")), key, "full")
    first = F.least("a", "b")  # the one there is, where only one is
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*key, first["ts"].alias("from_ts"), first["id"].alias("from_id"))


def admit(
    requests: DataFrame, ip_limit: int = 30, visitor_limit: int = 5, daily_limit: int = 500,
    window_seconds: int = 60,
) -> DataFrame:
    """Address limit first, then the visitor limit with the daily cap: ``request_id, ip_ok, accepted``.

    ``requests``: request_id, ip, visitor, ts. The address log counts a request even
    if the visitor step then refuses it.
    """
    # Every round of the visitor step starts from these few columns, so they are kept.
    by_ip = cut_lineage(
        sliding_log_limit(
            requests.select(
                "request_id", "visitor", "ts", F.lit("ip").alias("namespace"), F.col("ip").alias("client"),
                F.lit(ip_limit).alias("minute_limit"),
            ),
            window_seconds,
        )
    )
    policy = by_ip.sparkSession.range(1).select(
        F.lit("visitor").alias("namespace"), F.lit(visitor_limit).alias("minute_limit"),
        F.lit(daily_limit).alias("daily_limit"),
    )
    passed = by_ip.where("accepted").select(
        "request_id", F.lit("visitor").alias("namespace"), F.col("visitor").alias("client"), "ts"
    )
    by_visitor = admit_by_policy(passed, policy, window_seconds)
    refused = by_ip.where(~F.col("accepted")).select(
        "request_id", F.lit(False).alias("ip_ok"), F.lit(False).alias("accepted")
    )
    return by_visitor.select("request_id", F.lit(True).alias("ip_ok"), "accepted").unionByName(refused)
