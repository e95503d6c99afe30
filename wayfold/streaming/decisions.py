"""The decision pipeline on streams: the batch fold's steps behind keyed state.

Rows of a session are sorted by arrival inside each micro-batch. Late and repeated fixes are
not dropped by a watermark: they become decisions, as in batch. Snapshots are rows of the stream
too: a fix takes the one that it names, or without a name the nearest in time, from a buffer of
those that came before it. State is one small object a session (its buffer holds 300 snapshots of
300 seconds at most); a session without rows for `ttl` loses it. A silence of `silence` milliseconds since the
last fix gives one no_location_timeout row, until the next fix.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, SECOND, Strategy
from ..plans import decide as D

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_FIX_MILLIS = 30_000
#: Snapshots that a buffer keeps, their age against the newest, and how far from a fix one may be.
BUFFER_ROWS, BUFFER_AGE, REACH = 300, 300 * SECOND, 3 * SECOND
#: Input of a stream: fixes, motion summaries and snapshots in one relation.
INPUT = (
    "session_id long, line_no long, kind string, raw_id long, provider string, has_t boolean, t long, recv long, start_t long, lat double, lng double, acc double, speed double, mock boolean, forced boolean, "
    "snap_id long, used long, used_cn0 double, top4_cn0 double, t0 long, t1 long, samples long, rms double, score double, still boolean"
)


class Snapshots:
    """The snapshots of a session that may still be looked up, in the order of their arrival."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, float | None]] = []  # id, time, satellites used, best signal

    def add(self, snap_id: int, t: int, used: int, top4: float | None) -> None:
        self.rows.append((snap_id, t, used, top4))
        newest = max(r[1] for r in self.rows)
        self.rows = [r for r in self.rows[-BUFFER_ROWS:] if newest - r[1] <= BUFFER_AGE]

    def find(self, snap_id: int | None, t: int) -> tuple[int, int, int, float | None] | None:
        """The last one with the id; without an id the nearest one before t within REACH, else after it."""
        if snap_id is not None:
            return next((r for r in reversed(self.rows) if r[0] == snap_id), None)
        near = [r for r in self.rows if abs(t - r[1]) <= REACH]
        return min(near, key=lambda r: (t < r[1], abs(t - r[1])), default=None)


def broken_rule(r: Any, now: int, c: Strategy = DEFAULT) -> str | None:
    """The first validation rule that a fix breaks (the row form of D.validated)."""
    if r.provider != "gps":
        return "provider_not_gps"
    if not r.has_t:
        return "missing_elapsed_realtime"
    if r.t < r.start_t - SECOND:
        return "before_record_start"
    if r.t > now + c.future_tolerance:
        return "location_from_future"
    if max(0, now - r.t) > c.max_age:
        return "location_too_old"
    if (r.lat == 0 and r.lng == 0) or abs(r.lat) > 90 or abs(r.lng) > 180:
        return "zero_coordinate"
    if not D._some(r.acc) or r.acc <= 0:
        return "invalid_accuracy"
    if r.acc > c.max_accuracy:
        return "accuracy_too_large"
    return "mock_location" if r.mock else None


class DecisionProcessor(StatefulProcessor):
    """One session's state and its timer."""

    def __init__(self, silence: int | None = NO_FIX_MILLIS, ttl: int | None = None):
        self.silence, self.ttl = silence, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", "now long, blob binary", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, now, snaps = D.State(), -1, Snapshots()
        if self.held.exists():
            now, blob = self.held.get()
            state, snaps = pickle.loads(blob)
        part = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        why, used, top4, fixes = [], [], [], 0
        for r in part.itertuples(index=False):
            known = None
            if r.kind == "snap":
                best = r.top4_cn0 if D._some(r.top4_cn0) else r.used_cn0
                snaps.add(int(r.snap_id), int(r.t), int(r.used), best if D._some(best) else None)
            elif r.kind == "fix":
                fixes += 1
                now = max(now, int(r.recv), int(r.start_t))
                known = snaps.find(int(r.snap_id) if D._some(r.snap_id) else None, int(r.t))
            why.append(broken_rule(r, now) if r.kind == "fix" else None)
            used.append(known[2] if known else None)
            top4.append(known[3] if known else None)
        listed = lambda values: pd.Series(values, index=part.index, dtype=object)
        part = part.assign(invalid=listed(why), snap_used=listed(used), snap_top4=listed(top4))
        made, state, _ = D.fold(state, part[part["kind"] != "snap"])
        self.held.update((now, pickle.dumps((state, snaps))))
        if self.silence is not None and fixes:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield _frame(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame([(key[0], None, None, None, "event", "no_location_timeout", None, None, None, None, None, None, None, None, None, None, None)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in D.SCHEMA.split(", ")]
    whole = {c.split()[0]: "Int64" for c in D.SCHEMA.split(", ") if c.endswith(" long")} | {"jitter": "Int32", "keepalive": "Int32", "new_segment": "boolean"}
    return pd.DataFrame(rows, columns=columns).astype(whole)


def decide_stream(rows: DataFrame, silence: int | None = NO_FIX_MILLIS, ttl: int | None = None) -> DataFrame:
    """Decisions of a stream of rows as INPUT describes. The session needs the RocksDB state store.

    silence and ttl are milliseconds of processing time; without both, no clock is used.
    """
    return rows.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=DecisionProcessor(silence, ttl), outputStructType=D.SCHEMA, outputMode="Append", timeMode="None" if silence is None and ttl is None else "ProcessingTime"
    )


def counts_by_window(decisions: DataFrame, time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Decisions per reason and window of a timestamp column, closed by a watermark (for dashboards)."""
    from pyspark.sql import functions as F

    return decisions.withWatermark(time, late).groupBy(F.window(time, width), "result", "reason").agg(F.count(F.lit(1)).alias("n"))
