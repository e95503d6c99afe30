"""The ordered decision pipeline of a session: one step function for batch and streaming.

step(state, row) takes one motion summary or one valid fix and returns the next state's output.
Rows come in arrival order. The state is one plain object a session, of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import DEFAULT, EARTH_RADIUS, SECOND, Strategy

TRANSPORT = frozenset({"transport_suspected", "transport_confirmed", "transport_recovery"})
STILL = frozenset({"stationary_keepalive", "stationary_jitter", "stationary_anchor_refined", "stationary_accel_supported_jitter"})
_f = np.float32


def metres(a: Any, b: Any) -> float:
    p, q = math.radians(a.lat), math.radians(b.lat)
    x, y = math.sin(math.radians(b.lat - a.lat) / 2), math.sin(math.radians(b.lng - a.lng) / 2)
    h = x * x + math.cos(p) * math.cos(q) * y * y
    return 2 * EARTH_RADIUS * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@dataclass
class Fix:
    raw_id: int
    t: int
    lat: float
    lng: float
    acc: float
    speed: float | None = None
    used: int | None = None  # satellites of its snapshot
    top4: float | None = None


@dataclass
class Motion:
    t0: int
    t1: int
    samples: int
    rms: float
    score: float
    still: bool


@dataclass
class Outcome:
    result: str
    reason: str
    metres: float = 0.0
    seconds: float = 0.0
    new_segment: bool = False
    jitter: int = 0
    keepalive: int = 0


@dataclass
class State:
    """All that a session carries from row to row."""

    point: Fix | None = None
    point_id: int = 0
    point_moved: bool = False  # whether the last point has a distance or a time
    segment: int = 1
    decisions: int = 0
    kept_at: int = 0
    forced: bool = False
    transport: bool = False
    transport_fix: Fix | None = None
    leaving: Fix | None = None
    rest: str = "MOVING"
    anchor: Fix | None = None
    candidate: Fix | None = None
    candidate_t: int = 0
    candidate_n: int = 0
    probing: int = 0
    shaken: bool = False
    motions: list[Motion] = field(default_factory=list)


def _base(s: State, x: Fix, c: Strategy) -> Outcome:
    """What one fix is, against the last trusted point alone."""
    if s.point is None:
        for limit, out in ((c.first_good, ("anchor", "first_fix_good")), (c.first_relaxed, ("anchor", "first_fix_relaxed")), (c.first_forced if s.forced else -1.0, ("anchor", "forced_weak_first_fix")), (c.first_weak, ("weak", "weak_first_fix"))):
            if x.acc <= limit:
                return Outcome(*out)
        return Outcome("reject", "first_fix_accuracy_too_large")
    if x.acc > c.ordinary:
        return Outcome("weak", "weak_signal_stage1")
    far = metres(s.point, x)
    took = (x.t - s.point.t) / 1e9
    if took <= 0:
        return Outcome("reject", "non_positive_delta_time")
    pace = far / took
    reported = x.speed is not None and c.transport_speed <= x.speed <= c.transport_top_speed and c.transport_speed <= pace <= c.transport_top_speed and far >= c.transport_metres_with_speed
    sustained = c.transport_speed <= pace <= c.impossible_speed and far >= c.transport_metres and took >= c.transport_seconds
    gap = x.t - s.point.t > c.gap
    if pace > c.impossible_speed and not reported:
        return Outcome("reject", "impossible_speed")
    if (reported or sustained) and not gap:
        return Outcome("reject", "transport_suspected")
    if far < max(c.still_metres, x.acc * c.still_factor):
        if s.kept_at == 0 or x.t - s.kept_at >= c.keepalive:
            s.kept_at = x.t
            return Outcome("reject", "stationary_keepalive", keepalive=1)
        return Outcome("reject", "stationary_jitter", jitter=1)
    if gap:
        return Outcome("accept", "gap_recovery", new_segment=True)
    return Outcome("accept", "moving_good_fix", far, took)


def _riding(s: State, x: Fix, c: Strategy) -> Outcome:
    """In a vehicle: confirmed until slow fixes have lasted long and far enough."""
    last = s.transport_fix
    took = (x.t - last.t) / 1e9
    slow = took > 0 and x.acc <= c.ordinary and (x.speed is None or x.speed <= c.recovery_speed) and metres(last, x) / took <= c.recovery_speed
    if not slow:
        s.leaving = None
    else:
        s.leaving = s.leaving or last
        if x.t - s.leaving.t >= c.recovery_stable and metres(s.leaving, x) >= c.recovery_metres:
            s.transport, s.transport_fix, s.leaving = False, None, None
            return Outcome("accept", "transport_recovery", new_segment=True)
    s.transport_fix = x
    return Outcome("reject", "transport_confirmed")


def _evidence(s: State, t: int, c: Strategy) -> list[Motion]:
    return [m for m in s.motions if m.t1 >= t - c.evidence_window and m.t0 <= t]


def _share_still(ms: list[Motion], good: list[Motion], need: int, c: Strategy) -> bool:
    return need >= c.evidence_summaries and sum(m.samples for m in ms) >= c.evidence_samples and len(good) / len(ms) >= c.evidence_ratio


def _reach(radius: float, a: Fix, b: Fix, c: Strategy) -> bool:
    """Whether the accuracies of two fixes explain their distance (single-precision sum)."""
    return metres(a, b) <= max(radius, float(_f(a.acc) + _f(b.acc)) * c.rest_factor)


def _better(x: Fix, p: Fix) -> bool:
    """Whether a fix makes a better anchor than the last point (single precision)."""
    a, b = _f(x.acc), _f(p.acc)
    if a + _f(1.0) < b or a <= b * _f(0.85):
        return True
    if abs(a - b) > _f(1.0) or x.used is None or p.used is None:
        return False
    return x.used >= p.used + 2 or _f(x.top4 or 0.0) >= _f(p.top4 or 0.0) + _f(2.0)


def _refine(s: State, x: Fix, o: Outcome, c: Strategy) -> tuple[Outcome, bool]:
    """Rest anchor refinement: the outcome, and whether the last point is replaced."""
    p = s.point
    if p is None or (x.speed is not None and x.speed > c.rest_speed):
        return o, False
    moving = o.reason == "moving_good_fix"
    if not (moving or o.reason in ("gap_recovery", "stationary_keepalive", "stationary_jitter")):
        return o, False
    if moving:
        near = _evidence(s, x.t, c)
        if not near or not _share_still(near, [m for m in near if m.still], len(near), c) or o.metres > c.rest_radius:
            return o, False
    if not _reach(c.rest_radius, p, x, c):
        return o, False
    if not s.point_moved and _better(x, p):
        return Outcome("anchor", "stationary_anchor_refined"), True
    return Outcome("reject", "stationary_accel_supported_jitter", jitter=1), False


def _calm(s: State) -> None:
    s.rest, s.anchor, s.candidate, s.candidate_n, s.candidate_t, s.probing, s.shaken = "MOVING", None, None, 0, 0, 0, False


def _pause(s: State) -> None:
    s.rest, s.probing = "REST_PAUSED", 0


def _nearer(anchor: Fix, x: Fix) -> Fix:
    return x if x.acc < anchor.acc else anchor


def _rest(s: State, x: Fix, o: Outcome, prior: Fix | None, c: Strategy) -> Outcome:
    """The rest machine over one outcome."""
    if prior is None or o.reason in TRANSPORT:
        _calm(s)
        return o
    at_rest = s.rest in ("REST_PAUSED", "REST_PROBING")
    if o.result not in ("accept", "anchor") and o.reason not in STILL:
        if at_rest:
            s.rest, s.probing = "REST_PROBING", 0
        elif o.result != "weak":
            _calm(s)
        return o
    if o.reason == "stationary_anchor_refined":
        s.anchor, s.shaken = x, False
        _pause(s)
        return o
    if o.reason == "stationary_accel_supported_jitter" and at_rest:
        if s.anchor is not None and _reach(c.rest_radius, s.anchor, x, c):
            s.anchor, s.shaken = _nearer(s.anchor, x), False
            _pause(s)
        return o
    slow = x.speed is not None and x.speed <= c.rest_speed
    held = lambda reason: Outcome("reject", reason, jitter=1)
    if at_rest:
        if s.anchor is None:
            _calm(s)
            return o
        if s.rest == "REST_PAUSED":
            if metres(s.anchor, x) <= c.rest_radius and slow and not s.shaken:
                s.anchor = _nearer(s.anchor, x)
                return held("rest_paused_keepalive")
            s.rest, s.probing = "REST_PROBING", 0
        if slow and _reach(c.rest_radius, s.anchor, x, c):
            s.anchor, s.shaken = _nearer(s.anchor, x), False
            _pause(s)
            return held("rest_probing_stationary")
        strong = lambda m: m.still and m.score >= c.block_score and m.rms <= c.block_rms
        before = [m for m in s.motions if m.t0 <= x.t]
        latest = max(before, key=lambda m: m.t1) if before else None
        near = _evidence(s, x.t, c)
        firm = [m for m in near if strong(m)]
        if (latest is not None and x.t - latest.t1 <= c.latest_still_age and strong(latest)) or (firm and _share_still(near, firm, len(firm), c)):
            s.shaken = False
            _pause(s)
            return held("stationary_motion_blocked_recovery")
        away = metres(s.anchor, x)
        if o.result == "accept" and o.reason in ("moving_good_fix", "gap_recovery", "transport_recovery") and (away >= c.far_metres or (x.speed is not None and x.speed > c.rest_speed and away >= c.moving_metres) or s.shaken):
            s.probing += 1
            if s.probing >= c.moving_points:
                _calm(s)
                return Outcome("accept", "rest_moving_recovery", new_segment=True)
        else:
            s.probing = 0
        return held("rest_probing_confirming_moving")
    evidence = slow and _reach(c.rest_radius, prior, x, c) and _resting(s, x.t)
    if s.rest == "REST_CANDIDATE":
        if not evidence:
            _calm(s)
            return o
        s.candidate = _nearer(s.candidate, x)
        s.candidate_n += 1
        if s.candidate_n >= c.rest_points and x.t - s.candidate_t >= c.rest_nanos:
            s.anchor = s.candidate
            _pause(s)
            return held("rest_paused_keepalive")
        return held("rest_candidate")
    if evidence:
        s.rest, s.candidate, s.candidate_t, s.candidate_n, s.probing = "REST_CANDIDATE", x, x.t, 1, 0
        return held("rest_candidate")
    return o


def _resting(s: State, t: int) -> bool:
    """The newest summary that covers the time, or ended at most five seconds before it, says still."""
    for m in reversed(s.motions):
        if (m.t0 <= t <= m.t1) or (m.t1 <= t and t - m.t1 <= 5 * SECOND):
            return m.still
    return False


def on_motion(s: State, m: Motion, c: Strategy = DEFAULT) -> None:
    s.motions = [*s.motions, m][-c.motion_kept :]
    s.shaken = not m.still
    if s.rest == "REST_PAUSED" and s.shaken:
        s.rest, s.probing = "REST_PROBING", 0


def on_reject(s: State) -> None:
    """A fix that failed validation: it counts as a decision and changes nothing else."""
    s.decisions += 1


def step(s: State, x: Fix, c: Strategy = DEFAULT) -> dict[str, Any]:
    """One valid fix: the decision, and the track point that it adds or replaces (if any)."""
    s.decisions += 1
    prior = s.point
    if s.transport:
        o = _riding(s, x, c)
    else:
        o = _base(s, x, c)
        if o.reason == "transport_suspected":
            s.transport, s.transport_fix, s.leaving = True, x, None
    rode = s.transport
    o, replaced = _refine(s, x, o, c)
    if replaced:
        s.point, s.point_moved = x, False
    o = _rest(s, x, o, prior, c)
    added = not replaced and o.result in ("accept", "anchor")
    if added:
        if o.new_segment and prior is not None:
            s.segment += 1
        s.point_id += 1
        s.point, s.point_moved = x, o.metres != 0 or o.seconds != 0
    has_point = added or replaced
    return {
        "decision_id": s.decisions, "raw_id": x.raw_id, "result": o.result, "reason": o.reason, "state": "TRANSPORT" if rode else s.rest,
        "metres": o.metres, "seconds": o.seconds, "point_id": s.point_id if has_point else None, "segment_id": s.segment if has_point else None,
        "new_segment": added and o.reason in ("gap_recovery", "transport_recovery"), "jitter": o.jitter, "keepalive": o.keepalive,
    }


SCHEMA = "session_id long, line_no long, decision_id long, raw_id long, result string, reason string, state string, metres double, seconds double, point_id long, segment_id long, new_segment boolean, jitter int, keepalive int, t long, lat double, lng double"


def validated(fixes: DataFrame, c: Strategy = DEFAULT) -> DataFrame:
    """fixes with `now` (the running latest arrival) and `invalid`, the first rule broken or null."""
    order = W.partitionBy("session_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    now = F.greatest(F.max("recv").over(order), F.col("start_t"))
    t, lat, lng, acc = (F.col(n) for n in ("t", "lat", "lng", "acc"))
    nan = F.isnan(lat) | F.isnan(lng)  # comparisons with NaN are false in the source rules
    rows = fixes.withColumn("now", now)
    age = F.greatest(F.lit(0).cast("long"), F.col("now") - t)
    rule = (
        F.when(F.col("provider") != "gps", "provider_not_gps")
        .when(~F.col("has_t"), "missing_elapsed_realtime")
        .when(t < F.col("start_t") - SECOND, "before_record_start")
        .when(t > F.col("now") + c.future_tolerance, "location_from_future")
        .when(age > c.max_age, "location_too_old")
        .when(~nan & (((lat == 0) & (lng == 0)) | (F.abs(lat) > 90) | (F.abs(lng) > 180)), "zero_coordinate")
        .when(acc.isNull() | (acc <= 0), "invalid_accuracy")
        .when(acc > c.max_accuracy, "accuracy_too_large")
        .when(F.col("mock"), "mock_location")
    )
    return rows.withColumn("invalid", rule)


def timeline(fixes: DataFrame, motions: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """Validated fixes and motion summaries as one relation in arrival order."""
    rows = validated(fixes)
    if snaps is not None:
        # Only snapshots that arrived before the fix count.
        s = snaps.select(F.col("session_id").alias("s_session"), F.col("snap_id").alias("s_id"), F.col("line_no").alias("s_line"), F.col("used").alias("snap_used"), F.coalesce("top4_cn0", "used_cn0").alias("snap_top4"))
        rows = rows.join(s, (F.col("session_id") == F.col("s_session")) & (F.col("snap_id") == F.col("s_id")) & (F.col("s_line") < F.col("line_no")), "left")
    else:
        rows = rows.withColumns({"snap_used": F.lit(None).cast("long"), "snap_top4": F.lit(None).cast("double")})
    if "forced" not in rows.columns:
        rows = rows.withColumn("forced", F.lit(False))
    a = rows.select("session_id", "line_no", F.lit("fix").alias("kind"), "raw_id", "t", "lat", "lng", "acc", "speed", "invalid", "forced", "snap_used", "snap_top4")
    b = motions.select("session_id", "line_no", F.lit("motion").alias("kind"), "t0", "t1", "samples", "rms", "score", "still")
    return a.unionByName(b, allowMissingColumns=True)


def _some(v: Any) -> bool:
    return v is not None and v == v


_COLUMNS = ("session_id", "line_no", "kind", "raw_id", "t", "lat", "lng", "acc", "speed", "invalid", "forced", "snap_used", "snap_top4", "t0", "t1", "samples", "rms", "score", "still")


def fold(state: State, rows: pd.DataFrame, session: Any = None) -> tuple[list[tuple], State, Any]:
    """Ordered rows through the state: an output row for each fix, and the state and session at the end.

    session: whose state it is (None: the first row's). Where the session changes, the state begins anew.
    """
    out = []
    for sid, line, kind, raw, t, lat, lng, acc, speed, invalid, forced, used, top4, t0, t1, samples, rms, score, still in zip(*(rows[n].tolist() for n in _COLUMNS)):
        if session is None:
            session = sid
        elif sid != session:
            state, session = State(), sid
        if kind == "motion":
            on_motion(state, Motion(int(t0), int(t1), int(samples), rms, score, bool(still)))
            continue
        if _some(invalid):
            on_reject(state)
            shown = "WAITING_FIRST_FIX" if state.point is None else "TRACKING"
            out.append((sid, line, state.decisions, int(raw), "reject", invalid, shown, 0.0, 0.0, None, None, False, 0, 0, int(t), lat, lng))
            continue
        state.forced = bool(forced)
        x = Fix(int(raw), int(t), lat, lng, acc, speed if _some(speed) else None, int(used) if _some(used) else None, top4 if _some(top4) else None)
        d = step(state, x)
        out.append((sid, line, *d.values(), x.t, lat, lng))
    return out, state, session


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fold over one partition, sorted by session and arrival: only one session's state is held."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    state, session = State(), None
    for part in parts:
        made, state, session = fold(state, part, session)
        yield pd.DataFrame(made, columns=columns).astype({"point_id": "Int64", "segment_id": "Int64", "jitter": "int32", "keepalive": "int32"})


def decide(fixes: DataFrame, motions: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """One decision for each fix.

    A session's rows are needed in order, so sessions are dealt whole; inside a partition they
    stream through the fold in batches, whatever their length.
    """
    rows = timeline(fixes, motions, snaps).repartition("session_id").sortWithinPartitions("session_id", "line_no")
    return rows.select(*_COLUMNS).mapInPandas(_batches, SCHEMA)


def track_points(decisions: DataFrame) -> DataFrame:
    """Trusted points: of a point's versions (an anchor may be refined) the latest counts."""
    latest = F.max_by(F.struct("decision_id", "raw_id", "segment_id", "result", "reason", "metres", "seconds", "t", "lat", "lng"), "decision_id").alias("p")
    return decisions.where("point_id IS NOT NULL").groupBy("session_id", "point_id").agg(latest).select("session_id", "point_id", "p.*")


def session_stats(decisions: DataFrame) -> DataFrame:
    n = lambda cond: F.count_if(cond).alias
    return decisions.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_decisions"), F.sum("keepalive").alias("keepalives"), F.sum("jitter").alias("jitters"),
        n(F.col("reason") == "gap_recovery")("gaps"), n(F.col("reason") == "transport_suspected")("rides"),
        F.round(F.sum("metres"), 6).alias("metres"), F.round(F.sum("seconds"), 6).alias("seconds"),
    )
