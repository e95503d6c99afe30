"""The decision pipeline as one recursive query: what the fold's results are held against.

A row of r is a session's state after one row of its timeline, with that row's decision.
"""

from __future__ import annotations


def _metres(a: str, b: str) -> str:
    """Metres between points whose columns are a_lat, a_lng and b_lat, b_lng (x: the fix itself)."""
    la, lo, lb, lp = (f"{a}lat", f"{a}lng", f"{b}lat", f"{b}lng")
    h = f"(power(sin(radians({lb} - {la}) / 2), 2) + cos(radians({la})) * cos(radians({lb})) * power(sin(radians({lp} - {lo}) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h}))))"


_EVIDENCE = "list_filter(ms, lambda m: m.t1 >= t - 5000000000 AND m.t0 <= t)"
_STRONG = "m.still AND m.score >= 0.70 AND m.rms <= 0.10"
#: Column -> value at the start of a session.
START = {
    "p_t": "NULL::BIGINT", "p_lat": "NULL::DOUBLE", "p_lng": "NULL::DOUBLE", "p_acc": "NULL::DOUBLE", "p_used": "NULL::BIGINT", "p_top4": "NULL::DOUBLE", "p_moved": "false", "pid": "0::BIGINT", "seg": "1::BIGINT", "n": "0::BIGINT", "kept": "0::BIGINT",
    "ride": "false", "f_t": "NULL::BIGINT", "f_lat": "NULL::DOUBLE", "f_lng": "NULL::DOUBLE", "l_t": "NULL::BIGINT", "l_lat": "NULL::DOUBLE", "l_lng": "NULL::DOUBLE", "rest": "'MOVING'", "a_lat": "NULL::DOUBLE", "a_lng": "NULL::DOUBLE", "a_acc": "NULL::DOUBLE",
    "c_lat": "NULL::DOUBLE", "c_lng": "NULL::DOUBLE", "c_acc": "NULL::DOUBLE", "c_t": "0::BIGINT", "c_n": "0::BIGINT", "probe": "0::BIGINT", "shaken": "false", "ms": "[]::STRUCT(t0 BIGINT, t1 BIGINT, samples BIGINT, rms DOUBLE, score DOUBLE, still BOOLEAN)[]",
}
OUT = ("kind", "line_no", "raw_id", "t", "lat", "lng", "result", "reason", "state", "metres", "seconds", "point_id", "segment_id", "new_segment", "jitter", "keepalive")

#: What one fix is, against the last trusted point or in a vehicle.
_BASE = f"""SELECT *, CASE WHEN kind <> 'fix' THEN NULL WHEN invalid IS NOT NULL THEN 'reject:' || invalid
  WHEN ride THEN CASE WHEN slow_ride AND t - coalesce(l_t, f_t) >= 15000000000 AND CASE WHEN l_t IS NULL THEN {_metres('f_', '')} ELSE {_metres('l_', '')} END >= 12 THEN 'accept:transport_recovery' ELSE 'reject:transport_confirmed' END
  WHEN p_t IS NULL THEN CASE WHEN acc <= 20 THEN 'anchor:first_fix_good' WHEN acc <= 30 THEN 'anchor:first_fix_relaxed' WHEN acc <= 80 THEN 'weak:weak_first_fix' ELSE 'reject:first_fix_accuracy_too_large' END
  WHEN acc > 30 THEN 'weak:weak_signal_stage1' WHEN took <= 0 THEN 'reject:non_positive_delta_time' WHEN far / took > 12 AND NOT reported THEN 'reject:impossible_speed' WHEN (reported OR sustained) AND took <= 120 THEN 'reject:transport_suspected'
  WHEN far < greatest(5, acc * 1.5) THEN CASE WHEN kept = 0 OR t - kept >= 30000000000 THEN 'reject:stationary_keepalive' ELSE 'reject:stationary_jitter' END WHEN took > 120 THEN 'accept:gap_recovery' ELSE 'accept:moving_good_fix' END AS o1
 FROM (SELECT *, far / took AS pace, coalesce(speed >= 3.5 AND speed <= 45 AND far / took >= 3.5 AND far / took <= 45 AND far >= 20, false) AS reported, coalesce(far / took >= 3.5 AND far / took <= 12 AND far >= 60 AND took >= 10, false) AS sustained,
   ride AND t > f_t AND acc <= 30 AND (speed IS NULL OR speed <= 2.5) AND {_metres('f_', '')} / ((t - f_t) / 1e9) <= 2.5 AS slow_ride
  FROM (SELECT *, {_metres('p_', '')} AS far, (t - p_t) / 1e9 AS took FROM joined))"""

_REFINED = f"""SELECT *, CASE WHEN o1 IS NULL OR invalid IS NOT NULL OR p_t IS NULL OR coalesce(speed > 0.5, false) OR split_part(o1, ':', 2) NOT IN ('moving_good_fix', 'gap_recovery', 'stationary_keepalive', 'stationary_jitter')
   OR (o1 = 'accept:moving_good_fix' AND (NOT (len(ev) >= 2 AND coalesce(list_sum(list_transform(ev, lambda m: m.samples)), 0) >= 12 AND len(list_filter(ev, lambda m: m.still)) / len(ev) >= 0.75) OR far > 15)) OR far > greatest(15, (acc + p_acc) * 1.5) THEN o1
  WHEN NOT p_moved AND (acc + 1 < p_acc OR acc <= p_acc * 0.85 OR (abs(acc - p_acc) <= 1 AND snap_used IS NOT NULL AND p_used IS NOT NULL AND (snap_used >= p_used + 2 OR coalesce(snap_top4, 0) >= coalesce(p_top4, 0) + 2))) THEN 'anchor:stationary_anchor_refined'
  ELSE 'reject:stationary_accel_supported_jitter' END AS o2 FROM (SELECT *, {_EVIDENCE} AS ev FROM (SELECT *, CASE WHEN o1 = 'reject:stationary_keepalive' THEN t ELSE kept END AS kept2 FROM ({_BASE})))"""

_FACTS = f"""SELECT *, split_part(o2, ':', 1) AS r2, split_part(o2, ':', 2) AS w2, rest IN ('REST_PAUSED', 'REST_PROBING') AS at_rest, coalesce(speed <= 0.5, false) AS slow, a_lat IS NOT NULL AS has_a, {_metres('a_', '')} AS away, coalesce(a_acc + acc, 0) * 1.5 AS a_reach,
  coalesce(CASE WHEN len(cover) > 0 THEN cover[len(cover)].still END, false) AS still_now, len(firm) AS n_firm,
  coalesce((SELECT true FROM (SELECT 1) WHERE latest.t1 IS NOT NULL AND t - latest.t1 <= 2000000000 AND latest.still AND latest.score >= 0.70 AND latest.rms <= 0.10), false) OR (len(firm) >= 2 AND list_sum(list_transform(ev, lambda m: m.samples)) >= 12 AND len(firm) / len(ev) >= 0.75) AS blocked
 FROM (SELECT *, list_filter(ms, lambda m: (m.t0 <= t AND t <= m.t1) OR (m.t1 <= t AND t - m.t1 <= 5000000000)) AS cover, list_filter(ev, lambda m: {_STRONG}) AS firm,
   list_reverse_sort(list_transform(list_filter(ms, lambda m: m.t0 <= t), lambda m: {{'t1': m.t1, 'still': m.still, 'score': m.score, 'rms': m.rms}}))[1] AS latest FROM ({_REFINED}))"""

#: Which branch of the rest machine a fix takes.
_BRANCH = f"""SELECT *, CASE WHEN kind <> 'fix' OR invalid IS NOT NULL THEN 'none' WHEN p_t IS NULL OR w2 LIKE 'transport%' THEN 'calm' WHEN r2 NOT IN ('accept', 'anchor') AND w2 NOT IN ('stationary_keepalive', 'stationary_jitter', 'stationary_anchor_refined', 'stationary_accel_supported_jitter') THEN CASE WHEN at_rest THEN 'probe' WHEN r2 <> 'weak' THEN 'calm' ELSE 'none' END
  WHEN w2 = 'stationary_anchor_refined' THEN 'anchor' WHEN w2 = 'stationary_accel_supported_jitter' AND at_rest THEN CASE WHEN has_a AND away <= greatest(15, a_reach) THEN 'pause' ELSE 'none' END
  WHEN at_rest AND NOT has_a THEN 'calm' WHEN rest = 'REST_PAUSED' AND away <= 15 AND slow AND NOT shaken THEN 'keep' WHEN at_rest AND slow AND away <= greatest(15, a_reach) THEN 'still' WHEN at_rest AND blocked THEN 'blocked'
  WHEN at_rest THEN CASE WHEN r2 = 'accept' AND w2 IN ('moving_good_fix', 'gap_recovery', 'transport_recovery') AND (away >= 20 OR (coalesce(speed > 0.5, false) AND away >= 8) OR shaken) THEN CASE WHEN CASE WHEN rest = 'REST_PAUSED' THEN 0 ELSE probe END + 1 >= 2 THEN 'recover' ELSE 'confirm' END ELSE 'unsure' END
  WHEN rest = 'REST_CANDIDATE' THEN CASE WHEN NOT evidence THEN 'calm' WHEN c_n + 1 >= 2 AND t - c_t >= 20000000000 THEN 'settle' ELSE 'wait' END WHEN evidence THEN 'begin' ELSE 'none' END AS b
 FROM (SELECT *, slow AND {_metres('p_', '')} <= greatest(15, (acc + p_acc) * 1.5) AND still_now AS evidence FROM ({_FACTS}))"""

_DONE = f"""SELECT *, CASE WHEN b IN ('keep', 'settle') THEN 'reject:rest_paused_keepalive' WHEN b = 'still' THEN 'reject:rest_probing_stationary' WHEN b = 'blocked' THEN 'reject:stationary_motion_blocked_recovery' WHEN b = 'recover' THEN 'accept:rest_moving_recovery'
  WHEN b IN ('confirm', 'unsure') THEN 'reject:rest_probing_confirming_moving' WHEN b IN ('wait', 'begin') THEN 'reject:rest_candidate' ELSE o2 END AS o3, kind = 'fix' AND invalid IS NULL AS fine FROM ({_BRANCH})"""

_ENDS = f"""SELECT *, split_part(o3, ':', 1) AS r3, split_part(o3, ':', 2) AS w3, fine AND o2 = 'anchor:stationary_anchor_refined' AS swapped, fine AND o2 <> 'anchor:stationary_anchor_refined' AND split_part(o3, ':', 1) IN ('accept', 'anchor') AS added,
  fine AND split_part(o3, ':', 2) IN ('gap_recovery', 'transport_recovery', 'rest_moving_recovery') AS opens FROM ({_DONE})"""

_CLEAR = "b IN ('calm', 'recover')"
NEXT = {
    "p_t": "CASE WHEN swapped OR added THEN t ELSE p_t END", "p_lat": "CASE WHEN swapped OR added THEN lat ELSE p_lat END", "p_lng": "CASE WHEN swapped OR added THEN lng ELSE p_lng END", "p_acc": "CASE WHEN swapped OR added THEN acc ELSE p_acc END",
    "p_used": "CASE WHEN swapped OR added THEN snap_used ELSE p_used END", "p_top4": "CASE WHEN swapped OR added THEN snap_top4 ELSE p_top4 END", "p_moved": "CASE WHEN swapped THEN false WHEN added THEN w3 = 'moving_good_fix' ELSE p_moved END",
    "pid": "pid + CASE WHEN added THEN 1 ELSE 0 END", "seg": "seg + CASE WHEN added AND opens AND p_t IS NOT NULL THEN 1 ELSE 0 END", "n": "n + CASE WHEN kind = 'fix' THEN 1 ELSE 0 END", "kept": "CASE WHEN fine THEN kept2 ELSE kept END",
    "ride": "CASE WHEN NOT fine THEN ride WHEN o1 = 'accept:transport_recovery' THEN false ELSE ride OR o1 = 'reject:transport_suspected' END",
    **{f"f_{c}": f"CASE WHEN NOT fine THEN f_{c} WHEN o1 IN ('reject:transport_suspected', 'reject:transport_confirmed') THEN {c} WHEN o1 = 'accept:transport_recovery' THEN NULL ELSE f_{c} END" for c in ("t", "lat", "lng")},
    **{f"l_{c}": f"CASE WHEN NOT fine OR NOT ride THEN CASE WHEN fine AND o1 = 'reject:transport_suspected' THEN NULL ELSE l_{c} END WHEN NOT slow_ride OR o1 = 'accept:transport_recovery' THEN NULL WHEN l_t IS NULL THEN f_{c} ELSE l_{c} END" for c in ("t", "lat", "lng")},
    "rest": f"CASE WHEN kind = 'motion' THEN CASE WHEN rest = 'REST_PAUSED' AND NOT still THEN 'REST_PROBING' ELSE rest END WHEN {_CLEAR} THEN 'MOVING' WHEN b IN ('anchor', 'pause', 'keep', 'still', 'blocked', 'settle') THEN 'REST_PAUSED' WHEN b IN ('probe', 'confirm', 'unsure') THEN 'REST_PROBING' WHEN b IN ('begin', 'wait') THEN 'REST_CANDIDATE' ELSE rest END",
    **{f"a_{c}": f"CASE WHEN {_CLEAR} THEN NULL WHEN b = 'anchor' OR (b IN ('pause', 'keep', 'still') AND acc < a_acc) THEN {c} WHEN b = 'settle' THEN CASE WHEN acc < c_acc THEN {c} ELSE c_{c} END ELSE a_{c} END" for c in ("lat", "lng", "acc")},
    **{f"c_{c}": f"CASE WHEN {_CLEAR} THEN NULL WHEN b = 'begin' OR (b IN ('wait', 'settle') AND acc < c_acc) THEN {c} ELSE c_{c} END" for c in ("lat", "lng", "acc")},
    "c_t": f"CASE WHEN {_CLEAR} THEN 0 WHEN b = 'begin' THEN t ELSE c_t END", "c_n": f"CASE WHEN {_CLEAR} THEN 0 WHEN b = 'begin' THEN 1 WHEN b IN ('wait', 'settle') THEN c_n + 1 ELSE c_n END",
    "probe": f"CASE WHEN kind = 'motion' THEN CASE WHEN rest = 'REST_PAUSED' AND NOT still THEN 0 ELSE probe END WHEN b = 'confirm' THEN CASE WHEN rest = 'REST_PAUSED' THEN 1 ELSE probe + 1 END WHEN b IN ('none', 'wait') THEN probe ELSE 0 END",
    "shaken": f"CASE WHEN kind = 'motion' THEN NOT still WHEN {_CLEAR} OR b IN ('anchor', 'pause', 'still', 'blocked') THEN false ELSE shaken END",
    "ms": "CASE WHEN kind = 'motion' THEN list_append(ms, {'t0': t0, 't1': t1, 'samples': samples, 'rms': rms, 'score': score, 'still': still})[-8:] ELSE ms END",
}
SHOWN = {
    "kind": "kind", "line_no": "line_no", "raw_id": "raw_id", "t": "t", "lat": "lat", "lng": "lng", "result": "r3", "reason": "w3",
    "state": f"CASE WHEN NOT fine THEN CASE WHEN p_t IS NULL THEN 'WAITING_FIRST_FIX' ELSE 'TRACKING' END WHEN {NEXT['ride']} THEN 'TRANSPORT' ELSE {NEXT['rest']} END", "metres": "CASE WHEN fine AND w3 = 'moving_good_fix' THEN far ELSE 0 END", "seconds": "CASE WHEN fine AND w3 = 'moving_good_fix' THEN took ELSE 0 END",
    "point_id": f"CASE WHEN swapped OR added THEN {NEXT['pid']} END", "segment_id": f"CASE WHEN swapped OR added THEN {NEXT['seg']} END", "new_segment": "coalesce(added AND w3 IN ('gap_recovery', 'transport_recovery'), false)",
    "jitter": "CASE WHEN fine AND (o3 <> o2 AND b <> 'recover' OR w3 IN ('stationary_jitter', 'stationary_accel_supported_jitter')) THEN 1 ELSE 0 END", "keepalive": "CASE WHEN fine AND w3 = 'stationary_keepalive' THEN 1 ELSE 0 END",
}

#: A WITH tail, behind validation's `checked`: d has one row a fix.
DECISIONS = f""", tl AS (
  SELECT c.session_id, c.line_no, 'fix' AS kind, c.raw_id, c.t, c.lat, c.lng, c.acc, c.speed, c.reason AS invalid, s.used AS snap_used, CASE WHEN s.snap_id IS NOT NULL THEN coalesce(s.top4_cn0, s.used_cn0) END AS snap_top4, NULL::BIGINT AS t0, NULL::BIGINT AS t1, NULL::BIGINT AS samples, NULL::DOUBLE AS rms, NULL::DOUBLE AS score, NULL::BOOLEAN AS still
   FROM checked c LEFT JOIN snap s ON s.session_id = c.session_id AND s.snap_id = c.snap_id AND s.line_no < c.line_no
  UNION ALL SELECT session_id, line_no, 'motion', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, t0, t1, samples, rms, score, still FROM motion),
timed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rn FROM tl),
r AS (SELECT session_id, 0::BIGINT AS rn, {', '.join(f'{v} AS {k}' for k, v in START.items())}, ''::VARCHAR AS o_kind, 0::BIGINT AS o_line_no, 0::BIGINT AS o_raw_id, 0::BIGINT AS o_t, 0::DOUBLE AS o_lat, 0::DOUBLE AS o_lng, ''::VARCHAR AS o_result, ''::VARCHAR AS o_reason, ''::VARCHAR AS o_state, 0::DOUBLE AS o_metres, 0::DOUBLE AS o_seconds,
   NULL::BIGINT AS o_point_id, NULL::BIGINT AS o_segment_id, false AS o_new_segment, 0::INTEGER AS o_jitter, 0::INTEGER AS o_keepalive FROM (SELECT DISTINCT session_id FROM timed)
 UNION ALL SELECT session_id, rn, {', '.join(NEXT[k] for k in START)}, {', '.join(SHOWN[k] for k in OUT)}
 FROM ({_ENDS.replace('joined', "(SELECT x.*, " + ', '.join('r.' + k for k in START) + " FROM r JOIN timed x ON x.session_id = r.session_id AND x.rn = r.rn + 1)")})),
d AS (SELECT session_id, n AS decision_id, {', '.join(f'o_{k} AS {k}' for k in OUT if k != 'kind')} FROM r WHERE o_kind = 'fix')"""
