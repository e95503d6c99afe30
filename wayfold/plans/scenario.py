"""Position-shaped relations over the driver's `events`, by whole-number arithmetic only.

One text serves both engines: the relations are inputs, and what is computed from them is
written apart for each. A user is a session; its events, by (ts, event_id), are its fixes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The relations, in order; each may use those before it.
VIEWS = {
    "base": """
SELECT user_id AS session_id, event_id AS e, event_type, value,
  CAST(row_number() OVER w AS BIGINT) AS seq,
  CAST(sum((event_id * 37) % 23 - 11) OVER w AS BIGINT) AS north,
  CAST(sum((event_id * 53) % 19 - 9) OVER w AS BIGINT) AS east,
  CAST(sum((event_id * 29) % 11 - 4) OVER w AS BIGINT) AS up,
  CAST(sum(CASE WHEN event_id % 29 = 0 THEN 150 ELSE 1 + event_id % 9 END) OVER w AS BIGINT) AS clock
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "fix": """
SELECT session_id, seq, seq * 4 + 3 AS line_no, e AS raw_id,
  CASE WHEN e % 97 = 0 THEN 'network' ELSE 'gps' END AS provider,
  e % 101 <> 0 AS has_t,
  (2 + clock - CASE WHEN e % 53 = 0 THEN 20 ELSE 0 END) * 1000000000 AS t,
  (2 + clock + CASE WHEN e % 41 = 0 THEN 31 ELSE 0 END) * 1000000000 + 1000000 AS recv,
  CAST(1 AS BIGINT) * 1000000000 AS start_t,
  1704067200000 + clock * 1000 AS wall,
  CASE WHEN e % 83 = 0 THEN CAST(0 AS DOUBLE) ELSE 29.0 + north * CASE WHEN session_id % 5 = 0 THEN 6 ELSE 1 END / CAST(100000 AS DOUBLE) END AS lat,
  CASE WHEN e % 83 = 0 THEN CAST(0 AS DOUBLE) ELSE 106.0 + east * CASE WHEN session_id % 5 = 0 THEN 6 ELSE 1 END / CAST(100000 AS DOUBLE) END AS lng,
  CASE WHEN e % 71 = 0 THEN CAST(NULL AS DOUBLE) WHEN e % 17 = 0 THEN CAST(31 + e % 60 AS DOUBLE) WHEN e % 13 = 0 THEN CAST(25 AS DOUBLE) ELSE CAST(3 + e % 9 AS DOUBLE) END AS acc,
  CASE WHEN e % 4 = 0 THEN CAST(NULL AS DOUBLE) WHEN session_id % 5 = 0 THEN CAST(e % 24 AS DOUBLE) ELSE (e % 7) * CAST(0.25 AS DOUBLE) END AS speed,
  CASE WHEN e % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST((e * 7) % 360 AS DOUBLE) END AS bearing,
  CASE WHEN e % 19 = 0 THEN CAST(NULL AS DOUBLE) ELSE 500 + up * CAST(0.5 AS DOUBLE) END AS alt,
  CASE WHEN e % 23 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(2 + e % 13 AS DOUBLE) END AS vacc,
  e % 89 = 0 AS mock,
  CASE WHEN e % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE e - e % 2 END AS snap_id,
  e % 6 = 1 AS stale
FROM base""",
    "snap": """
SELECT session_id, seq * 4 AS line_no, e AS snap_id, (2 + clock + CASE WHEN e % 10 = 4 THEN 2 ELSE -(e % 5) END) * 1000000000 AS t,
  CAST(6 + e % 20 AS BIGINT) AS visible, CAST(2 + e % 12 AS BIGINT) AS used, CAST(14 + e % 22 AS DOUBLE) AS used_cn0,
  CASE WHEN e % 14 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(12 + e % 18 AS DOUBLE) END AS all_cn0,
  CASE WHEN e % 14 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(18 + e % 25 AS DOUBLE) END AS top4_cn0
FROM base WHERE e % 2 = 0""",
    "motion": """
SELECT session_id, seq * 4 + 2 AS line_no, e AS motion_id, (2 + clock) * 1000000000 - 1700000000 AS t0, (2 + clock) * 1000000000 - 200000000 AS t1,
  CAST(5 + e % 9 AS BIGINT) AS samples, CAST((e % 40) AS DOUBLE) / 100 AS rms, CAST(100 - (e % 40) AS DOUBLE) / 100 AS score, e % 8 <> 0 AS still
FROM base WHERE e % 3 <> 1""",
    "pressure": """
SELECT session_id, seq * 4 + 1 AS line_no, e AS sample_id, (2 + clock - CASE WHEN e % 5 = 0 THEN 4 ELSE 1 END) * 1000000000 AS t,
  CASE WHEN e % 31 = 0 THEN CAST(-1 AS DOUBLE) ELSE 960 - up * CAST(0.125 AS DOUBLE) END AS hpa, CAST(e % 4 AS BIGINT) AS sensor, 430 + up * CAST(0.75 AS DOUBLE) AS alt
FROM base WHERE e % 2 = 1""",
    "decision": """
SELECT session_id, seq * 4 + 4 AS line_no, e AS decision_id, CASE WHEN e % 43 = 0 THEN e + 100000000 ELSE e END AS raw_id,
  CASE WHEN seq = 1 THEN 'anchor' WHEN e % 11 IN (1, 2) THEN 'weak' WHEN e % 11 IN (3, 4, 5) OR (e % 11 = 6 AND e % 2 = 0) THEN 'reject' ELSE 'accept' END AS result,
  CASE WHEN seq = 1 THEN 'first_fix_good' WHEN e % 11 IN (1, 2) THEN 'weak_signal_stage1' WHEN e % 11 = 3 THEN 'stationary_jitter' WHEN e % 11 = 4 THEN 'transport_suspected'
       WHEN e % 11 = 5 THEN 'impossible_speed' WHEN e % 11 = 6 AND e % 2 = 0 THEN 'transport_confirmed' WHEN e % 11 = 6 THEN 'transport_recovery' WHEN e % 11 = 7 THEN 'gap_recovery' ELSE 'moving_good_fix' END AS reason,
  (2 + clock) * 1000000000 AS t,
  CASE WHEN e % 5 = 0 THEN e - e % 2 END AS snap_id,
  CASE WHEN seq = 1 OR NOT (e % 11 IN (1, 2, 3, 4, 5) OR (e % 11 = 6 AND e % 2 = 0)) THEN e END AS point_id,
  CASE WHEN seq > 1 AND e % 11 IN (0, 8, 9, 10) THEN CAST(4 + e % 7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS metres,
  CASE WHEN seq > 1 AND e % 11 IN (0, 8, 9, 10) THEN CAST(2 + e % 5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS moving
FROM base""",
    "status": """
SELECT session_id, seq * 4 + 5 AS line_no, e AS event_id, (2 + clock) * 1000000000 AS t,
  CASE WHEN seq = 1 THEN 'start_recording' WHEN e % 37 = 0 THEN 'no_location_timeout' WHEN e % 59 = 0 THEN 'finish_recording' ELSE 'provider_disabled' END AS kind,
  CASE WHEN e % 37 = 0 THEN 30000 + e % 9000 END AS waited
FROM base WHERE seq = 1 OR e % 37 = 0 OR e % 59 = 0 OR e % 67 = 0""",
    "policy": """
SELECT session_id, seq * 4 + 6 AS line_no, e AS policy_id, (2 + clock) * 1000000000 AS t,
  CASE WHEN e % 5 = 0 THEN 'MOVING' WHEN e % 5 = 1 THEN 'SIGNAL_WEAK' WHEN e % 5 = 2 THEN 'REST_PAUSED' WHEN e % 5 = 3 THEN 'REST_PROBING' ELSE 'STARTING' END AS state,
  CASE WHEN e % 5 = 0 THEN 3000 WHEN e % 5 = 1 THEN 2000 WHEN e % 5 = 2 THEN 10000 ELSE 1000 END AS min_time, CAST(CASE WHEN e % 613 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS min_distance
FROM base WHERE e % 7 = 0""",
    "manifest": """
SELECT session_id, CASE WHEN session_id % 13 = 0 THEN 'MISSING' WHEN session_id % 17 = 0 THEN 'INVALID' ELSE 'OK' END AS read_status,
  CASE WHEN session_id % 7 = 0 THEN 'INTERRUPTED' WHEN session_id % 11 = 0 THEN 'ACTIVE' WHEN session_id % 19 = 0 THEN 'ERROR' WHEN session_id % 23 = 0 THEN 'PENDING' ELSE 'FINISHED' END AS completion,
  CASE WHEN session_id % 29 = 0 THEN 'ERROR' ELSE 'OK' END AS integrity, session_id % 31 <> 0 AS log_exists, session_id % 3 <> 0 AS gpx_exists, session_id % 37 = 0 AS partial_exists,
  1704067200000 + session_id * 61000 AS created, count(*) AS raws, count(*) FILTER (WHERE e % 11 IN (1, 2)) AS weaks, count(*) FILTER (WHERE e % 11 > 6) AS points,
  CAST(count(*) FILTER (WHERE e % 11 > 6) * 5 AS DOUBLE) AS metres, max(seq * 4 + 6) AS last_seq, max(seq * 4 + 6) - CASE WHEN session_id % 8 = 0 THEN 1 ELSE 0 END AS log_seq,
  CASE WHEN session_id % 6 = 0 THEN CAST(NULL AS STRING) ELSE concat('Brand', CAST(session_id % 2 AS STRING)) END AS brand, concat('Model', CAST(session_id % 4 AS STRING)) AS model,
  CASE WHEN session_id % 10 = 0 THEN 'GNSS' WHEN session_id % 15 = 0 THEN 'NONE' ELSE 'BAROMETER' END AS ascent_source,
  CASE WHEN session_id % 21 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST((session_id % 9) * 60 + (session_id * 7) % 25 AS DOUBLE) END AS ascent
FROM base GROUP BY session_id""",
    # Decisions of a resting session: eight jitter reasons and keepalives, now and then something else.
    "resting": """
SELECT session_id, seq * 4 + 4 AS line_no, e AS decision_id, CASE WHEN e % 29 = 0 THEN 'moving_good_fix' WHEN e % 41 = 0 THEN 'weak_signal_stage1' WHEN e % 9 = 0 THEN 'stationary_keepalive' WHEN e % 9 = 1 THEN 'stationary_jitter' WHEN e % 9 = 2 THEN 'stationary_anchor_refined'
  WHEN e % 9 = 3 THEN 'stationary_accel_supported_jitter' WHEN e % 9 = 4 THEN 'rest_candidate' WHEN e % 9 = 5 THEN 'rest_paused_keepalive' WHEN e % 9 = 6 THEN 'rest_probing_stationary' WHEN e % 9 = 7 THEN 'stationary_motion_blocked_recovery' ELSE 'rest_probing_confirming_moving' END AS reason
FROM base""",
    # Logs by session: also empty ones, and ones with a fix or a decision only.
    "log_session": """
SELECT session_id, CASE WHEN session_id % 33 = 0 THEN 2 ELSE 0 END AS bad_lines FROM base WHERE seq = 1
UNION ALL SELECT session_id + 1000000, 0 FROM base WHERE seq = 1 UNION ALL SELECT session_id + 2000000, 0 FROM base WHERE seq = 1 UNION ALL SELECT session_id + 3000000, 1 FROM base WHERE seq = 1""",
    "log_fix": """
SELECT session_id, line_no, raw_id, t, recv, acc, snap_id, stale FROM fix UNION ALL SELECT session_id + 3000000, line_no, raw_id, t, recv, acc, snap_id, stale FROM fix WHERE seq = 1""",
    "log_decision": """
SELECT session_id, line_no, decision_id, raw_id, result, reason, t, snap_id, point_id, metres, moving FROM decision
UNION ALL SELECT session_id + 2000000, line_no, decision_id, raw_id, result, reason, t, snap_id, point_id, metres, moving FROM decision WHERE line_no = 8""",
    "sample": """
SELECT m.session_id, read_status, completion, integrity, log_exists, raws, weaks, points, last_seq, log_seq, g.gaps + CASE WHEN m.session_id % 25 = 0 THEN 1 ELSE 0 END AS gaps,
  CASE WHEN m.session_id % 27 = 0 THEN 'INVALID_JSONL' WHEN m.session_id % 45 = 0 THEN 'READ_ERROR' ELSE 'OK' END AS log_status, m.session_id % 27 = 0 AS parse_failed
FROM manifest m JOIN (SELECT session_id, count(*) FILTER (WHERE seq > 1 AND e % 11 = 7) AS gaps FROM base GROUP BY session_id) g ON m.session_id = g.session_id
UNION ALL SELECT session_id + 1000000, 'OK', 'FINISHED', 'OK', true, 0, 0, 0, 0, 0, 0, 'OK', false FROM base WHERE seq = 1 UNION ALL SELECT session_id + 2000000, 'OK', 'FINISHED', 'OK', true, 0, 0, 1, 0, 0, 0, 'OK', false FROM base WHERE seq = 1
UNION ALL SELECT session_id + 3000000, 'OK', 'FINISHED', 'OK', true, 1, 0, 0, 0, 0, 0, 'OK', false FROM base WHERE seq = 1""",
    "sat": """
SELECT session_id, e AS snap_id, k AS ord, (e * 7 + k * 3) % 9 AS kind, (e + k * 5) % 32 + 1 AS svid, (e + k) % 3 <> 0 AS used, CAST(10 + (e * 3 + k * 7) % 35 AS DOUBLE) AS cn0,
  CASE WHEN (e + k) % 4 = 0 THEN CAST(NULL AS DOUBLE) WHEN (e * k) % 10 = 3 THEN CAST(1176450000 AS DOUBLE) ELSE CAST(1575420000 AS DOUBLE) END AS carrier
FROM base CROSS JOIN (SELECT explode(array(0, 1, 2, 3, 4, 5, 6, 7)) AS k) s WHERE e % 2 = 0 AND k < e % 9""",
}


_EIGHT = "explode(array(0, 1, 2, 3, 4, 5, 6, 7))"


def _needed(names: set[str]) -> list[str]:
    """The named relations and those that they are made from, in order."""
    wanted = {"base", *names}
    for name in reversed(VIEWS):
        if name in wanted:
            wanted |= {n for n in re.findall(r"(?:FROM|JOIN) (\w+)", VIEWS[name]) if n in VIEWS}
    return [n for n in VIEWS if n in wanted]


def sql_with(*names: str) -> str:
    """A WITH clause (for DuckDB) of the named relations and what they need."""
    text = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed(set(names)))
    return "WITH RECURSIVE " + text.replace(_EIGHT, "unnest([0, 1, 2, 3, 4, 5, 6, 7])").replace("AS STRING)", "AS VARCHAR)")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the relations as a DataFrame.

    The events are dealt by user before anything is computed from them, so that all relations of a
    query can share that one scan and exchange.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type", "value").repartition("user_id")
    text = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed({name}))
    text = text.replace(f"CROSS JOIN (SELECT {_EIGHT} AS k) s", f"LATERAL VIEW {_EIGHT} s AS k")
    return spark.sql(f"WITH {text.replace('FROM events', 'FROM {events}')} SELECT * FROM {name}", events=events)
