"""Queries of reports, summaries, satellites and device consistency."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import joins as J
from ..operators import reports as R
from ..sources import jsonl
from . import decide as D
from .joins import FOLD, GAPS, LINKED
from .registry import query



def linked(x):
    rows = J.decision_snapshots(x.decision, x.fix, x.snap)
    return rows.select("session_id", "decision_id", "result", "reason", "raw_acc", F.col("snap_id_r").alias("linked_id"), F.col("used_r").alias("used"), F.col("used_cn0_r").alias("used_cn0"), F.col("top4_cn0_r").alias("top4_cn0"))


def _group(name, cond):
    return f"""count(*) FILTER (WHERE {cond}) AS {name}_n, count(linked_id) FILTER (WHERE {cond}) AS {name}_linked, coalesce(avg(raw_acc) FILTER (WHERE {cond} AND raw_acc > 0), 0) AS {name}_acc,
  coalesce(avg(used) FILTER (WHERE {cond}), 0) AS {name}_used, coalesce(avg(used_cn0) FILTER (WHERE {cond}), 0) AS {name}_cn0, coalesce(avg(top4_cn0) FILTER (WHERE {cond}), 0) AS {name}_top4"""


RIDE = "((result = 'reject' AND reason LIKE 'transport\\_%' ESCAPE '\\') OR (result <> 'reject' AND reason = 'transport_recovery'))"
WEAK_SQL = LINKED + GAPS + f""", d AS (SELECT session_id, {_group('weak', "result = 'weak'")}, {_group('reject', "result = 'reject'")}, {_group('ride', RIDE)}, count(*) FILTER (WHERE reason = 'gap_recovery') AS gap_n FROM linked GROUP BY 1),
r AS (SELECT session_id, count(*) AS raw_n, count(*) FILTER (WHERE stale) AS stale_n FROM fix GROUP BY 1),
g AS (SELECT session_id, count(before_top4) AS before_n, count(after_top4) AS after_n, coalesce(avg(before_top4), 0) AS before_top4, coalesce(avg(after_top4), 0) AS after_top4 FROM gaps GROUP BY 1),
s AS (SELECT session_id, count(*) AS timeout_n, max(waited) / 1000.0 AS timeout_max FROM status WHERE kind = 'no_location_timeout' GROUP BY 1),
j AS (SELECT r.*, d.* EXCLUDE (session_id), coalesce(before_n, 0) AS before_n, coalesce(after_n, 0) AS after_n, coalesce(before_top4, 0) AS before_top4, coalesce(after_top4, 0) AS after_top4, coalesce(timeout_n, 0) AS timeout_n, coalesce(timeout_max, 0) AS timeout_max
  FROM r JOIN d USING (session_id) LEFT JOIN g USING (session_id) LEFT JOIN s USING (session_id)),
f AS (SELECT *, concat_ws(',', CASE WHEN weak_n > 0 AND weak_cn0 > 0 AND weak_cn0 < 25 THEN 'WEAK_LOW_CN0' END, CASE WHEN weak_n > 0 AND weak_used > 0 AND weak_used < 5 THEN 'WEAK_FEW_SATS' END, CASE WHEN stale_n / raw_n > 0.2 THEN 'STALE_RATIO' END,
  CASE WHEN weak_n > weak_linked THEN 'WEAK_UNLINKED' END, CASE WHEN reject_n > reject_linked THEN 'REJECT_UNLINKED' END, CASE WHEN ride_n > ride_linked THEN 'TRANSPORT_UNLINKED' END, CASE WHEN gap_n > 0 OR timeout_n > 0 THEN 'GAP_OR_NO_FIX' END,
  CASE WHEN ride_n > 0 AND ride_cn0 >= 25 THEN 'TRANSPORT_GOOD_SIGNAL' END) AS found FROM j)
SELECT session_id, raw_n, stale_n, weak_n, weak_linked, reject_n, reject_linked, ride_n, ride_linked, gap_n, before_n, after_n, timeout_n, round(timeout_max, 6) AS timeout_max, round(weak_acc, 6) AS weak_acc, round(weak_used, 6) AS weak_used, round(weak_cn0, 6) AS weak_cn0,
  round(weak_top4, 6) AS weak_top4, round(reject_cn0, 6) AS reject_cn0, round(ride_top4, 6) AS ride_top4, round(before_top4, 6) AS before_top4, round(after_top4, 6) AS after_top4, CASE WHEN found = '' AND weak_n + reject_n + gap_n + timeout_n = 0 THEN 'NONE' ELSE found END AS findings FROM f"""


@query("weak_report", WEAK_SQL, "fix snap decision status")
def weak_report(x):
    out = R.weak_signal(linked(x), x.fix, J.gap_windows(x.decision, x.snap), x.status)
    whole = ["raw_n", "stale_n", "weak_n", "weak_linked", "reject_n", "reject_linked", "ride_n", "ride_linked", "gap_n", "before_n", "after_n", "timeout_n"]
    part = ["timeout_max", "weak_acc", "weak_used", "weak_cn0", "weak_top4", "reject_cn0", "ride_top4", "before_top4", "after_top4"]
    return out.select("session_id", *whole, *[F.round(c, 6).alias(c) for c in part], F.array_join("findings", ",").alias("findings"))


@query("decision_gnss_metrics", LINKED + """ SELECT result, count(*) AS n, count(linked_id) AS linked, round(avg(used_cn0), 6) AS cn0, round(avg(top4_cn0), 6) AS top4, round(avg(raw_acc) FILTER (WHERE raw_acc > 0), 6) AS acc FROM linked GROUP BY 1""", "fix snap decision")
def decision_gnss_metrics(x):
    return linked(x).groupBy("result").agg(F.count("*").alias("n"), F.count("linked_id").alias("linked"), F.round(F.avg("used_cn0"), 6).alias("cn0"), F.round(F.avg("top4_cn0"), 6).alias("top4"), F.round(F.avg(F.when(F.col("raw_acc") > 0, F.col("raw_acc"))), 6).alias("acc"))


_SAMPLE_COUNTS = ("raw_n", "stale_n", "decision_n", "trusted_n", "weak_n", "reject_n", "gap_n", "gap_zero_n", "ride_n", "policy_n", "distance_requests", "timeout_n", "snap_n", "motion_n", "long_gaps")
_SAMPLE_PARTS = ("raw_seconds", "diagnostic_seconds", "mean_gap", "longest_gap")
SAMPLE_SQL = """, iv AS (SELECT *, max(CASE WHEN t > 0 THEN t END) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM log_fix),
r AS (SELECT session_id, count(*) AS raw_n, count(*) FILTER (WHERE stale) AS stale_n, (max(t) - arg_min(t, line_no) FILTER (WHERE t > 0)) / 1e9 AS raw_seconds, count(*) FILTER (WHERE t > top AND t - top > 60000000000) AS long_gaps, coalesce(avg(CASE WHEN t > top THEN (t - top) / 1e9 END), 0) AS mean_gap, coalesce(max(CASE WHEN t > top THEN (t - top) / 1e9 END), 0) AS longest_gap FROM iv GROUP BY 1),
d AS (SELECT session_id, count(*) AS decision_n, count(DISTINCT CASE WHEN result IN ('anchor', 'accept') AND point_id > 0 THEN point_id END) + count(*) FILTER (WHERE result IN ('anchor', 'accept') AND NOT coalesce(point_id > 0, false)) AS trusted_n, count(*) FILTER (WHERE result = 'weak') AS weak_n,
  count(*) FILTER (WHERE result = 'reject') AS reject_n, count(*) FILTER (WHERE reason = 'gap_recovery') AS gap_n, count(*) FILTER (WHERE reason = 'gap_recovery' AND metres = 0 AND moving = 0) AS gap_zero_n, count(*) FILTER (WHERE (result = 'reject' AND reason IN ('transport_suspected', 'transport_confirmed')) OR (result = 'accept' AND reason = 'transport_recovery')) AS ride_n FROM log_decision GROUP BY 1),
p AS (SELECT session_id, count(*) AS policy_n, count(*) FILTER (WHERE min_distance <> 0) AS distance_requests FROM policy GROUP BY 1), s AS (SELECT session_id, count(*) AS timeout_n FROM status WHERE kind = 'no_location_timeout' GROUP BY 1),
sn AS (SELECT session_id, count(*) AS snap_n FROM snap GROUP BY 1), mo AS (SELECT session_id, count(*) AS motion_n FROM motion GROUP BY 1),
ev AS (SELECT session_id, line_no, recv AS t FROM log_fix UNION ALL SELECT session_id, line_no, t FROM log_decision UNION ALL SELECT session_id, line_no, t FROM policy UNION ALL SELECT session_id, line_no, t FROM status UNION ALL SELECT session_id, line_no, t1 FROM motion),
du AS (SELECT session_id, greatest(0, max(t) - arg_min(t, line_no)) / 1e9 AS diagnostic_seconds FROM ev WHERE t > 0 GROUP BY 1),
j AS (SELECT m.*, """ + ", ".join(f"coalesce({n}, 0) AS {n}" for n in (*_SAMPLE_COUNTS, *_SAMPLE_PARTS)) + """ FROM sample m LEFT JOIN r USING (session_id) LEFT JOIN d USING (session_id) LEFT JOIN p USING (session_id) LEFT JOIN s USING (session_id) LEFT JOIN sn USING (session_id) LEFT JOIN mo USING (session_id) LEFT JOIN du USING (session_id)),
f AS (SELECT *, concat_ws(',', CASE WHEN read_status <> 'OK' THEN 'MANIFEST_UNREADABLE' END, CASE WHEN NOT log_exists THEN 'LOG_MISSING' END, CASE WHEN log_status <> 'OK' THEN 'LOG_STATUS' END, CASE WHEN parse_failed THEN 'LOG_PARSE' END, CASE WHEN completion <> 'FINISHED' THEN 'NOT_FINISHED' END, CASE WHEN integrity <> 'OK' THEN 'INTEGRITY' END, CASE WHEN raw_n = 0 THEN 'NO_RAW' END, CASE WHEN decision_n = 0 THEN 'NO_DECISION' END,
  CASE WHEN points <= 0 THEN 'NO_TRACK_POINT' END, CASE WHEN raws <> raw_n THEN 'RAW_COUNT' END, CASE WHEN points <> trusted_n THEN 'TRACK_COUNT' END, CASE WHEN weaks <> weak_n THEN 'WEAK_COUNT' END, CASE WHEN gaps <> gap_n THEN 'GAP_COUNT' END, CASE WHEN raw_n <> decision_n THEN 'RAW_DECISION_COUNT' END, CASE WHEN distance_requests > 0 THEN 'MIN_DISTANCE' END, CASE WHEN gap_n <> gap_zero_n THEN 'GAP_DELTA' END) AS blocking,
 concat_ws(',', CASE WHEN last_seq <> log_seq THEN 'SEQ_MISMATCH' END, CASE WHEN raw_seconds < 1800 THEN 'SHORT' WHEN raw_seconds > 3900 THEN 'LONG' WHEN raw_seconds > 3600 THEN 'SLIGHTLY_LONG' END, CASE WHEN long_gaps > 0 THEN 'RAW_INTERVAL' END, CASE WHEN mean_gap > 15 THEN 'MEAN_INTERVAL' END, CASE WHEN policy_n = 0 THEN 'NO_POLICY' END,
  CASE WHEN timeout_n > 0 THEN 'TIMEOUT' END, CASE WHEN ride_n > 0 THEN 'TRANSPORT' END, CASE WHEN decision_n > 0 AND weak_n / decision_n > 0.3 THEN 'WEAK_RATIO' END, CASE WHEN decision_n > 0 AND reject_n / decision_n > 0.5 THEN 'REJECT_RATIO' END) AS review FROM j)
SELECT session_id, blocking, review, 'POWER,MAP_COMPATIBILITY' AS excluded, CASE WHEN blocking <> '' THEN 'FAIL' WHEN review <> '' THEN 'REVIEW' ELSE 'PASS' END AS verdict, """ + ", ".join([*_SAMPLE_COUNTS, *[f"round({n}, 6) AS {n}" for n in _SAMPLE_PARTS]]) + " FROM f"


@query("sample_report_verdict", SAMPLE_SQL, "log_fix log_decision policy status snap motion sample")
def sample_report_verdict(x):
    m = x.sample.join(R.sample_counts(x.log_fix, x.log_decision, x.policy, x.status, x.snap, x.motion), "session_id", "left").fillna(0, [*_SAMPLE_COUNTS, *_SAMPLE_PARTS])
    lists = [F.array_join(n, ",").alias(n) for n in ("blocking", "review", "excluded")]
    return R.sample_verdict(m).select("session_id", *lists, "verdict", *_SAMPLE_COUNTS, *[F.round(n, 6).alias(n) for n in _SAMPLE_PARTS])


@query("gap_summaries", ", g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rn FROM decision WHERE reason = 'gap_recovery') SELECT session_id, rn, concat('decision=', decision_id, ' raw=', raw_id, ' point=', coalesce(point_id, 0)) AS line FROM g WHERE rn <= 10", "decision")
def gap_summaries(x):
    rn = F.row_number().over(W.partitionBy("session_id").orderBy("line_no")).cast("long")
    line = F.concat(F.lit("decision="), F.col("decision_id").cast("string"), F.lit(" raw="), F.col("raw_id").cast("string"), F.lit(" point="), F.coalesce("point_id", F.lit(0)).cast("string"))
    return x.decision.where("reason = 'gap_recovery'").withColumn("rn", rn).where("rn <= 10").select("session_id", "rn", line.alias("line"))


@query("reason_counts", "SELECT result || ':' || reason AS code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, result || ':' || reason) AS pos FROM decision GROUP BY 1", "decision")
def reason_counts(x):
    counts = x.decision.groupBy(F.concat_ws(":", "result", "reason").alias("code")).agg(F.count("*").alias("n"))
    return counts.withColumn("pos", F.row_number().over(W.orderBy(F.desc("n"), "code")).cast("long"))  # a few codes


@query("diagnostic_summary", """SELECT session_id, count(*) AS n, count(*) FILTER (WHERE result IN ('accept', 'anchor')) AS trusted, count(*) FILTER (WHERE result = 'weak') AS weak, count(*) FILTER (WHERE result = 'reject') AS rejected, sum(metres) AS metres, sum(moving) AS moving,
  count(*) FILTER (WHERE reason = 'gap_recovery') AS gaps, count(*) FILTER (WHERE reason LIKE 'transport%') AS rides, (max(t) - min(t)) / 1e9 AS seconds FROM decision GROUP BY 1""", "decision")
def diagnostic_summary(x):
    n = F.count_if
    return x.decision.groupBy("session_id").agg(
        F.count("*").alias("n"), n(F.col("result").isin("accept", "anchor")).alias("trusted"), n(F.col("result") == "weak").alias("weak"), n(F.col("result") == "reject").alias("rejected"), F.sum("metres").alias("metres"), F.sum("moving").alias("moving"),
        n(F.col("reason") == "gap_recovery").alias("gaps"), n(F.col("reason").startswith("transport")).alias("rides"), ((F.max("t") - F.min("t")) / 1e9).alias("seconds"))


_METRICS = ("used", "used_cn0", "top4_cn0", "all_cn0")
_KINDS = (("weak", "result = 'weak'"), ("reject", "result = 'reject'"), ("ride", "reason LIKE 'transport\\_%' ESCAPE '\\'"))


def _totals(kind: str, cond: str) -> str:
    """A kind's points, those with a snapshot, and averages over these; a field that is missing adds nothing but counts."""
    averages = [f"coalesce(sum(coalesce({m}, 0)) FILTER (WHERE {cond} AND linked_id IS NOT NULL) / nullif(count(linked_id) FILTER (WHERE {cond}), 0), 0) AS {kind}_{m}" for m in _METRICS]
    return f"count(*) FILTER (WHERE {cond}) AS {kind}_n, count(linked_id) FILTER (WHERE {cond}) AS {kind}_linked, coalesce(avg(acc) FILTER (WHERE {cond}), 0) AS {kind}_acc, " + ", ".join(averages)


_EVIDENCE_SHOWN = [f"{k}_{m}" for k, _ in _KINDS for m in ("acc", *_METRICS)]
_EVIDENCE_COUNTS = ["raw_n", "decision_n", "stale_n", "bad_lines", "timeout_n", *[f"{k}_{m}" for k, _ in _KINDS for m in ("n", "linked")], "gap_n"]
EVIDENCE = f""", l AS (SELECT *, row_number() OVER (PARTITION BY session_id, raw_id ORDER BY line_no DESC) AS rn FROM log_decision),
pts AS (SELECT f.session_id, f.acc, f.stale, d.result, d.reason, s.snap_id AS linked_id, s.used, s.used_cn0, s.top4_cn0, s.all_cn0 FROM log_fix f LEFT JOIN l d ON f.session_id = d.session_id AND f.raw_id = d.raw_id AND d.rn = 1
 LEFT JOIN snap s ON s.session_id = f.session_id AND s.snap_id = coalesce(d.snap_id, f.snap_id)),
m AS (SELECT session_id, count(*) AS raw_n, count(*) FILTER (WHERE stale) AS stale_n, count(*) FILTER (WHERE reason = 'gap_recovery') AS gap_n, {', '.join(_totals(k, w) for k, w in _KINDS)} FROM pts GROUP BY 1),
dn AS (SELECT session_id, count(*) AS decision_n FROM log_decision GROUP BY 1), tn AS (SELECT session_id, count(*) AS timeout_n, max(waited) / 1000.0 AS timeout_max FROM status WHERE kind = 'no_location_timeout' GROUP BY 1),
e AS (SELECT g.session_id, bad_lines, coalesce(timeout_max, 0) AS timeout_max, {', '.join(f'coalesce({n}, 0) AS {n}' for n in [*_EVIDENCE_COUNTS, *_EVIDENCE_SHOWN] if n != 'bad_lines')} FROM log_session g LEFT JOIN m USING (session_id) LEFT JOIN dn USING (session_id) LEFT JOIN tn USING (session_id)),
f AS (SELECT *, concat_ws(',', CASE WHEN bad_lines > 0 THEN 'fail:PARSE_ERRORS' END, CASE WHEN raw_n = 0 THEN 'fail:NO_RAW' END, CASE WHEN decision_n = 0 THEN 'fail:NO_DECISION' END, CASE WHEN raw_n > 0 AND decision_n > 0 AND raw_n <> decision_n THEN 'review:RAW_DECISION_COUNT' END,
 CASE WHEN weak_n > weak_linked THEN 'review:WEAK_UNLINKED' END, CASE WHEN reject_n > reject_linked THEN 'review:REJECT_UNLINKED' END, CASE WHEN raw_n > 0 AND stale_n / raw_n > 0.2 THEN 'review:STALE_RATIO' END, CASE WHEN weak_n > 0 AND weak_used_cn0 > 0 AND weak_used_cn0 < 25 THEN 'review:WEAK_LOW_CN0' END,
 CASE WHEN weak_n > 0 AND weak_used > 0 AND weak_used < 5 THEN 'review:WEAK_FEW_SATS' END, CASE WHEN gap_n > 0 OR timeout_n > 0 THEN 'review:GAP_OR_NO_FIX' END, CASE WHEN ride_n > 0 AND ride_used_cn0 >= 25 THEN 'info:TRANSPORT_GOOD_SIGNAL' END) AS codes FROM e)
SELECT session_id, {', '.join(_EVIDENCE_COUNTS)}, round(timeout_max, 6) AS timeout_max, {', '.join(f'round({n}, 6) AS {n}' for n in _EVIDENCE_SHOWN)}, CASE WHEN codes = '' THEN 'pass:COMPLETE' ELSE codes END AS codes FROM f"""


@query("evidence_findings", EVIDENCE, "log_session log_fix log_decision snap status")
def evidence_findings(x):
    out = R.evidence(x.log_session, J.diagnostic_points(x.log_fix, x.log_decision, x.snap), x.log_decision, x.status)
    return out.select("session_id", *_EVIDENCE_COUNTS, F.round("timeout_max", 6).alias("timeout_max"), *[F.round(n, 6).alias(n) for n in _EVIDENCE_SHOWN], F.array_join("findings", ",").alias("codes"))


@query("trusted_segments", """, s AS (SELECT *, CAST(1 + sum(CASE WHEN reason IN ('gap_recovery', 'transport_recovery') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM decision)
SELECT session_id, segment_id, string_agg(CAST(decision_id AS VARCHAR), ',' ORDER BY line_no) AS ids, min(line_no) AS first_line FROM s WHERE result IN ('accept', 'anchor') GROUP BY 1, 2""", "decision")
def trusted_segments(x):
    from ..operators.windows import since_reset

    rows = since_reset(x.decision, F.col("reason").isin("gap_recovery", "transport_recovery")).where("result IN ('accept', 'anchor')").withColumn("segment_id", F.col("island_") + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "decision_id"))), lambda s: s["decision_id"].cast("string"))
    return rows.groupBy("session_id", "segment_id").agg(F.array_join(ids, ",").alias("ids"), F.min("line_no").alias("first_line"))


@query("map_bounds", "SELECT session_id, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east, count(*) AS n FROM fix GROUP BY 1", "fix")
def map_bounds(x):
    return x.fix.groupBy("session_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.count("*").alias("n"))


@query("map_frame", """, p AS (SELECT d.session_id, f.lat, f.lng FROM decision d JOIN fix f ON d.session_id = f.session_id AND d.raw_id = f.raw_id WHERE d.result <> 'reject' UNION ALL SELECT session_id, 29.0 + session_id % 7 / 1000.0, 106.0 - session_id % 5 / 1000.0 FROM manifest WHERE gpx_exists UNION ALL SELECT session_id, arg_max(lat, line_no), arg_max(lng, line_no) FROM fix GROUP BY 1)
SELECT session_id, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east, count(*) AS n FROM p GROUP BY 1""", "fix decision manifest")
def map_frame(x):
    """The frame over a session's points, the imported reference track and the current place."""
    points = x.decision.where("result <> 'reject'").select("session_id", "raw_id").join(x.fix.select("session_id", "raw_id", "lat", "lng"), ["session_id", "raw_id"]).drop("raw_id")
    reference = x.manifest.where("gpx_exists").select("session_id", (29.0 + F.col("session_id") % 7 / 1000.0).alias("lat"), (106.0 - F.col("session_id") % 5 / 1000.0).alias("lng"))
    current = x.fix.groupBy("session_id").agg(F.max_by("lat", "line_no").alias("lat"), F.max_by("lng", "line_no").alias("lng"))
    every = points.unionByName(reference).unionByName(current)
    return every.groupBy("session_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.count("*").alias("n"))


@query("log_duration", """, f AS (SELECT session_id, wall, line_no, CASE WHEN session_id % 6 <> 0 OR raw_id % 2 = 0 THEN t END AS t FROM fix), e AS (SELECT session_id, arg_min(struct_pack(t, wall), line_no) AS a, arg_max(struct_pack(t, wall), line_no) AS z, count(*) AS n FROM f GROUP BY 1)
SELECT session_id, CASE WHEN n < 2 THEN 0 WHEN a.t IS NOT NULL AND z.t IS NOT NULL THEN (z.t - a.t) / 1e9 WHEN a.wall IS NOT NULL AND z.wall IS NOT NULL THEN (z.wall - a.wall) / 1e3 ELSE 0 END AS seconds FROM e""", "fix")
def log_duration(x):
    """From the first fix to the last: by the elapsed clock, by wall time where one of them has none."""
    rows = x.fix.withColumn("t", F.when((F.col("session_id") % 6 != 0) | (F.col("raw_id") % 2 == 0), F.col("t")))
    ends = rows.groupBy("session_id").agg(F.min_by(F.struct("t", "wall"), "line_no").alias("a"), F.max_by(F.struct("t", "wall"), "line_no").alias("z"), F.count("*").alias("n"))
    seconds = F.coalesce((F.col("z.t") - F.col("a.t")) / 1e9, (F.col("z.wall") - F.col("a.wall")) / 1e3, F.lit(0.0))
    return ends.select("session_id", F.when(F.col("n") < 2, 0.0).otherwise(seconds).alias("seconds"))


@query("pressure_summary", "SELECT session_id, count(*) AS n, count(*) FILTER (WHERE hpa > 0) AS good, min(hpa) FILTER (WHERE hpa > 0) AS low, max(hpa) FILTER (WHERE hpa > 0) AS high, arg_min(hpa, line_no) FILTER (WHERE hpa > 0) AS first, arg_max(hpa, line_no) FILTER (WHERE hpa > 0) AS last FROM pressure GROUP BY 1", "pressure")
def pressure_summary(x):
    from ..functions.geo import sound_pressure

    good = F.when(sound_pressure(F.col("hpa")), F.col("hpa"))
    line = F.when(good.isNotNull(), F.col("line_no"))
    return x.pressure.groupBy("session_id").agg(F.count("*").alias("n"), F.count(good).alias("good"), F.min(good).alias("low"), F.max(good).alias("high"), F.min_by("hpa", line).alias("first"), F.max_by("hpa", line).alias("last"))


def replay_logs(x):
    """Logs with what a replay of each is to give: one fix in fifty expected wrongly in a third of them, one in six without expectation in another; some with a bad line, without a header, without a fix."""
    told = D.decide(x.fix, x.motion, x.snap).select("session_id", "line_no", F.col("result").alias("right"), F.col("reason").alias("why"))
    sid, raw = F.col("session_id"), F.col("raw_id")
    none, wrong = (sid % 3 == 2) & (raw % 6 == 0), (sid % 3 == 1) & (raw % 50 == 1)
    fix = x.fix.join(told, ["session_id", "line_no"]).where("session_id % 11 <> 3").select("session_id", "line_no", F.to_json(F.struct(
        F.lit("raw_location").alias("event"), raw.alias("rawPointId"), "provider", F.col("has_t").alias("hasElapsedRealtimeNanos"), F.col("t").alias("elapsedRealtimeNanos"), F.col("recv").alias("eventElapsedRealtimeNanos"), "lat", "lng", F.col("acc").isNotNull().alias("hasAccuracy"), F.col("acc").alias("accuracy"),
        "speed", "mock", F.col("snap_id").alias("sourceGnssSnapshotId"), F.when(~none, F.when(wrong, "altered").otherwise(F.col("right"))).alias("expectedResult"), F.when(~none, F.col("why")).alias("expectedReason"))).alias("line"))
    motion = x.motion.select("session_id", "line_no", F.to_json(F.struct(F.lit("motion_summary").alias("event"), F.col("motion_id").alias("motionSummaryId"), F.col("t0").alias("firstElapsedRealtimeNanos"), F.col("t1").alias("lastElapsedRealtimeNanos"), F.col("samples").alias("sampleCount"),
                                                                         F.col("rms").alias("dynamicAccelRmsMps2"), F.col("score").alias("stillScore"), F.col("still").alias("isDeviceStill"))).alias("line"))
    snap = x.snap.select("session_id", "line_no", F.to_json(F.struct(F.lit("gnss_snapshot").alias("event"), F.col("snap_id").alias("snapshotId"), F.col("t").alias("receivedElapsedRealtimeNanos"), F.col("used").alias("usedInFixTotal"), F.col("used_cn0").alias("usedAvgCn0"), F.col("top4_cn0").alias("top4AvgCn0"))).alias("line"))
    head = x.manifest.where("session_id % 11 <> 5").select("session_id", F.lit(1).cast("long").alias("line_no"), F.lit('{"event":"session_metadata","createdElapsedRealtimeNanos":1000000000}').alias("line"))
    cut = x.manifest.where("session_id % 11 = 7").select("session_id", F.lit(2).cast("long").alias("line_no"), F.lit('{"event":"raw_lo').alias("line"))
    rows = head.unionByName(cut).unionByName(fix).unionByName(motion).unionByName(snap)
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))


REPLAY = FOLD + """, g AS (SELECT session_id, CASE session_id % 11 WHEN 3 THEN 'no_raw_location_events' WHEN 5 THEN 'missing_session_metadata_before_raw_location' WHEN 7 THEN 'malformed_json_line_2' END AS why FROM manifest),
rp AS (SELECT session_id, why, CASE WHEN why IS NULL THEN count(*) ELSE 0 END AS n, CASE WHEN why IS NULL THEN count(*) FILTER (WHERE session_id % 3 = 1 AND raw_id % 50 = 1) ELSE 0 END AS misses, count(*) FILTER (WHERE session_id % 3 = 2 AND raw_id % 6 = 0) AS untold FROM d JOIN g USING (session_id) GROUP BY 1, 2),
st AS (SELECT session_id, CASE WHEN why IS NOT NULL THEN 'INVALID_LOG' WHEN misses = 0 AND untold = 0 THEN 'EXACT' ELSE 'BEST_EFFORT' END AS status, why, n, misses FROM rp)"""


@query("replay_reports", REPLAY + " SELECT * FROM st", "fix snap motion manifest")
def replay_reports(x):
    return jsonl.replay_reports(replay_logs(x))


@query("replay_status", REPLAY + " SELECT status, count(*) AS n FROM st GROUP BY 1", "fix snap motion manifest")
def replay_status(x):
    return jsonl.replay_batch(jsonl.replay_reports(replay_logs(x)))


@query("map_state", """SELECT d.session_id, arg_max(d.decision_id, d.line_no) FILTER (WHERE result IN ('accept', 'anchor')) AS last_trusted, coalesce(any_value(m.metres), sum(d.metres)) AS metres, count(*) FILTER (WHERE result <> 'reject' OR reason LIKE 'transport%') AS drawable FROM decision d LEFT JOIN (SELECT * FROM manifest WHERE read_status = 'OK') m USING (session_id) GROUP BY 1""", "decision manifest")
def map_state(x):
    trusted = F.when(F.col("result").isin("accept", "anchor"), F.col("line_no"))
    d = x.decision.groupBy("session_id").agg(F.max_by("decision_id", trusted).alias("last_trusted"), F.sum("metres").alias("own"), F.count_if((F.col("result") != "reject") | F.col("reason").startswith("transport")).alias("drawable"))
    m = x.manifest.where("read_status = 'OK'").select("session_id", "metres")
    return d.join(m, "session_id", "left").select("session_id", "last_trusted", F.coalesce("metres", "own").alias("metres"), "drawable")


@query("distinct_devices", "SELECT brand, count(DISTINCT model) AS models, count(*) AS n FROM manifest WHERE brand IS NOT NULL GROUP BY 1", "manifest")
def distinct_devices(x):
    return x.manifest.where("brand IS NOT NULL").groupBy("brand").agg(F.count_distinct("model").alias("models"), F.count("*").alias("n"))


CONSISTENCY = """, s AS (SELECT *, session_id // 4 AS batch, session_id % 27 AS samples, lower(trim(coalesce(brand, ''))) AS b, lower(trim(model)) AS m, concat_ws(',', CASE WHEN completion <> 'FINISHED' THEN 'COMPLETION' END, CASE WHEN integrity <> 'OK' THEN 'INTEGRITY' END, CASE WHEN ascent_source <> 'BAROMETER' THEN 'SOURCE' END, CASE WHEN ascent < 0 THEN 'ASCENT' END, CASE WHEN session_id % 27 <= 0 THEN 'SAMPLES' END) AS reasons FROM manifest),
v AS (SELECT batch, count(*) AS valid_n, median(ascent) AS med, count(*) FILTER (WHERE b = '' OR m = '') AS nameless, count(DISTINCT CASE WHEN b <> '' THEN b END) AS brands, count(DISTINCT b || '|' || m) AS models FROM s WHERE reasons = '' GROUP BY 1),
i AS (SELECT batch, all_n, coalesce(valid_n, 0) AS valid_n, med, CASE WHEN coalesce(valid_n, 0) < 2 THEN CASE WHEN valid_n = 1 AND nameless = 0 THEN 'same-model' ELSE 'unknown-device' END WHEN nameless > 0 THEN 'unknown-device' WHEN models <= 1 THEN 'same-model' WHEN brands <= 1 THEN 'same-brand' ELSE 'cross-brand-same-algorithm' END AS device_group,
  CASE WHEN med < 50 THEN 15 WHEN med < 100 THEN 20 WHEN med < 300 THEN 25 END AS low_limit FROM (SELECT batch, count(*) AS all_n FROM s GROUP BY 1) a LEFT JOIN v USING (batch)),
l AS (SELECT *, CASE device_group WHEN 'same-model' THEN 0.08 ELSE 0.12 END AS pass, CASE device_group WHEN 'same-model' THEN 0.12 WHEN 'same-brand' THEN 0.15 ELSE 0.18 END AS rev FROM i),
dev AS (SELECT s.session_id, l.*, reasons, CASE WHEN reasons = '' THEN abs(ascent - med) END AS away, CASE WHEN reasons = '' THEN abs(ascent - med) / greatest(med, 100) END AS rel FROM s JOIN l USING (batch)),
dv AS (SELECT *, CASE WHEN reasons <> '' THEN 'EXCLUDED' WHEN away <= low_limit OR rel <= pass THEN 'PASS' WHEN rel <= rev THEN 'REVIEW' ELSE 'FAIL' END AS verdict FROM dev)"""


def _consistency(x):
    return R.consistency(x.manifest.withColumns({"batch": F.expr("session_id DIV 4"), "samples": F.col("session_id") % 27}))


@query("consistency_devices", CONSISTENCY + " SELECT session_id, batch, device_group, reasons, round(away, 6) AS away, round(rel, 6) AS rel, verdict FROM dv", "manifest")
def consistency_devices(x):
    return _consistency(x)[0].select("session_id", "batch", "device_group", F.array_join("reasons", ",").alias("reasons"), F.round("away", 6).alias("away"), F.round("rel", 6).alias("rel"), "verdict")


@query("consistency_batch", CONSISTENCY + """ SELECT batch, device_group, all_n, valid_n, round(med, 6) AS median_ascent, round(max(rel), 6) AS max_rel, CASE WHEN valid_n < 2 THEN 'FAIL' WHEN max(rel) <= any_value(pass) OR coalesce(max(away) <= any_value(low_limit), false) THEN CASE WHEN all_n > valid_n OR device_group = 'unknown-device' THEN 'REVIEW' ELSE 'PASS' END WHEN max(rel) <= any_value(rev) THEN 'REVIEW' ELSE 'FAIL' END AS verdict
FROM dv GROUP BY batch, device_group, all_n, valid_n, med""", "manifest")
def consistency_batch(x):
    return _consistency(x)[1].select("batch", "device_group", "all_n", "valid_n", F.round("median_ascent", 6).alias("median_ascent"), F.round("max_rel", 6).alias("max_rel"), "verdict")


@query("satellite_snapshot", """, top AS (SELECT session_id, snap_id, avg(cn0) AS top4_cn0 FROM (SELECT *, row_number() OVER (PARTITION BY session_id, snap_id ORDER BY cn0 DESC) AS rn FROM sat) WHERE rn <= 4 GROUP BY 1, 2),
c AS (SELECT session_id, snap_id, arg_min(carrier, ord) AS first FROM sat WHERE carrier > 0 GROUP BY 1, 2)
SELECT s.session_id, s.snap_id, count(*) AS visible, count(*) FILTER (WHERE used) AS used, round(coalesce(avg(cn0) FILTER (WHERE used AND cn0 > 0), 0), 6) AS used_cn0, round(avg(cn0), 6) AS all_cn0, round(any_value(top4_cn0), 6) AS top4_cn0, count(*) FILTER (WHERE cn0 < 20) AS low_visible, count(*) FILTER (WHERE used AND cn0 < 25) AS weak_used,
  """ + ", ".join(f"count(*) FILTER (WHERE {w}) AS {n}_visible, count(*) FILTER (WHERE ({w}) AND used) AS {n}_used" for n, w in R.SYSTEMS_SQL.items()) + """, coalesce(max(abs(carrier - first)) >= 1000000, false) AS dual FROM sat s JOIN top USING (session_id, snap_id) LEFT JOIN c USING (session_id, snap_id) GROUP BY 1, 2""", "sat")
def satellite_snapshot(x):
    out = R.satellite_summary(x.sat, ["session_id", "snap_id"])
    return out.select("session_id", "snap_id", "visible", "used", *[F.round(c, 6).alias(c) for c in ("used_cn0", "all_cn0", "top4_cn0")], "low_visible", "weak_used", *[f"{n}_{k}" for n in R.SYSTEMS_SQL for k in ("visible", "used")], "dual")


@query("constellation_summary", """SELECT CASE kind WHEN 1 THEN 'GPS' WHEN 2 THEN 'SBAS' WHEN 3 THEN 'GLONASS' WHEN 4 THEN 'QZSS' WHEN 5 THEN 'BeiDou' WHEN 6 THEN 'Galileo' WHEN 7 THEN 'IRNSS' ELSE 'UNK' END AS name, count(*) AS visible, count(*) FILTER (WHERE used) AS used, max(cn0) AS top, round(avg(cn0), 6) AS mean FROM sat GROUP BY 1""", "sat")
def constellation_summary(x):
    from ..functions.geo import constellation

    return x.sat.groupBy(constellation(F.col("kind")).alias("name")).agg(F.count("*").alias("visible"), F.count_if("used").alias("used"), F.greatest(F.lit(0.0), F.max("cn0")).alias("top"), F.round(F.avg("cn0"), 6).alias("mean"))


@query("satellites_in_order", "SELECT session_id, snap_id, ord, row_number() OVER (PARTITION BY session_id, snap_id ORDER BY kind, svid, ord) AS pos FROM sat", "sat")
def satellites_in_order(x):
    return x.sat.select("session_id", "snap_id", F.col("ord"), F.row_number().over(W.partitionBy("session_id", "snap_id").orderBy("kind", "svid", "ord")).cast("long").alias("pos"))


@query("point_counts", "SELECT session_id, count(*) FILTER (WHERE result IN ('accept', 'anchor')) AS trusted, count(*) FILTER (WHERE result = 'weak') AS weak, count(*) FILTER (WHERE reason LIKE 'transport%' AND result = 'reject') AS transport FROM decision GROUP BY 1", "decision")
def point_counts(x):
    return x.decision.groupBy("session_id").agg(F.count_if(F.col("result").isin("accept", "anchor")).alias("trusted"), F.count_if(F.col("result") == "weak").alias("weak"), F.count_if(F.col("reason").startswith("transport") & (F.col("result") == "reject")).alias("transport"))
