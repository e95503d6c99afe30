"""Queries of validation, decisions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import joins as J
from . import decide as D
from .decide_sql import DECISIONS
from .registry import query

VALID = """, now AS (SELECT *, greatest(max(recv) OVER (PARTITION BY session_id ORDER BY line_no), start_t) AS now_t FROM fix),
checked AS (SELECT *, CASE WHEN provider <> 'gps' THEN 'provider_not_gps' WHEN NOT has_t THEN 'missing_elapsed_realtime' WHEN t < start_t - 1000000000 THEN 'before_record_start'
  WHEN t > now_t + 1000000000 THEN 'location_from_future' WHEN greatest(0, now_t - t) > 30000000000 THEN 'location_too_old' WHEN (lat = 0 AND lng = 0) OR abs(lat) > 90 OR abs(lng) > 180 THEN 'zero_coordinate'
  WHEN acc IS NULL OR acc <= 0 THEN 'invalid_accuracy' WHEN acc > 80 THEN 'accuracy_too_large' WHEN mock THEN 'mock_location' END AS reason FROM now)"""


@query("validate_reasons", VALID + " SELECT session_id, raw_id, reason, now_t FROM checked", "fix")
def validate_reasons(x):
    return D.validated(x.fix).select("session_id", "raw_id", F.col("invalid").alias("reason"), F.col("now").alias("now_t"))


@query("validation_counts", VALID + " SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM checked GROUP BY 1", "fix")
def validation_counts(x):
    return D.validated(x.fix).groupBy(F.coalesce("invalid", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def decisions(x):
    return D.decide(x.fix, x.motion, x.snap)


FOLD = VALID + DECISIONS
POINTS = FOLD + ", tp AS (SELECT *, row_number() OVER (PARTITION BY session_id, point_id ORDER BY decision_id DESC) AS newest FROM d WHERE point_id IS NOT NULL)"


@query("decide_trace", FOLD + " SELECT session_id, line_no, decision_id, raw_id, result, reason, state, round(metres, 6) AS metres, round(seconds, 6) AS seconds, point_id, segment_id, new_segment, jitter, keepalive, t FROM d", "fix snap motion")
def decide_trace(x):
    return decisions(x).drop("lat", "lng").withColumns({"metres": F.round("metres", 6), "seconds": F.round("seconds", 6)})


@query("decision_counts", FOLD + " SELECT result, reason, count(*) AS n, round(sum(metres), 6) AS metres FROM d GROUP BY 1, 2", "fix snap motion")
def decision_counts(x):
    return decisions(x).groupBy("result", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metres"), 6).alias("metres"))


@query("track_points", POINTS + " SELECT session_id, point_id, decision_id, raw_id, segment_id, result, reason, round(metres, 6) AS metres, round(seconds, 6) AS seconds, t, round(lat, 6) AS lat, round(lng, 6) AS lng FROM tp WHERE newest = 1", "fix snap motion")
def track_points(x):
    return D.track_points(decisions(x)).withColumns({c: F.round(c, 6) for c in ("metres", "seconds", "lat", "lng")})


@query("session_stats", FOLD + """ SELECT session_id, count(*) AS n_decisions, CAST(sum(keepalive) AS BIGINT) AS keepalives, CAST(sum(jitter) AS BIGINT) AS jitters, count(*) FILTER (WHERE reason = 'gap_recovery') AS gaps, count(*) FILTER (WHERE reason = 'transport_suspected') AS rides,
 round(sum(metres), 6) AS metres, round(sum(seconds), 6) AS seconds FROM d GROUP BY 1""", "fix snap motion")
def session_stats(x):
    return D.session_stats(decisions(x))


ASOF = """SELECT f.session_id, f.raw_id, m.match_id, m.age, m.future, m.match_id IS NULL AS no_match FROM fix f LEFT JOIN (
  SELECT f.session_id, f.raw_id, s.snap_id AS match_id, abs(f.t - s.t) AS age, f.t < s.t AS future,
    row_number() OVER (PARTITION BY f.session_id, f.raw_id ORDER BY f.t < s.t, abs(f.t - s.t), s.line_no) AS rn
  FROM fix f JOIN snap s ON f.session_id = s.session_id AND s.line_no < f.line_no AND abs(f.t - s.t) <= 3000000000) m ON f.session_id = m.session_id AND f.raw_id = m.raw_id AND m.rn = 1"""


@query("asof_snapshot", ASOF, "fix snap")
def asof_snapshot(x):
    return J.asof_snapshot(x.fix, x.snap)


@query("snapshot_by_id", "SELECT f.session_id, f.raw_id, f.snap_id, s.used, s.top4_cn0 FROM fix f LEFT JOIN snap s ON f.session_id = s.session_id AND f.snap_id = s.snap_id AND s.line_no < f.line_no", "fix snap")
def snapshot_by_id(x):
    return J.by_arrival(x.fix, x.snap, "snap_id", "snap_id").select("session_id", "raw_id", "snap_id", F.col("used_r").alias("used"), F.col("top4_cn0_r").alias("top4_cn0"))


@query("decision_raw_join", "SELECT d.session_id, d.decision_id, d.raw_id, f.acc, f.lat FROM decision d JOIN fix f ON d.session_id = f.session_id AND d.raw_id = f.raw_id AND f.line_no < d.line_no", "fix decision")
def decision_raw_join(x):
    return J.by_arrival(x.decision, x.fix, "raw_id", "raw_id").where("raw_id_r IS NOT NULL").select("session_id", "decision_id", "raw_id", F.col("acc_r").alias("acc"), F.col("lat_r").alias("lat"))


LINKED = """, linked AS (SELECT d.*, f.acc AS raw_acc, f.raw_id IS NOT NULL AS has_raw, s.snap_id AS linked_id, s.used, s.used_cn0, s.all_cn0, s.top4_cn0
  FROM decision d LEFT JOIN fix f ON d.session_id = f.session_id AND d.raw_id = f.raw_id AND f.line_no < d.line_no
  LEFT JOIN snap s ON d.session_id = s.session_id AND s.snap_id = coalesce(d.snap_id, f.snap_id) AND s.line_no < d.line_no)"""


@query("decision_snapshot_fallback", LINKED + " SELECT session_id, decision_id, linked_id, used_cn0, raw_acc FROM linked", "fix snap decision")
def decision_snapshot_fallback(x):
    return J.decision_snapshots(x.decision, x.fix, x.snap).select("session_id", "decision_id", F.col("snap_id_r").alias("linked_id"), F.col("used_cn0_r").alias("used_cn0"), "raw_acc")


@query("decision_snapshot_own", "SELECT d.session_id, d.decision_id, s.snap_id AS linked_id, s.top4_cn0 FROM decision d LEFT JOIN snap s ON d.session_id = s.session_id AND s.snap_id = d.snap_id AND s.line_no < d.line_no", "snap decision")
def decision_snapshot_own(x):
    return J.by_arrival(x.decision, x.snap, "snap_id", "snap_id").select("session_id", "decision_id", F.col("snap_id_r").alias("linked_id"), F.col("top4_cn0_r").alias("top4_cn0"))


GAPS = """, pairs AS (SELECT d.session_id, d.decision_id, d.t - s.t AS dt, s.snap_id, s.top4_cn0, s.line_no FROM decision d JOIN snap s ON d.session_id = s.session_id AND abs(d.t - s.t) <= 30000000000 WHERE d.reason = 'gap_recovery'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, decision_id, dt >= 0 ORDER BY abs(dt), line_no) AS rn FROM pairs),
gaps AS (SELECT d.session_id, d.decision_id, b.snap_id AS before_id, a.snap_id AS after_id, b.top4_cn0 AS before_top4, a.top4_cn0 AS after_top4 FROM decision d
  LEFT JOIN ranked b ON b.session_id = d.session_id AND b.decision_id = d.decision_id AND b.rn = 1 AND b.dt >= 0
  LEFT JOIN ranked a ON a.session_id = d.session_id AND a.decision_id = d.decision_id AND a.rn = 1 AND a.dt < 0 WHERE d.reason = 'gap_recovery')"""


@query("gap_window_snapshots", GAPS + " SELECT * FROM gaps", "snap decision")
def gap_window_snapshots(x):
    return J.gap_windows(x.decision, x.snap)


@query("nearest_motion", """SELECT f.session_id, f.raw_id, m.motion_id, m.far FROM fix f LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY session_id, raw_id ORDER BY far, t0, line_no) AS rn FROM (
    SELECT f.session_id, f.raw_id, m.motion_id, m.t0, m.line_no, greatest(0, m.t0 - f.t, f.t - m.t1) AS far FROM fix f JOIN motion m USING (session_id)) WHERE far <= 5000000000) m
  ON f.session_id = m.session_id AND f.raw_id = m.raw_id AND m.rn = 1""", "fix motion")
def nearest_motion(x):
    return J.nearest_motion(x.fix, x.motion)


@query("latest_pressure", """SELECT session_id, raw_id, CASE WHEN abs(t - p.t) <= 3000000000 THEN p.sample_id END AS sample_id, CASE WHEN abs(t - p.t) <= 3000000000 THEN p.alt END AS baro_alt FROM (
  SELECT f.session_id, f.raw_id, f.t, (SELECT struct_pack(t := arg_max(q.t, q.line_no), sample_id := arg_max(q.sample_id, q.line_no), alt := arg_max(q.alt, q.line_no)) FROM pressure q WHERE q.session_id = f.session_id AND q.line_no < f.line_no AND q.hpa > 0) AS p FROM fix f)""", "fix pressure")
def latest_pressure(x):
    rows = J.latest_before(x.fix, x.pressure, ["t", "sample_id", "alt"], F.col("hpa") > 0)
    near = F.abs(F.col("t") - F.col("latest.t")) <= 3_000_000_000
    return rows.select("session_id", "raw_id", F.when(near, F.col("latest.sample_id")).alias("sample_id"), F.when(near, F.col("latest.alt")).alias("baro_alt"))


HAV = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - ({a})))"


def hav(la1, lo1, la2, lo2):
    a = f"power(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * power(sin(radians({lo2} - {lo1}) / 2), 2)"
    return HAV.format(a=a)


@query("prev_trusted_context", f""", pts AS (SELECT d.session_id, d.decision_id, d.line_no, d.result, f.lat, f.lng, f.t FROM decision d JOIN fix f ON d.session_id = f.session_id AND d.raw_id = f.raw_id),
w AS (SELECT *, last_value(CASE WHEN result IN ('accept', 'anchor') THEN struct_pack(id := decision_id, lat := lat, lng := lng, t := t) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM pts)
SELECT session_id, decision_id, p.id AS prev_id, CASE WHEN t > p.t THEN (t - p.t) / 1e9 END AS dt, round({hav('p.lat', 'p.lng', 'lat', 'lng')}, 6) AS metres, round(CASE WHEN t > p.t THEN {hav('p.lat', 'p.lng', 'lat', 'lng')} / ((t - p.t) / 1e9) END, 6) AS speed FROM w""", "fix decision")
def prev_trusted_context(x):
    from ..functions.geo import haversine

    pts = x.decision.select("session_id", "decision_id", "line_no", "result", "raw_id").join(x.fix.select("session_id", "raw_id", "lat", "lng", "t"), ["session_id", "raw_id"])
    w = W.partitionBy("session_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    p = F.last(F.when(F.col("result").isin("accept", "anchor"), F.struct("decision_id", "lat", "lng", "t")), ignorenulls=True).over(w)
    rows = pts.withColumn("p", p)
    metres = haversine(F.col("p.lat"), F.col("p.lng"), F.col("lat"), F.col("lng"))
    dt = F.when(F.col("t") > F.col("p.t"), (F.col("t") - F.col("p.t")) / 1e9)
    return rows.select("session_id", "decision_id", F.col("p.decision_id").alias("prev_id"), dt.alias("dt"), F.round(metres, 6).alias("metres"), F.round(metres / dt, 6).alias("speed"))


@query("diagnostic_rows", """, last_d AS (SELECT *, row_number() OVER (PARTITION BY session_id, raw_id ORDER BY line_no DESC) AS rn FROM decision)
SELECT f.session_id, f.raw_id, d.decision_id, CASE WHEN d.result IS NULL THEN 'raw' ELSE d.result END AS kind, s.snap_id AS linked_id, s.used FROM fix f LEFT JOIN last_d d ON f.session_id = d.session_id AND f.raw_id = d.raw_id AND d.rn = 1
LEFT JOIN snap s ON s.session_id = f.session_id AND s.snap_id = coalesce(d.snap_id, f.snap_id)""", "fix snap decision")
def diagnostic_rows(x):
    last = x.decision.groupBy("session_id", "raw_id").agg(F.max_by(F.struct("decision_id", "result", "snap_id"), "line_no").alias("d"))
    rows = x.fix.join(last, ["session_id", "raw_id"], "left").withColumn("wanted", F.coalesce("d.snap_id", "snap_id"))
    s = x.snap.select(F.col("session_id").alias("s_session"), F.col("snap_id").alias("linked_id"), "used")
    return rows.join(s, (F.col("session_id") == F.col("s_session")) & (F.col("wanted") == F.col("linked_id")), "left").select("session_id", "raw_id", "d.decision_id", F.coalesce("d.result", F.lit("raw")).alias("kind"), "linked_id", "used")


@query("manifest_reconciliation", """SELECT m.session_id, m.raws = coalesce(r.n, 0) AS raws_match, m.weaks = coalesce(d.weaks, 0) AS weaks_match, m.points = coalesce(d.points, 0) AS points_match FROM manifest m
LEFT JOIN (SELECT session_id, count(*) AS n FROM fix GROUP BY 1) r USING (session_id)
LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE result = 'weak') AS weaks, count(DISTINCT point_id) AS points FROM decision GROUP BY 1) d USING (session_id)""", "fix decision manifest")
def manifest_reconciliation(x):
    r = x.fix.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    d = x.decision.groupBy("session_id").agg(F.count_if(F.col("result") == "weak").alias("d_weaks"), F.count_distinct("point_id").alias("d_points"))
    same = lambda a, b: F.col(a) == F.coalesce(b, F.lit(0))
    return x.manifest.join(r, "session_id", "left").join(d, "session_id", "left").select("session_id", same("raws", "n").alias("raws_match"), same("weaks", "d_weaks").alias("weaks_match"), same("points", "d_points").alias("points_match"))


@query("orphan_decisions_anti", "SELECT session_id, decision_id, raw_id FROM decision d WHERE NOT EXISTS (SELECT 1 FROM fix f WHERE f.session_id = d.session_id AND f.raw_id = d.raw_id)", "fix decision")
def orphan_decisions_anti(x):
    return x.decision.join(x.fix.select("session_id", "raw_id"), ["session_id", "raw_id"], "left_anti").select("session_id", "decision_id", "raw_id")


@query("accepted_semi", "SELECT session_id, raw_id FROM fix f WHERE EXISTS (SELECT 1 FROM decision d WHERE f.session_id = d.session_id AND f.raw_id = d.raw_id AND d.result = 'accept')", "fix decision")
def accepted_semi(x):
    return x.fix.join(x.decision.where("result = 'accept'"), ["session_id", "raw_id"], "left_semi").select("session_id", "raw_id")


@query("selected_session", """, few AS (SELECT session_id, created, row_number() OVER (ORDER BY session_id = 7 AND read_status = 'OK' DESC, created DESC, session_id) AS rn FROM manifest) SELECT session_id, created FROM few WHERE rn = 1""", "manifest")
def selected_session(x, wanted: int = 7):
    hit = ((F.col("session_id") == wanted) & (F.col("read_status") == "OK")).cast("int")
    return x.manifest.orderBy(hit.desc(), F.desc("created"), "session_id").limit(1).select("session_id", "created")
