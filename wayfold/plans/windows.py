"""Queries of windows, ascent, ordering and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import ascent as A
from ..operators import windows as O
from ..functions import geo
from .registry import query


@query("raw_intervals", """, w AS (SELECT *, max(CASE WHEN t > 0 THEN t END) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM fix)
SELECT session_id, raw_id, CASE WHEN t > top THEN (t - top) / 1e9 END AS gap FROM w""", "fix")
def raw_intervals(x):
    top = F.max(F.when(F.col("t") > 0, F.col("t"))).over(O.earlier("line_no"))
    return x.fix.withColumn("top", top).select("session_id", "raw_id", F.when(F.col("t") > F.col("top"), (F.col("t") - F.col("top")) / 1e9).alias("gap"))


@query("raw_interval_stats", """, w AS (SELECT *, max(CASE WHEN t > 0 THEN t END) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM fix),
g AS (SELECT session_id, (t - top) / 1e9 AS gap FROM w WHERE t > top)
SELECT session_id, count(*) AS n, round(max(gap), 6) AS longest, round(avg(gap), 6) AS mean, count(*) FILTER (WHERE gap > 60) AS long_gaps FROM g GROUP BY 1""", "fix")
def raw_interval_stats(x):
    return raw_intervals(x).where("gap IS NOT NULL").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("gap"), 6).alias("longest"), F.round(F.avg("gap"), 6).alias("mean"), F.count_if(F.col("gap") > 60).alias("long_gaps"))


@query("running_now", "SELECT session_id, raw_id, max(recv) OVER (PARTITION BY session_id ORDER BY line_no) AS now_t FROM fix", "fix")
def running_now(x):
    return x.fix.select("session_id", "raw_id", F.max("recv").over(O.running("line_no")).alias("now_t"))


@query("last_policy_before", """, u AS (SELECT session_id, line_no, raw_id, CAST(NULL AS VARCHAR) AS state FROM fix UNION ALL SELECT session_id, line_no, NULL, state FROM policy),
w AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS policy_state FROM u)
SELECT session_id, raw_id, policy_state FROM w WHERE raw_id IS NOT NULL""", "fix policy")
def last_policy_before(x):
    from ..operators.joins import latest_before

    return latest_before(x.fix, x.policy, ["state"]).select("session_id", "raw_id", F.col("latest.state").alias("policy_state"))


@query("sampling_durations", """, w AS (SELECT session_id, state, t, lead(t) OVER (PARTITION BY session_id ORDER BY line_no) AS nxt FROM policy),
e AS (SELECT session_id, max(t) AS last_t FROM (SELECT session_id, t FROM policy UNION ALL SELECT session_id, recv FROM fix) GROUP BY 1)
SELECT session_id, state, count(*) AS requests, round(coalesce(sum(CASE WHEN coalesce(nxt, last_t) > t THEN (coalesce(nxt, last_t) - t) / 1e9 END), 0), 6) AS seconds FROM w JOIN e USING (session_id) GROUP BY 1, 2""", "policy fix")
def sampling_durations(x):
    nxt = F.lead("t").over(W.partitionBy("session_id").orderBy("line_no"))
    last = x.policy.select("session_id", "t").unionAll(x.fix.select("session_id", "recv")).groupBy("session_id").agg(F.max("t").alias("last_t"))
    end = F.coalesce("nxt", "last_t")
    rows = x.policy.withColumn("nxt", nxt).join(last, "session_id")
    return rows.groupBy("session_id", "state").agg(F.count(F.lit(1)).alias("requests"), F.round(F.coalesce(F.sum(F.when(end > F.col("t"), (end - F.col("t")) / 1e9)), F.lit(0.0)), 6).alias("seconds"))


@query("consecutive_stationary", """, k AS (SELECT *, reason = 'stationary_keepalive' AS keep, reason IN ('stationary_jitter', 'stationary_anchor_refined', 'stationary_accel_supported_jitter', 'rest_candidate', 'rest_paused_keepalive', 'rest_probing_stationary', 'stationary_motion_blocked_recovery', 'rest_probing_confirming_moving') AS jit FROM resting),
w AS (SELECT *, sum(CASE WHEN keep OR jit THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS isle FROM k),
n AS (SELECT session_id, decision_id, count(*) FILTER (WHERE keep) OVER o AS keepalives, count(*) FILTER (WHERE jit) OVER o AS jitters FROM w WINDOW o AS (PARTITION BY session_id, isle ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT session_id, decision_id, keepalives, jitters, keepalives >= 2 OR jitters >= 10 AS paused FROM n""", "resting")
def consecutive_stationary(x):
    return O.stationary_runs(x.resting).select("session_id", "decision_id", "keepalives", "jitters", "paused")


@query("segment_ids", """SELECT session_id, decision_id, CAST(1 + sum(CASE WHEN reason IN ('gap_recovery', 'transport_recovery') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id,
  row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS seq FROM decision""", "decision")
def segment_ids(x):
    starts = F.col("reason").isin("gap_recovery", "transport_recovery")
    return O.since_reset(x.decision, starts).select("session_id", "decision_id", (F.col("island_") + 1).alias("segment_id"), F.row_number().over(W.partitionBy("session_id").orderBy("line_no")).cast("long").alias("seq"))


@query("gpx_segments", """, p AS (SELECT session_id, decision_id, line_no, result = 'weak' AS weak FROM decision WHERE result <> 'reject'),
b AS (SELECT *, CASE WHEN weak OR coalesce(lag(weak) OVER (PARTITION BY session_id ORDER BY line_no), true) THEN 1 ELSE 0 END AS brk FROM p)
SELECT session_id, decision_id, CAST(sum(brk) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trkseg FROM b""", "decision")
def gpx_segments(x):
    from ..sources.gpx import with_breaks

    return with_breaks(x.decision.where("result != 'reject'"), "line_no").select("session_id", "decision_id", "trkseg")


@query("pair_lines", """, p AS (SELECT session_id, decision_id, reason, line_no FROM decision WHERE result <> 'weak'), l AS (SELECT *, lag(reason) OVER (PARTITION BY session_id ORDER BY line_no) AS before FROM p)
SELECT session_id, decision_id, CASE WHEN reason LIKE 'transport%' OR before LIKE 'transport%' THEN 'transport' ELSE 'walking' END AS line FROM l WHERE before IS NOT NULL""", "decision")
def pair_lines(x):
    before = F.lag("reason").over(W.partitionBy("session_id").orderBy("line_no"))
    rides = F.col("reason").startswith("transport") | F.col("before").startswith("transport")
    return x.decision.where("result != 'weak'").withColumn("before", before).where("before IS NOT NULL").select("session_id", "decision_id", F.when(rides, "transport").otherwise("walking").alias("line"))


@query("prev_heading", """, p AS (SELECT d.session_id, d.decision_id, d.line_no, f.lat, f.lng FROM decision d JOIN fix f ON d.session_id = f.session_id AND d.raw_id = f.raw_id WHERE d.result IN ('accept', 'anchor')),
w AS (SELECT *, lag(lat) OVER o AS pla, lag(lng) OVER o AS pln FROM p WINDOW o AS (PARTITION BY session_id ORDER BY line_no)),
h AS (SELECT *, power(sin(radians(lat - pla) / 2), 2) + cos(radians(pla)) * cos(radians(lat)) * power(sin(radians(lng - pln) / 2), 2) AS h FROM w)
SELECT session_id, decision_id, CASE WHEN 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) >= 5 THEN round((degrees(atan2(sin(radians(lng - pln)) * cos(radians(lat)), cos(radians(pla)) * sin(radians(lat)) - sin(radians(pla)) * cos(radians(lat)) * cos(radians(lng - pln)))) + 360) % 360, 6) END AS heading FROM h""", "fix decision")
def prev_heading(x):
    o = W.partitionBy("session_id").orderBy("line_no")
    trusted = x.decision.where("result IN ('accept', 'anchor')").select("session_id", "decision_id", "line_no", "raw_id").join(x.fix.select("session_id", "raw_id", "lat", "lng"), ["session_id", "raw_id"])
    rows = trusted.withColumns({"pla": F.lag("lat").over(o), "pln": F.lag("lng").over(o)})
    there = F.col("pla"), F.col("pln"), F.col("lat"), F.col("lng")
    return rows.select("session_id", "decision_id", F.when(geo.haversine(*there) >= O.HEADING_METRES, F.round(geo.bearing(*there), 6)).alias("heading"))


@query("heading_reliability", """, s AS (SELECT session_id, raw_id, seq * 700000000 AS t, bearing AS heading, CAST(15 + raw_id % 60 AS DOUBLE) AS field, CAST(raw_id % 8 AS DOUBLE) / 10 AS gyro, raw_id % 10 <> 0 AS accurate, CASE WHEN raw_id % 12 = 0 THEN 600000000 ELSE 100000000 END AS late FROM fix),
w AS (SELECT *, count(heading) OVER o AS n, avg(cos(radians(heading))) OVER o AS c, avg(sin(radians(heading))) OVER o AS sn, max(gyro) OVER o AS top_gyro FROM s WINDOW o AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 3000000000 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, CASE WHEN sqrt(c * c + sn * sn) >= 1 THEN 0 ELSE degrees(sqrt(-2 * ln(greatest(sqrt(c * c + sn * sn), 1e-12)))) END AS spread FROM w)
SELECT session_id, raw_id, n, round(top_gyro, 6) AS top_gyro, CASE WHEN heading IS NULL THEN 'sensor_unavailable' WHEN late > 500000000 THEN 'heading_stale' WHEN NOT accurate THEN 'sensor_accuracy_low' WHEN field < 20 OR field > 80 THEN 'magnetic_norm_outlier'
 WHEN n < 3 OR spread > 15 THEN 'heading_jitter' WHEN top_gyro > 0.5 THEN 'device_rotating' ELSE 'reliable' END AS verdict FROM v""", "fix")
def heading_reliability(x):
    s = x.fix.select("session_id", "raw_id", (F.col("seq") * 700_000_000).alias("t"), F.col("bearing").alias("heading"), (15 + F.col("raw_id") % 60).cast("double").alias("field"), ((F.col("raw_id") % 8).cast("double") / 10).alias("gyro"),
                     (F.col("raw_id") % 10 != 0).alias("accurate"), F.when(F.col("raw_id") % 12 == 0, 600_000_000).otherwise(100_000_000).alias("late"))
    return O.heading_reliability(s).select("session_id", "raw_id", "n", F.round("top_gyro", 6).alias("top_gyro"), "verdict")


#: Marks at whole multiples of `every` after a part's first point; a step back in time bears none, and time that was passed before is not passed again.
MARKERS = """, w AS (SELECT *, lag(t) OVER o AS pt, lag(lat) OVER o AS pla, lag(lng) OVER o AS pln, first_value(t) OVER o AS ft, max(t) OVER (PARTITION BY session_id, part ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p WINDOW o AS (PARTITION BY session_id, part ORDER BY ord)),
m AS (SELECT *, unnest(range((greatest(pt, top) - ft) // {every} + 1, (t - ft) // {every} + 1)) AS k FROM w WHERE t > pt)"""
MARKERS_10 = MARKERS.replace("{every}", "600000000000")


@query("time_markers", ", p AS (SELECT session_id, 0 AS part, line_no AS ord, t, lat, lng FROM fix WHERE lat <> 0)" + MARKERS_10 + """
SELECT session_id, CAST(k AS BIGINT) AS k, CAST(ft + k * 600000000000 AS BIGINT) AS t, round(pla + (lat - pla) * ((ft + k * 600000000000 - pt) / (t - pt)), 9) AS lat, round(pln + (lng - pln) * ((ft + k * 600000000000 - pt) / (t - pt)), 9) AS lng FROM m WHERE ft + k * 600000000000 >= pt""", "fix")
def time_markers(x):
    p = x.fix.where("lat <> 0").select("session_id", F.col("line_no").alias("ord"), "t", "lat", "lng")
    return O.time_markers(p).withColumns({"lat": F.round("lat", 9), "lng": F.round("lng", 9)})


@query("pressure_throttle", """, s AS (SELECT session_id, line_no, sample_id, t, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rn FROM pressure),
r AS (SELECT session_id, sample_id, t, rn, t AS kept, true AS keep FROM s WHERE rn = 1 UNION ALL
  SELECT s.session_id, s.sample_id, s.t, s.rn, CASE WHEN s.t - r.kept >= 1000000000 THEN s.t ELSE r.kept END, s.t - r.kept >= 1000000000 FROM r JOIN s ON s.session_id = r.session_id AND s.rn = r.rn + 1)
SELECT session_id, sample_id FROM r WHERE keep""", "pressure")
def pressure_throttle(x):
    return O.throttled(x.pressure).select("session_id", "sample_id")


@query("dedup_live_points", """, s AS (SELECT session_id, raw_id, round(lat, 4) AS lat, round(lng, 4) AS lng, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rn FROM fix),
r AS (SELECT session_id, raw_id, rn, lat, lng, true AS keep FROM s WHERE rn = 1 UNION ALL
  SELECT s.session_id, s.raw_id, s.rn, CASE WHEN abs(s.lat - r.lat) > 1e-7 OR abs(s.lng - r.lng) > 1e-7 THEN s.lat ELSE r.lat END, CASE WHEN abs(s.lat - r.lat) > 1e-7 OR abs(s.lng - r.lng) > 1e-7 THEN s.lng ELSE r.lng END,
    abs(s.lat - r.lat) > 1e-7 OR abs(s.lng - r.lng) > 1e-7 FROM r JOIN s ON s.session_id = r.session_id AND s.rn = r.rn + 1)
SELECT session_id, raw_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) AS newest FROM r WHERE keep) WHERE newest <= 1000""", "fix")
def dedup_live_points(x):
    rows = x.fix.withColumns({"lat": F.round("lat", 4), "lng": F.round("lng", 4)})
    return O.newest(O.distinct_steps(rows), O.LIVE_POINTS).select("session_id", "raw_id")


@query("motion_windows", """, s AS (SELECT session_id, t1 // 1000000 * 250000 AS t, rms AS d, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rn FROM motion),
r AS (SELECT session_id, rn, t, t AS t0, CAST(1 AS BIGINT) AS n, d * d AS sq, false AS closed, CAST(1 AS BIGINT) AS wid FROM s WHERE rn = 1 UNION ALL
  SELECT s.session_id, s.rn, s.t, CASE WHEN r.closed THEN s.t ELSE r.t0 END, CASE WHEN r.closed THEN 1 ELSE r.n + 1 END, CASE WHEN r.closed THEN 0 ELSE r.sq END + s.d * s.d,
    CASE WHEN r.closed THEN false ELSE s.t - r.t0 >= 1000000000 END, r.wid + CASE WHEN r.closed THEN 1 ELSE 0 END FROM r JOIN s ON s.session_id = r.session_id AND s.rn = r.rn + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY session_id, wid ORDER BY rn DESC) AS last FROM r)
SELECT session_id, wid AS window_id, t0, t AS t1, n AS samples, round(sqrt(sq / n), 6) AS rms, round(least(1, greatest(0, 1 - sqrt(sq / n) / 0.3)), 6) AS score, n >= 5 AND 1 - sqrt(sq / n) / 0.3 >= 0.7 AS still FROM l WHERE last = 1""", "motion")
def motion_windows(x):
    s = x.motion.select("session_id", "line_no", (F.expr("t1 DIV 1000000") * 250000).alias("t"), F.col("rms").alias("dynamic"))
    return O.motion_windows(s).select("session_id", "window_id", "t0", "t1", "samples", F.round("rms", 6).alias("rms"), F.round("score", 6).alias("score"), "still")


def ascent_sql(rows: str, alpha: float, climb: str, drop: str, climb_s: str, gap: str, name: str = "asc_") -> str:
    """A recursive fold, one step a sample, with the state in columns: the CTE name and what it needs."""
    return f""", {name}_s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS rn FROM ({rows})),
{name}_r AS (SELECT session_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS base, CAST(NULL AS DOUBLE) AS peak, CAST(0 AS BIGINT) AS lt, CAST(NULL AS DOUBLE) AS sv, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS rejected
   FROM (SELECT DISTINCT session_id FROM {name}_s) UNION ALL
 SELECT session_id, rn, total + CASE op WHEN 'reset' THEN gain0 WHEN 'on' THEN CASE WHEN turned AND peak - base >= {climb} THEN peak - base ELSE 0 END ELSE 0 END,
   CASE op WHEN 'reset' THEN alt WHEN 'on' THEN nf ELSE f END, CASE WHEN op = 'reset' THEN alt WHEN op = 'on' AND (f IS NULL OR turned) THEN nf ELSE base END,
   CASE WHEN op = 'reset' THEN alt WHEN op = 'on' AND (f IS NULL OR turned OR nf >= peak) THEN nf ELSE peak END, CASE WHEN op = 'skip' THEN lt ELSE t END, CASE WHEN op = 'skip' THEN sv ELSE vacc END, n + CASE WHEN op = 'skip' THEN 0 ELSE 1 END, rejected + CASE WHEN op = 'skip' THEN 1 ELSE 0 END
 FROM (SELECT *, NOT (f IS NULL OR nf >= peak) AND peak - nf >= {drop} AS turned, CASE WHEN f IS NOT NULL AND peak - base >= {climb_s} THEN peak - base ELSE 0 END AS gain0 FROM (
   SELECT r.session_id, s.rn, r.total, r.f, r.base, r.peak, r.lt, r.sv, r.n, r.rejected, s.alt, s.t, s.vacc, CASE WHEN r.f IS NULL THEN s.alt ELSE s.alt * {alpha} + r.f * (1 - {alpha}) END AS nf,
     CASE WHEN s.bad THEN 'skip' WHEN s.reset OR (r.f IS NOT NULL AND {gap}) THEN 'reset' WHEN r.f IS NOT NULL AND (s.t <= r.lt OR abs(s.alt - r.f) / ((s.t - r.lt) / 1e9) > 2) THEN 'skip' ELSE 'on' END AS op
   FROM {name}_r r JOIN {name}_s s ON s.session_id = r.session_id AND s.rn = r.rn + 1))),
{name}_fin AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) AS last FROM {name}_r),
{name} AS (SELECT session_id, CASE WHEN n >= 2 THEN total + CASE WHEN peak - base >= {climb_s} THEN peak - base ELSE 0 END ELSE -1 END AS ascent, n, rejected FROM {name}_fin WHERE last = 1)
"""


ANCHORS = "'first_fix_good', 'first_fix_relaxed', 'forced_weak_first_fix', 'gap_recovery', 'transport_recovery', 'rest_moving_recovery', 'stationary_anchor_refined'"
BARO_ROWS = "SELECT session_id, line_no AS ord, t, alt, CAST(0 AS DOUBLE) AS vacc, false AS reset, hpa <= 0 AS bad FROM pressure"
#: Track points: those of an anchor's reason restart the fold, of the others only steps of five metres are samples.
SAT_ROWS = f"SELECT d.session_id, d.line_no AS ord, f.t, f.alt, f.vacc, d.reason IN ({ANCHORS}) AS reset, false AS bad FROM decision d JOIN fix f ON d.session_id = f.session_id AND d.raw_id = f.raw_id WHERE f.alt IS NOT NULL AND f.vacc > 0 AND f.vacc <= 12 AND f.acc > 0 AND f.acc <= 30 AND (d.reason IN ({ANCHORS}) OR d.reason = 'moving_good_fix' AND d.metres >= 5)"
BARO_POINT_ROWS = f"SELECT d.session_id, d.line_no AS ord, p.t, p.alt, CAST(0 AS DOUBLE) AS vacc, d.reason IN ({ANCHORS}) AS reset, false AS bad FROM decision d JOIN pressure p ON d.session_id = p.session_id AND d.decision_id = p.sample_id WHERE p.hpa > 0 AND d.point_id IS NOT NULL AND d.reason NOT IN ('transport_suspected', 'transport_confirmed', 'impossible_speed')"


def barometer_rows(x):
    return x.pressure.select("session_id", F.col("line_no").alias("ord"), "t", "alt", F.lit(0.0).alias("vacc"), F.lit(False).alias("reset"), (~geo.sound_pressure(F.col("hpa"))).alias("bad"))


def satellite_rows(x):
    points = x.decision.select("session_id", F.col("line_no").alias("ord"), "raw_id", "reason", "metres").join(x.fix.select("session_id", "raw_id", "t", "alt", "vacc", "acc"), ["session_id", "raw_id"])
    return A.satellite_samples(points)


def barometer_point_rows(x):
    own = x.pressure.select("session_id", F.col("sample_id").alias("decision_id"), "t", "alt", "hpa")
    points = x.decision.where("point_id IS NOT NULL").select("session_id", F.col("line_no").alias("ord"), "decision_id", "reason").join(own, ["session_id", "decision_id"])
    return A.barometer_samples(points)


BARO_SQL = ascent_sql(BARO_ROWS, 0.35, "3", "1.5", "3", "s.t - r.lt > 30000000000", "baro")
SAT_SQL = ascent_sql(SAT_ROWS, 0.15, "greatest(5, vacc * 0.8)", "greatest(3, vacc * 0.4)", "greatest(5, sv * 0.8)", "false", "sat_")


@query("ascent_baro", BARO_SQL + " SELECT session_id, round(ascent, 6) AS ascent, n, rejected FROM baro", "pressure")
def ascent_baro(x):
    return A.fold(barometer_rows(x), A.BAROMETER, A.BAROMETER_GAP).withColumn("ascent", F.round("ascent", 6))


@query("ascent_baro_points", ascent_sql(BARO_POINT_ROWS, 0.35, "3", "1.5", "3", "s.t - r.lt > 30000000000", "bp_") + " SELECT session_id, round(ascent, 6) AS ascent, n, rejected FROM bp_", "pressure decision")
def ascent_baro_points(x):
    return A.fold(barometer_point_rows(x), A.BAROMETER, A.BAROMETER_GAP).withColumn("ascent", F.round("ascent", 6))


#: Heights of the ground under the track, where a raster has them: here by whole-number arithmetic from the place.
TERRAIN_ROWS = "SELECT session_id, line_no AS ord, t, 400 + CAST((raw_id * 13) % 40 AS DOUBLE) / 4 AS alt, CAST(0 AS DOUBLE) AS vacc, seq = 1 AS reset, raw_id % 83 = 0 AS bad FROM fix"


@query("ascent_terrain", ascent_sql(TERRAIN_ROWS, 0.25, "5", "3", "5", "false", "dem_") + " SELECT session_id, round(ascent, 6) AS ascent, n, rejected FROM dem_", "fix")
def ascent_terrain(x):
    ground = 400 + ((F.col("raw_id") * 13) % 40).cast("double") / 4
    rows = x.fix.select("session_id", F.col("line_no").alias("ord"), "t", ground.alias("alt"), F.lit(0.0).alias("vacc"), (F.col("seq") == 1).alias("reset"), (F.col("raw_id") % 83 == 0).alias("bad"))
    return A.fold(rows, A.TERRAIN).withColumn("ascent", F.round("ascent", 6))


@query("ascent_gnss", SAT_SQL + " SELECT session_id, round(ascent, 6) AS ascent, n, rejected FROM sat_", "fix decision")
def ascent_gnss(x):
    return A.fold(satellite_rows(x), A.SATELLITE).withColumn("ascent", F.round("ascent", 6))


@query("ascent_selected", BARO_SQL + SAT_SQL + """ SELECT session_id, round(CASE WHEN b.ascent >= 0 THEN b.ascent WHEN s.ascent >= 0 THEN s.ascent ELSE -1 END, 6) AS ascent, CASE WHEN b.ascent >= 0 THEN 'BAROMETER' WHEN s.ascent >= 0 THEN 'GNSS' ELSE 'NONE' END AS source FROM baro b FULL JOIN sat_ s USING (session_id)""", "pressure fix decision")
def ascent_selected(x):
    return A.selected(A.fold(barometer_rows(x), A.BAROMETER, A.BAROMETER_GAP), A.fold(satellite_rows(x), A.SATELLITE)).withColumn("ascent", F.round("ascent", 6))


@query("barometer_calibration", """, p AS (SELECT f.session_id, f.raw_id, f.line_no, f.alt, f.vacc, f.acc, (SELECT arg_max(q.alt, q.line_no) FROM pressure q WHERE q.session_id = f.session_id AND q.line_no < f.line_no) AS baro, (SELECT arg_max(q.t, q.line_no) FROM pressure q WHERE q.session_id = f.session_id AND q.line_no < f.line_no) AS bt, f.t FROM fix f),
ok AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rn FROM p WHERE alt IS NOT NULL AND vacc <= 8 AND acc <= 30 AND abs(t - bt) <= 3000000000)
SELECT session_id, raw_id, round(alt - baro, 6) AS shift FROM ok WHERE rn = 1""", "fix pressure")
def barometer_calibration(x):
    from ..operators.joins import latest_before

    rows = latest_before(x.fix, x.pressure, ["t", "alt"])
    good = F.col("alt").isNotNull() & (F.col("vacc") <= 8) & (F.col("acc") <= 30) & (F.abs(F.col("t") - F.col("latest.t")) <= 3_000_000_000)
    first = rows.where(good).groupBy("session_id").agg(F.min_by(F.struct("raw_id", "alt", "latest"), "line_no").alias("f"))
    return first.select("session_id", F.col("f.raw_id").alias("raw_id"), F.round(F.col("f.alt") - F.col("f.latest.alt"), 6).alias("shift"))


@query("recent_motion", """, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC) AS rn FROM motion) SELECT session_id, string_agg(CAST(motion_id AS VARCHAR), ',' ORDER BY line_no) AS ids, count(*) AS n FROM l WHERE rn <= 8 GROUP BY 1""", "motion")
def recent_motion(x):
    rn = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("line_no")))
    return x.motion.withColumn("rn", rn).where("rn <= 8").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "motion_id"))), lambda m: m["motion_id"].cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


@query("timeline_union", """, u AS (SELECT session_id, t, line_no, 'point' AS kind, decision_id AS id FROM decision UNION ALL SELECT session_id, t, line_no, 'event', event_id FROM status UNION ALL SELECT session_id, t, line_no, 'policy', policy_id FROM policy)
SELECT session_id, kind, id, row_number() OVER (PARTITION BY session_id ORDER BY t, line_no) AS pos FROM u""", "decision status policy")
def timeline_union(x):
    part = lambda df, kind, key: df.select("session_id", "t", "line_no", F.lit(kind).alias("kind"), F.col(key).alias("id"))
    u = part(x.decision, "point", "decision_id").unionByName(part(x.status, "event", "event_id")).unionByName(part(x.policy, "policy", "policy_id"))
    return u.select("session_id", "kind", "id", F.row_number().over(W.partitionBy("session_id").orderBy("t", "line_no")).cast("long").alias("pos"))


@query("points_in_order", "SELECT session_id, raw_id, row_number() OVER (PARTITION BY session_id ORDER BY t, raw_id) AS by_time, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN has_t THEN t ELSE wall * 1000000 END, line_no) AS by_either, row_number() OVER (PARTITION BY session_id ORDER BY t // 20000000000, CASE WHEN raw_id % 11 IN (1, 2) THEN 1 ELSE 0 END, line_no) AS trusted_first FROM fix", "fix")
def points_in_order(x):
    either = F.when(F.col("has_t"), F.col("t")).otherwise(F.col("wall") * 1_000_000)
    rank = lambda *o: F.row_number().over(W.partitionBy("session_id").orderBy(*o)).cast("long")
    return x.fix.select("session_id", "raw_id", rank("t", "raw_id").alias("by_time"), rank(either, "line_no").alias("by_either"), rank(F.expr("t DIV 20000000000"), F.when(F.col("raw_id") % 11 < 3, (F.col("raw_id") % 11 > 0).cast("int")).otherwise(0), "line_no").alias("trusted_first"))


@query("newest_sessions", "SELECT session_id, created FROM manifest ORDER BY created DESC, session_id", "manifest")
def newest_sessions(x):
    return x.manifest.orderBy(F.desc("created"), "session_id").select("session_id", "created")


@query("kept_last_300", ", l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC) AS rn, max(t) OVER (PARTITION BY session_id) AS top FROM snap) SELECT session_id, snap_id FROM l WHERE rn <= 300 AND top - t <= 300000000000", "snap")
def kept_last(x, rows: int = 300, age: int = 300_000_000_000):
    w = W.partitionBy("session_id")
    return x.snap.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("line_no"))), "top": F.max("t").over(w)}).where((F.col("rn") <= rows) & (F.col("top") - F.col("t") <= age)).select("session_id", "snap_id")


@query("first_exportable", """SELECT kind, session_id FROM (SELECT 'log' AS kind, session_id, row_number() OVER (ORDER BY created DESC, session_id) AS rn FROM manifest WHERE log_exists UNION ALL
 SELECT 'track', session_id, row_number() OVER (ORDER BY created DESC, session_id) FROM manifest WHERE read_status = 'OK' AND completion = 'FINISHED' AND integrity = 'OK' AND points > 0 AND gpx_exists) WHERE rn = 1""", "manifest")
def first_exportable(x):
    from ..functions.fields import can_export

    whole = can_export(*[F.col(n) for n in ("read_status", "completion", "integrity", "points", "gpx_exists")])
    first = lambda kind, which: x.manifest.where(which).orderBy(F.desc("created"), "session_id").limit(1).select(F.lit(kind).alias("kind"), "session_id")
    return first("log", F.col("log_exists")).unionByName(first("track", whole))


@query("map_points_union", "SELECT session_id, decision_id, 'trusted' AS layer FROM decision WHERE result IN ('accept', 'anchor') UNION ALL SELECT session_id, decision_id, 'weak' FROM decision WHERE result = 'weak' UNION ALL SELECT session_id, decision_id, 'transport' FROM decision WHERE reason IN ('transport_suspected', 'transport_confirmed')", "decision")
def map_points_union(x):
    layer = lambda cond, name: x.decision.where(cond).select("session_id", "decision_id", F.lit(name).alias("layer"))
    return layer("result IN ('accept', 'anchor')", "trusted").unionByName(layer("result = 'weak'", "weak")).unionByName(layer("reason IN ('transport_suspected', 'transport_confirmed')", "transport"))


@query("last_write_wins", ", l AS (SELECT *, row_number() OVER (PARTITION BY session_id, snap_id // 10 ORDER BY line_no DESC) AS rn FROM snap) SELECT session_id, snap_id // 10 AS slot, snap_id FROM l WHERE rn = 1", "snap")
def last_write_wins(x):
    return x.snap.groupBy("session_id", F.expr("snap_id DIV 10").alias("slot")).agg(F.max_by("snap_id", "line_no").alias("snap_id"))


@query("no_fix_timeouts", ", w AS (SELECT session_id, raw_id, t, lead(t) OVER (PARTITION BY session_id ORDER BY line_no) AS nxt FROM fix) SELECT session_id, raw_id, t + 30000000000 AS due FROM w WHERE nxt - t >= 30000000000", "fix")
def no_fix_timeouts(x):
    nxt = F.lead("t").over(W.partitionBy("session_id").orderBy("line_no"))
    return x.fix.withColumn("nxt", nxt).where(F.col("nxt") - F.col("t") >= 30_000_000_000).select("session_id", "raw_id", (F.col("t") + 30_000_000_000).alias("due"))
