"""Queries of scalar functions, states, policies and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fields as T
from ..functions import geo as G
from ..sources import gpx, jsonl, manifest, polyline
from .joins import hav
from .registry import query

c = F.col
r6 = lambda e, name: F.round(e, 6).alias(name)


@query("geo_scalars", f"""SELECT session_id, raw_id, round({hav('lat', 'lng', '29.0', '106.0')}, 6) AS metres, round((degrees(atan2(sin(radians(106.0 - lng)) * cos(radians(29.0)), cos(radians(lat)) * sin(radians(29.0)) - sin(radians(lat)) * cos(radians(29.0)) * cos(radians(106.0 - lng)))) + 360) % 360, 6) AS home,
 CASE WHEN start_t <= 0 OR t <= start_t THEN 0 ELSE (t - start_t) / 1e9 END AS seconds, ((raw_id * 7) % 720 - 360 + 720) % 360 AS course, least(abs(coalesce(bearing, 0) - 90), 360 - abs(coalesce(bearing, 0) - 90)) AS turn, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(coalesce(bearing, 0) / 45 + 0.5) AS BIGINT) % 8 + 1] AS wind FROM fix""", "fix")
def geo_scalars(x):
    b = F.coalesce("bearing", F.lit(0.0))
    return x.fix.select("session_id", "raw_id", r6(G.haversine(c("lat"), c("lng"), F.lit(29.0), F.lit(106.0)), "metres"), r6(G.bearing(c("lat"), c("lng"), F.lit(29.0), F.lit(106.0)), "home"), G.seconds(c("start_t"), c("t")).alias("seconds"),
                        F.pmod((c("raw_id") * 7) % 720 - 360, F.lit(360).cast("long")).alias("course"), G.heading_delta(b, F.lit(90.0)).alias("turn"), G.cardinal(b).alias("wind"))


@query("barometer_scalars", "SELECT session_id, sample_id, CASE WHEN hpa > 0 THEN round(44330 * (1 - power(hpa / 1013.25, 1 / 5.255)), 6) END AS metres, hpa > 0 AS sound, alt + 12.5 AS shown FROM pressure", "pressure")
def barometer_scalars(x):
    good = G.sound_pressure(c("hpa"))
    return x.pressure.select("session_id", "sample_id", F.when(good, F.round(G.barometer_altitude(c("hpa")), 6)).alias("metres"), good.alias("sound"), (c("alt") + 12.5).alias("shown"))


@query("motion_scalars", "SELECT session_id, motion_id, round(least(1, greatest(0, 1 - rms / 0.3)), 6) AS score, round(CASE WHEN motion_id % 2 = 0 THEN abs(sqrt(rms * rms + 81 + 16) - 9.80665) ELSE sqrt(rms * rms + 81 + 16) END, 6) AS dynamic FROM motion", "motion")
def motion_scalars(x):
    return x.motion.select("session_id", "motion_id", r6(G.still_score(c("rms")), "score"), r6(G.dynamic_acceleration(c("motion_id") % 2 == 0, c("rms"), F.lit(9.0), F.lit(4.0)), "dynamic"))


@query("mercator_tiles", """, m AS (SELECT session_id, raw_id, lat, (lng + 180) / 360 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS y, 3 + raw_id % 16 AS z FROM fix)
SELECT session_id, raw_id, round(x, 9) AS x, round(y, 9) AS y, z AS zoom, concat(z, '/', CAST(floor(x * power(2, z)) AS BIGINT), '/', CAST(floor(y * power(2, z)) AS BIGINT)) AS tile, least(22, greatest(2, CAST(floor(log2((1 + raw_id % 5000000) / 256.0) + 0.5) AS INTEGER))) AS scale_zoom, round(8 * 1048576.0 / (40075016.686 * greatest(0.15, cos(radians(lat)))), 6) AS circle FROM m""", "fix")
def mercator_tiles(x):
    mx, my = G.mercator(c("lat"), c("lng"))
    zoom = 3 + c("raw_id") % 16
    return x.fix.select("session_id", "raw_id", F.round(mx, 9).alias("x"), F.round(my, 9).alias("y"), zoom.alias("zoom"), G.tile(mx, my, zoom)[2].alias("tile"), G.zoom_of((1 + c("raw_id") % 5_000_000).cast("double")).alias("scale_zoom"), r6(G.circle_pixels(F.lit(8.0), c("lat"), F.lit(1048576.0)), "circle"))


@query("gcj02_offset", """, p AS (SELECT session_id, raw_id, lat, lng, lng - 105 AS x, lat - 35 AS y, pi() AS p FROM fix),
q AS (SELECT *, (20 * sin(6 * x * p) + 20 * sin(2 * x * p)) * 2 / 3 AS w, 1 - 0.006693421622965943 * sin(radians(lat)) * sin(radians(lat)) AS g FROM p),
d AS (SELECT *, -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + w + (20 * sin(y * p) + 40 * sin(y / 3 * p)) * 2 / 3 + (160 * sin(y / 12 * p) + 320 * sin(y / 30 * p)) * 2 / 3 AS dla, 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + w + (20 * sin(x * p) + 40 * sin(x / 3 * p)) * 2 / 3 + (150 * sin(x / 12 * p) + 300 * sin(x / 30 * p)) * 2 / 3 AS dln FROM q)
SELECT session_id, raw_id, round(CASE WHEN lng BETWEEN 72.004 AND 137.8347 AND lat BETWEEN 0.8293 AND 55.8271 THEN lat + degrees(dla / (6378245.0 * (1 - 0.006693421622965943) / (g * sqrt(g)))) ELSE lat END, 9) AS lat,
 round(CASE WHEN lng BETWEEN 72.004 AND 137.8347 AND lat BETWEEN 0.8293 AND 55.8271 THEN lng + degrees(dln / (6378245.0 / sqrt(g) * cos(radians(lat)))) ELSE lng END, 9) AS lng FROM d""", "fix")
def gcj02_offset(x):
    la, ln = G.shifted(c("lat"), c("lng"))
    return x.fix.select("session_id", "raw_id", F.round(la, 9).alias("lat"), F.round(ln, 9).alias("lng"))


@query("pseudorange", """, s AS (SELECT session_id, raw_id, CAST(raw_id AS DOUBLE) * 1000000 AS tn, -1000000000000000.0 - raw_id * 1000 AS fb, CASE WHEN raw_id % 3 = 0 THEN NULL ELSE raw_id % 7 * 0.125 END AS b, raw_id % 90 AS k FROM fix),
t AS (SELECT *, (tn - (fb + coalesce(b, 0))) % 604800000000000.0 AS rx FROM s), u AS (SELECT *, (CASE WHEN rx < 0 THEN rx + 604800000000000.0 ELSE rx END - (rx - k * 5000000)) * 1e-9 AS g FROM t), v AS (SELECT *, (CASE WHEN g < 0 THEN g + 604800 ELSE g END) * 299792458.0 AS m FROM u)
SELECT session_id, raw_id, CASE WHEN m > 0 AND m <= 100000000 THEN round(m, 1) END AS metres, CASE raw_id % 9 WHEN 1 THEN 'GPS' WHEN 2 THEN 'SBAS' WHEN 3 THEN 'GLONASS' WHEN 4 THEN 'QZSS' WHEN 5 THEN 'BeiDou' WHEN 6 THEN 'Galileo' WHEN 7 THEN 'IRNSS' ELSE 'UNK' END AS system,
 CASE WHEN raw_id & 1 <> 0 THEN 'CODE_LOCK' WHEN raw_id & 2 <> 0 THEN 'BIT_SYNC' WHEN raw_id & 4 <> 0 THEN 'SUBFRAME' WHEN raw_id & 8 <> 0 THEN 'TOW' ELSE 'UNKNOWN' END AS state FROM v""", "fix")
def pseudorange(x):
    tn, fb = c("raw_id").cast("double") * 1000000, -1000000000000000.0 - c("raw_id") * 1000
    b = F.when(c("raw_id") % 3 != 0, c("raw_id") % 7 * 0.125)
    rx = (tn - (fb + F.coalesce(b, F.lit(0.0)))) % 604800000000000.0
    return x.fix.select("session_id", "raw_id", F.round(G.pseudorange(tn, fb, b, rx - c("raw_id") % 90 * 5000000), 1).alias("metres"), G.constellation(c("raw_id") % 9).alias("system"), G.measurement_state(c("raw_id")).alias("state"))


@query("signal_level", "SELECT session_id, raw_id, greatest(CASE WHEN acc <= 8 THEN 4 WHEN acc <= 18 THEN 3 WHEN acc <= 40 THEN 2 WHEN acc IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN raw_id % 12 >= 8 AND raw_id % 45 >= 35 THEN 4 WHEN raw_id % 12 >= 5 AND raw_id % 45 >= 28 THEN 3 WHEN raw_id % 12 >= 3 AND raw_id % 45 >= 22 THEN 2 WHEN raw_id % 12 > 0 OR raw_id % 45 > 0 THEN 1 ELSE 0 END) AS level FROM fix", "fix")
def signal_level(x):
    return x.fix.select("session_id", "raw_id", G.signal_level(c("acc"), c("raw_id") % 12, c("raw_id") % 12, c("raw_id") % 45).alias("level"))


@query("formatters", "SELECT session_id, raw_id, printf('%.1f', floor((raw_id % 1000) / 8.0 * 10 + 0.5) / 10) AS one, printf('%d:%02d:%02d', raw_id // 3600, raw_id % 3600 // 60, raw_id % 60) AS clock, CASE WHEN raw_id % 4 = 0 THEN '-' ELSE printf('%.1f', CAST(raw_id % 50 AS DOUBLE)) END AS climb, concat(printf('%.1f', floor((raw_id % 64) / 64.0 * 1000 + 0.5) / 10), '%') AS share FROM fix", "fix")
def formatters(x):
    climb = F.when(c("raw_id") % 4 == 0, -1.0).otherwise((c("raw_id") % 50).cast("double"))
    return x.fix.select("session_id", "raw_id", T.one_decimal((c("raw_id") % 1000) / 8.0).alias("one"), T.duration_text(c("raw_id")).alias("clock"), T.ascent_text(climb).alias("climb"), T.percent_text((c("raw_id") % 64) / 64.0).alias("share"))


@query("device_labels", "SELECT session_id, CASE WHEN brand IS NOT NULL THEN concat(trim(brand), ' ', trim(model)) ELSE trim(model) END AS label, lower(trim(coalesce(brand, ''))) AS key FROM manifest", "manifest")
def device_labels(x):
    return x.manifest.select("session_id", T.device_label(c("brand"), c("model"), F.lit(None).cast("string"), F.lit("maker")).alias("label"), T.key(c("brand")).alias("key"))


@query("coercions", """, t AS (SELECT session_id, e, CASE e % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '12.5' WHEN 3 THEN 'abc' WHEN 4 THEN ' ' ELSE '-3' END AS v, e % 7 = 0 AS gone FROM base) SELECT session_id, e, CASE WHEN gone THEN NULL WHEN v IS NULL OR trim(v) = '' THEN 0 ELSE TRY_CAST(v AS DOUBLE) END AS loose, TRY_CAST(nullif(trim(v), '') AS DOUBLE) AS strict FROM t""", "base")
def coercions(x):
    k = c("e") % 6
    v = F.when(k == 1, "").when(k == 2, "12.5").when(k == 3, "abc").when(k == 4, " ").when(k == 5, "-3")
    return x.base.select("session_id", "e", T.coerced(v, c("e") % 7 == 0).alias("loose"), T.number(F.nullif(F.trim(v), F.lit(""))).alias("strict"))


@query("sort_times", "SELECT session_id, event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN t END, waited, 0) AS at FROM status", "status")
def sort_times(x):
    return x.status.select("session_id", "event_id", T.sort_time(F.when(c("event_id") % 3 == 0, c("t")), c("waited")).alias("at"))


@query("marker_times", "SELECT session_id, raw_id, CASE WHEN t - 100000000000 > 0 THEN t - 100000000000 WHEN wall > 0 THEN wall * 1000000 ELSE 0 END AS at FROM fix", "fix")
def marker_times(x):
    return x.fix.select("session_id", "raw_id", T.marker_time(c("t") - 100_000_000_000, c("wall")).alias("at"))


@query("decision_kinds", "SELECT session_id, decision_id, CASE WHEN decision_id % 13 = 0 THEN 'raw' ELSE result END AS kind, split_part(result || ':' || reason, ':', 2) AS reason, result = 'weak' AS weak, reason LIKE 'transport%' AS ride FROM decision", "decision")
def decision_kinds(x):
    seen = F.when(c("decision_id") % 13 == 0, F.lit("other")).otherwise(c("result"))
    return x.decision.select("session_id", "decision_id", T.decision_kind(seen).alias("kind"), F.split_part(F.concat_ws(":", "result", "reason"), F.lit(":"), F.lit(2)).alias("reason"), (c("result") == "weak").alias("weak"), c("reason").startswith("transport").alias("ride"))


@query("reason_dictionary", "SELECT reason, title, count(*) AS n FROM decision LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v[0]}')" for k, v in T.REASONS.items()) + ") AS t(code, title) ON reason = code GROUP BY 1, 2", "decision")
def reason_dictionary(x):
    table = x.spark.createDataFrame([(k, *v) for k, v in T.REASONS.items()], "code string, title string, meaning string")
    return x.decision.join(F.broadcast(table), c("reason") == c("code"), "left").groupBy("reason", "title").agg(F.count(F.lit(1)).alias("n"))  # a fixed table of codes


@query("recovery_states", "SELECT session_id, CASE WHEN read_status = 'MISSING' THEN 'MISSING_MANIFEST' WHEN read_status = 'INVALID' THEN 'INVALID_MANIFEST' WHEN NOT log_exists THEN 'ABORTED' WHEN integrity = 'ERROR' OR completion = 'ERROR' THEN 'ERROR' WHEN completion = 'FINISHED' THEN 'FINISHED' WHEN completion IN ('ACTIVE', 'INTERRUPTED') THEN 'INTERRUPTED' ELSE 'UNKNOWN' END AS state, last_seq = log_seq AS seq_matches FROM manifest", "manifest")
def recovery_states(x):
    return x.manifest.select("session_id", T.recovery_state(c("read_status"), c("log_exists"), c("completion"), c("integrity")).alias("state"), (c("last_seq") == c("log_seq")).alias("seq_matches"))


@query("export_gate", """, g AS (SELECT *, read_status = 'OK' AND completion = 'FINISHED' AND integrity = 'OK' AND points > 0 AND gpx_exists AS whole, read_status = 'OK' AND (partial_exists OR ((points > 0 OR weaks > 0) AND log_exists)) AS part FROM manifest)
SELECT session_id, whole, part, CASE WHEN read_status <> 'OK' THEN 'UNREADABLE' WHEN completion <> 'FINISHED' THEN CASE WHEN part THEN 'PARTIAL_ONLY' ELSE 'NOT_FINISHED' END WHEN integrity <> 'OK' THEN 'INTEGRITY' WHEN points <= 0 THEN CASE WHEN part THEN 'NO_POINTS_PARTIAL' ELSE 'NO_POINTS' END WHEN NOT gpx_exists THEN 'FILE_MISSING' ELSE 'NONE' END AS why FROM g""", "manifest")
def export_gate(x):
    part = T.can_export_partial(c("read_status"), c("partial_exists"), c("points"), c("weaks"), c("log_exists"))
    return x.manifest.select("session_id", T.can_export(c("read_status"), c("completion"), c("integrity"), c("points"), c("gpx_exists")).alias("whole"), part.alias("part"), T.unavailable(c("read_status"), c("completion"), c("integrity"), c("points"), c("gpx_exists"), part).alias("why"))


@query("sampling_policy", """, s AS (SELECT session_id, decision_id, line_no, CASE WHEN decision_id % 61 = 0 THEN 'STARTING' WHEN decision_id % 37 = 0 OR reason IN ('weak_signal_stage1', 'impossible_speed', 'weak_first_fix', 'accuracy_too_large', 'first_fix_accuracy_too_large', 'invalid_accuracy', 'location_too_old') THEN 'SIGNAL_WEAK' WHEN decision_id % 47 = 0 THEN 'STARTING' WHEN decision_id % 5 = 0 THEN 'REST_PROBING' WHEN decision_id % 5 = 1 THEN 'REST_PAUSED' WHEN decision_id % 3 = 0 THEN 'PAUSED' ELSE 'MOVING' END AS state FROM decision),
i AS (SELECT *, CASE state WHEN 'STARTING' THEN 1000 WHEN 'MOVING' THEN 3000 WHEN 'SIGNAL_WEAK' THEN 2000 WHEN 'REST_PROBING' THEN 1000 ELSE 10000 END AS millis FROM s), l AS (SELECT *, lag(millis) OVER (PARTITION BY session_id ORDER BY line_no) AS before FROM i) SELECT session_id, decision_id, state, millis, before IS NULL OR before <> millis AS emitted FROM l""", "decision")
def sampling_policy(x):
    d = c("decision_id")
    rest = F.when(d % 5 == 0, "REST_PROBING").when(d % 5 == 1, "REST_PAUSED").otherwise("MOVING")
    state = T.sampling_state(d % 61 != 0, d % 37 == 0, c("reason"), F.when(d % 47 == 0, 0).otherwise(1), rest, d % 3 == 0)
    rows = x.decision.withColumn("state", state).withColumn("millis", T.sampling_interval(c("state")))
    before = F.lag("millis").over(W.partitionBy("session_id").orderBy("line_no"))
    return rows.withColumn("before", before).select("session_id", "decision_id", "state", "millis", (c("before").isNull() | (c("before") != c("millis"))).alias("emitted"))


@query("wall_labels", "SELECT session_id, strftime(make_timestamp(created * 1000), '%Y-%m-%d %H:%M') AS day, left(concat('session-', session_id, '-', created), 16) AS short FROM manifest", "manifest")
def wall_labels(x):
    return x.manifest.select("session_id", F.date_format(F.timestamp_millis("created"), "yyyy-MM-dd HH:mm").alias("day"), F.substring(F.concat(F.lit("session-"), c("session_id").cast("string"), F.lit("-"), c("created").cast("string")), 1, 16).alias("short"))


@query("nonfinite_pressure", "SELECT session_id, sample_id, CASE WHEN sample_id % 5 = 0 THEN 'NaN' WHEN sample_id % 7 = 0 THEN 'Infinity' END AS text FROM pressure", "pressure")
def nonfinite_pressure(x):
    odd = F.when(c("sample_id") % 5 == 0, float("nan")).when(c("sample_id") % 7 == 0, float("inf")).otherwise(c("hpa"))
    return x.pressure.select("session_id", "sample_id", T.pressure_text(odd).alias("text"))


@query("session_id_guard", ", t AS (SELECT session_id, CASE session_id % 5 WHEN 0 THEN concat('a/', session_id) WHEN 1 THEN '..' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE concat('s', session_id) END AS id, CASE session_id % 3 WHEN 0 THEN 'x/Session.JSON' WHEN 1 THEN 'diagnostic.jsonl' ELSE 'my_session.json' END AS path FROM manifest) SELECT session_id, session_id % 5 = 4 AS safe, CASE session_id % 3 WHEN 0 THEN 'manifest' WHEN 1 THEN 'log' END AS kind FROM t", "manifest")
def session_id_guard(x):
    k = c("session_id") % 5
    name = F.when(k == 0, F.concat(F.lit("a/"), c("session_id").cast("string"))).when(k == 1, "..").when(k == 2, "").when(k == 4, F.concat(F.lit("s"), c("session_id").cast("string")))
    path = F.when(c("session_id") % 3 == 0, "x/Session.JSON").when(c("session_id") % 3 == 1, "diagnostic.jsonl").otherwise("my_session.json")
    return x.manifest.select("session_id", T.safe_session_id(name).alias("safe"), T.import_kind(path).alias("kind"))


@query("session_exclusions", "SELECT session_id, concat_ws(',', CASE WHEN completion <> 'FINISHED' THEN 'COMPLETION' END, CASE WHEN integrity <> 'OK' THEN 'INTEGRITY' END, CASE WHEN ascent_source <> 'BAROMETER' THEN 'SOURCE' END, CASE WHEN ascent < 0 THEN 'ASCENT' END, CASE WHEN session_id % 27 = 0 THEN 'SAMPLES' END) AS reasons FROM manifest", "manifest")
def session_exclusions(x):
    from ..operators.reports import exclusions

    return x.manifest.withColumn("samples", c("session_id") % 27).select("session_id", F.array_join(exclusions(), ",").alias("reasons"))


def points(x):
    """Track points of the decisions that are no rejections, with what exports write of them."""
    from ..operators.windows import since_reset

    kept = since_reset(x.decision, c("reason").isin("gap_recovery", "transport_recovery")).where("result <> 'reject'")
    own = kept.select("session_id", "raw_id", "line_no", "decision_id", "point_id", (c("island_") + 1).alias("segment_id"), "result", "reason", "metres", "moving")
    return own.join(x.fix.drop("line_no", "seq"), ["session_id", "raw_id"]).where("lat <> 0")


PTS = """, sd AS (SELECT *, CAST(1 + sum(CASE WHEN reason IN ('gap_recovery', 'transport_recovery') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM decision),
pts AS (SELECT d.session_id, d.raw_id, d.line_no, d.decision_id, d.point_id, d.segment_id, d.result, d.reason, d.metres, d.moving, f.snap_id, f.lat, f.lng, f.acc, f.bearing, f.wall, f.t, f.alt, f.vacc FROM sd d JOIN fix f ON d.session_id = f.session_id AND d.raw_id = f.raw_id WHERE d.result <> 'reject' AND f.lat <> 0)"""


def _tag(name: str, value: str) -> str:
    return f"'<hike:{name}>' || {value} || '</hike:{name}>'"


_CELLS = {
    "sessionId": "session_id", "partial": "'false'", "trackPointId": "coalesce(point_id, 0)", "segmentId": "segment_id", "sourceRawPointId": "raw_id", "sourceDecisionId": "decision_id", "elapsedRealtimeNanos": "t", "accuracy": "coalesce(acc, 0.0::DOUBLE)", "decisionResult": "result", "decisionReason": "reason",
    "distanceDeltaMeters": "metres", "movingTimeDeltaSeconds": "moving",
}
_UTC = "'<time>' || strftime(make_timestamp(wall * 1000), '%Y-%m-%dT%H:%M:%SZ') || '</time>'"


@query("gpx_text", PTS + f""", b AS (SELECT *, CASE WHEN result = 'weak' OR coalesce(lag(result = 'weak') OVER (PARTITION BY session_id ORDER BY line_no), true) THEN 1 ELSE 0 END AS brk FROM pts),
s AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seg, '<trkpt lat="' || lat || '" lon="' || lng || '">' || coalesce('<ele>' || alt || '</ele>', '') || {_UTC} || '<extensions>' || {' || '.join(_tag(k, v) for k, v in _CELLS.items())} || coalesce({_tag('sourceGnssSnapshotId', 'snap_id')}, '') || '</extensions></trkpt>' AS p FROM b),
g AS (SELECT session_id, seg, concat('<trkseg>', string_agg(p, '' ORDER BY line_no), '</trkseg>') AS t, sum(metres) AS metres, sum(moving) AS moving, count(*) AS n, min(wall) AS wall FROM s GROUP BY 1, 2),
w AS (SELECT session_id, string_agg(t, '' ORDER BY seg) AS trk, sum(metres) AS metres, sum(moving) AS moving, CAST(sum(n) AS BIGINT) AS n, min(wall) AS wall FROM g GROUP BY 1)
SELECT session_id, md5('{gpx.HEAD}<metadata><name>Track ' || session_id || '</name>' || {_UTC} || '<extensions>' || {_tag('totalDistanceMeters', 'metres')} || {_tag('movingTimeSeconds', 'moving')} || {_tag('trackPointCount', 'n')} || {_tag('partial', "'false'")} || '</extensions></metadata><trk><name>Track</name>' || trk || '</trk></gpx>') AS gpx_md5 FROM w""", "fix decision")
def gpx_text(x):
    return gpx.written(points(x)).select("session_id", F.md5("gpx").alias("gpx_md5"))


@query("gpx_roundtrip", PTS + """, b AS (SELECT *, CASE WHEN result = 'weak' OR coalesce(lag(result = 'weak') OVER (PARTITION BY session_id ORDER BY line_no), true) THEN 1 ELSE 0 END AS brk FROM pts)
SELECT session_id, row_number() OVER o - 1 AS ord, CAST(sum(brk) OVER o AS BIGINT) AS segment, lat, lng, alt AS ele, wall FROM b WINDOW o AS (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)""", "fix decision")
def gpx_roundtrip(x):
    return gpx.read(gpx.written(points(x)))


@query("gpx_times", ", t AS (SELECT event_id, event_id % 5 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN 1704164645000 WHEN 1 THEN 1704164645250 WHEN 2 THEN 1704157445000 WHEN 3 THEN 1704157445250 ELSE 0 END AS wall FROM t", "base")
def gpx_times(x):
    k = c("event_id") % 5
    text = F.when(k == 0, "2024-01-02T03:04:05Z").when(k == 1, "2024-01-02T03:04:05.250Z").when(k == 2, "2024-01-02T03:04:05+02:00").when(k == 3, "2024-01-02T03:04:05.250+02:00").otherwise("yesterday")
    return x.table("events").select("event_id", gpx.time_millis(text).alias("wall"))


@query("polyline_roundtrip", PTS + " SELECT session_id, t, lat, lng, acc, bearing, alt, vacc, result, reason, wall FROM pts WHERE acc IS NOT NULL", "fix decision")
def polyline_roundtrip(x):
    p = points(x).withColumns({"pressure_t": F.lit(None).cast("long"), "hpa": F.lit(None).cast("double"), "baro_alt": F.lit(None).cast("double")})
    return polyline.read(polyline.written(p)).select("session_id", "t", "lat", "lng", "acc", "bearing", "alt", "vacc", "result", "reason", "wall")


@query("geojson_lines", PTS + """ SELECT session_id, len(l) AS n, l[1][1] AS first_lng, l[len(l)][2] AS last_lat FROM (SELECT session_id, list([lng, lat] ORDER BY line_no) AS l FROM pts GROUP BY 1) WHERE len(l) > 1""", "fix decision")
def geojson_lines(x):
    f = polyline.line_features(points(x), ["session_id"])
    g = F.from_json("feature", "type string, geometry struct<type: string, coordinates: array<array<double>>>")["geometry"]["coordinates"]
    rows = f.withColumn("l", g)
    return rows.select("session_id", F.size("l").cast("long").alias("n"), F.get(F.get("l", F.lit(0)), F.lit(0)).alias("first_lng"), F.element_at(F.element_at("l", -1), 2).alias("last_lat"))


def logs(x):
    """Event logs as text, a few with a bad line, a few without their header."""
    head = x.manifest.select("session_id", F.lit(1).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("session_metadata").alias("event"), F.lit(1_000_000_000).alias("createdElapsedRealtimeNanos"), F.lit(1).alias("eventSeq"))).alias("line")).where("session_id % 12 <> 0")
    fix = x.fix.select("session_id", "line_no", F.when((c("session_id") % 9 == 0) & (c("seq") == 5), '{"event": "raw_lo').otherwise(F.to_json(F.struct(
        F.lit("raw_location").alias("event"), c("line_no").alias("eventSeq"), c("raw_id").alias("rawPointId"), "provider", "lat", "lng", c("acc").alias("accuracy"), "speed", c("t").alias("elapsedRealtimeNanos"), c("recv").alias("eventElapsedRealtimeNanos"), "mock",
    ), {"ignoreNullFields": "false"})).alias("line"))
    rows = head.unionByName(fix)
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))


@query("jsonl_gates", "SELECT session_id, CASE WHEN session_id % 12 = 0 THEN 'missing_session_metadata_before_raw_location' WHEN session_id % 9 = 0 THEN 'malformed_json_line_6' END AS why FROM manifest", "manifest")
def jsonl_gates(x):
    return jsonl.replay_gates(jsonl.lines(logs(x)))


@query("jsonl_summary", """, k AS (SELECT session_id, line_no, seq FROM fix WHERE session_id % 9 <> 0 OR seq < 5)
SELECT session_id, CASE WHEN session_id % 9 = 0 THEN 'INVALID_JSONL' ELSE 'OK' END AS status, max(line_no) AS last_seq, count(*) + CASE WHEN session_id % 12 = 0 THEN 0 ELSE 1 END AS n FROM k GROUP BY session_id""", "fix")
def jsonl_summary(x):
    return jsonl.summary(jsonl.lines(logs(x)))


@query("jsonl_errors", """SELECT session_id, CAST(CASE WHEN session_id % 12 = 0 THEN 5 ELSE 6 END AS BIGINT) AS line_no, '{"event": "raw_lo' AS text FROM manifest WHERE session_id % 9 = 0""", "manifest")
def jsonl_errors(x):
    return jsonl.permissive(jsonl.lines(logs(x)))[1]


@query("jsonl_fixes", "SELECT session_id, raw_id, provider, t, recv, lat, lng, coalesce(acc, 0) AS acc, coalesce(speed, 0) AS speed, mock FROM fix WHERE NOT (session_id % 9 = 0 AND seq = 5)", "fix")
def jsonl_fixes(x):
    return jsonl.raw_locations(jsonl.lines(logs(x)), null_is_present=True).select("session_id", "raw_id", "provider", "t", "recv", "lat", "lng", "acc", "speed", "mock")


@query("jsonl_fixes_reader", "SELECT session_id, raw_id, acc, speed FROM fix WHERE session_id % 9 <> 0", "fix")
def jsonl_fixes_reader(x):
    return jsonl.raw_locations(jsonl.or_empty(jsonl.lines(logs(x))), null_is_present=False).select("session_id", "raw_id", "acc", "speed")


@query("envelope", """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS event_seq, concat('{"sessionId":"', session_id, '","eventSeq":', row_number() OVER (PARTITION BY session_id ORDER BY line_no), ',"schemaVersion":1,"eventElapsedRealtimeNanos":', t, ',"event":"session_event","eventType":"', kind, '"}') AS line FROM status""", "status")
def envelope(x):
    body = F.to_json(F.struct(F.lit("session_event").alias("event"), c("kind").alias("eventType")))
    return jsonl.with_envelope(x.status.withColumn("body", body))


@query("manifest_scan", """SELECT session_id, read_status, CASE WHEN read_status = 'OK' THEN completion ELSE '' END AS completion, CASE WHEN read_status = 'OK' THEN CAST(raws AS INTEGER) ELSE 0 END AS raws, CASE WHEN read_status = 'OK' AND session_id % 4 <> 0 THEN ascent ELSE -1 END AS ascent, CASE WHEN read_status = 'OK' THEN coalesce(brand, '') ELSE '' END AS brand FROM manifest""", "manifest")
def manifest_scan(x):
    ok = F.to_json(F.struct(c("completion").alias("completionState"), c("raws").alias("rawPointCount"), F.when(c("session_id") % 4 != 0, c("ascent")).alias("barometerTotalAscentMeters"), c("brand").alias("deviceBrand")))
    text = F.when(c("read_status") == "OK", ok).when(c("read_status") == "INVALID", "{broken")
    out = manifest.parsed(x.manifest.select("session_id", text.alias("text")))
    return out.select("session_id", "read_status", c("completionState").alias("completion"), c("rawPointCount").alias("raws"), c("barometerTotalAscentMeters").alias("ascent"), c("deviceBrand").alias("brand"))


@query("markdown_report", """, s AS (SELECT session_id // 4 AS batch, session_id, concat('| ', session_id, ' | ', model, ' | ', CASE WHEN ascent < 0 THEN '-' ELSE printf('%.1f', ascent) END, ' |') AS line FROM manifest) SELECT batch, concat('| session | device | ascent |\n| --- | --- | --- |\n', string_agg(line, '\n' ORDER BY session_id)) AS report FROM s GROUP BY 1""", "manifest")
def markdown_report(x):
    line = F.concat(F.lit("| "), c("session_id").cast("string"), F.lit(" | "), "model", F.lit(" | "), T.ascent_text(c("ascent")), F.lit(" |"))
    rows = x.manifest.select(F.expr("session_id DIV 4").alias("batch"), "session_id", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy("batch").agg(F.concat(F.lit("| session | device | ascent |\n| --- | --- | --- |\n"), body).alias("report"))


@query("latest_status", "SELECT session_id, arg_max(kind, line_no) AS kind, max(line_no) AS line_no, CASE WHEN bool_or(kind = 'finish_recording') THEN 'FINISHED' ELSE 'ACTIVE' END AS state FROM status GROUP BY 1", "status")
def latest_status(x):
    return x.status.groupBy("session_id").agg(F.max_by("kind", "line_no").alias("kind"), F.max("line_no").alias("line_no"), F.when(F.bool_or(c("kind") == "finish_recording"), "FINISHED").otherwise("ACTIVE").alias("state"))
