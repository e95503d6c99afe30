"""Queries of names, texts, ladders, records and documents: details that other queries leave out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fields as T
from ..functions import geo as G
from ..operators import reports as R
from ..operators import windows as O
from ..sources import jsonl, polyline
from . import decide as D
from .fields import PTS, logs, points
from .joins import FOLD
from .registry import query
from .windows import BARO_SQL, SAT_SQL, barometer_rows, satellite_rows
from ..operators import ascent as A

c = F.col


@query("sensor_names", "SELECT session_id, motion_id, CASE motion_id % 4 WHEN 0 THEN 'TYPE_LINEAR_ACCELERATION' WHEN 1 THEN 'TYPE_ACCELEROMETER' ELSE concat('TYPE_', motion_id % 4 + 20) END AS sensor FROM motion", "motion")
def sensor_names(x):
    k = c("motion_id") % 4
    return x.motion.select("session_id", "motion_id", T.sensor_name(F.when(k == 0, 10).when(k == 1, 1).otherwise(k + 20)).alias("sensor"))


@query("degrees_normal", "SELECT session_id, raw_id, (((raw_id * 7) % 1440 - 720 + 0.5::DOUBLE) % 360 + 360) % 360 AS degrees FROM fix", "fix")
def degrees_normal(x):
    return x.fix.select("session_id", "raw_id", G.degrees360(((c("raw_id") * 7) % 1440 - 720 + F.lit(0.5))).alias("degrees"))


@query("report_texts", """, v AS (SELECT session_id, raw_id, (raw_id % 900 - 100) / 4.0 AS s, (raw_id * 13) % 20000 - 500 AS d FROM fix), t AS (SELECT *, CAST(floor(abs(s) * 10 + 0.5) / 10 * sign(s) AS DOUBLE) AS one, CAST(floor(s / 60 * 10 + 0.5) / 10 AS DOUBLE) AS minutes FROM v)
SELECT session_id, raw_id, CASE WHEN s <= 0 THEN '0.0s' WHEN s >= 60 THEN printf('%.1fmin', minutes) ELSE printf('%.1fs', one) END AS seconds, CASE WHEN raw_id % 9 = 0 THEN '-' ELSE printf('%.1fm', one) END AS metres, CASE WHEN raw_id % 9 = 0 OR s < 0 THEN '-' ELSE printf('%.1fm', one) END AS climb,
 CASE WHEN d <= 0 THEN '-' WHEN d >= 3600 THEN concat(d // 3600, 'h ', d % 3600 // 60, 'm') WHEN d >= 60 THEN concat(d // 60, 'm ', d % 60, 's') ELSE concat(d, 's') END AS duration FROM t""", "fix")
def report_texts(x):
    s = (c("raw_id") % 900 - 100) / 4.0
    known = F.when(c("raw_id") % 9 != 0, s)
    return x.fix.select("session_id", "raw_id", T.seconds_text(s).alias("seconds"), T.metres_text(known).alias("metres"), T.climb_text(known).alias("climb"), T.long_duration_text(((c("raw_id") * 13) % 20000 - 500).cast("double")).alias("duration"))


@query("device_paths", "SELECT session_id, concat_ws(' / ', coalesce(brand, CASE WHEN session_id % 12 <> 0 THEN 'Maker' END), model, CASE WHEN session_id % 5 = 0 THEN 'my phone' END) AS path FROM manifest", "manifest")
def device_paths(x):
    return x.manifest.select("session_id", T.device_path(c("brand"), F.when(c("session_id") % 12 != 0, "Maker").otherwise(""), c("model"), F.when(c("session_id") % 5 == 0, "my phone").otherwise("")).alias("path"))


@query("event_sort_times", "SELECT session_id, e, coalesce(CASE WHEN e % 2 = 0 THEN clock END, CASE WHEN e % 3 = 0 THEN clock + 1 END, CASE WHEN e % 5 = 0 THEN clock + 2 END, CASE WHEN e % 7 = 0 THEN clock + 3 END, CASE WHEN e % 11 = 0 THEN clock + 4 END, 0) AS at FROM base", "base")
def event_sort_times(x):
    five = [F.when(c("e") % p == 0, c("clock") + k) for k, p in enumerate((2, 3, 5, 7, 11))]
    return x.base.select("session_id", "e", T.sort_time(*five).alias("at"))


_KNOWN = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')".replace("rest's", "rest''s") for k, v in T.REASONS.items())


@query("reason_explanations", f""", r AS (SELECT decision_id, CASE WHEN decision_id % 37 = 0 THEN '' WHEN decision_id % 31 = 0 THEN 'mock_location' ELSE reason END AS reason, result FROM decision)
SELECT result, reason, coalesce(title, CASE WHEN reason = '' THEN '{T.UNEXPLAINED[0]}' ELSE reason END) AS title, coalesce(meaning, '{T.UNEXPLAINED[1]}') AS meaning, count(*) AS n FROM r LEFT JOIN (VALUES {_KNOWN}) AS t(code, title, meaning) ON reason = code GROUP BY 1, 2, 3, 4""", "decision")
def reason_explanations(x):
    rows = x.decision.withColumn("reason", F.when(c("decision_id") % 37 == 0, "").when(c("decision_id") % 31 == 0, "mock_location").otherwise(c("reason")))
    table = x.spark.createDataFrame([(k, *v) for k, v in T.REASONS.items()], "code string, title string, meaning string")
    told = rows.join(F.broadcast(table), c("reason") == c("code"), "left")  # a fixed table of codes
    title = F.coalesce("title", F.coalesce(F.nullif(c("reason"), F.lit("")), F.lit(T.UNEXPLAINED[0])))
    return told.groupBy("result", "reason", title.alias("title"), F.coalesce("meaning", F.lit(T.UNEXPLAINED[1])).alias("meaning")).agg(F.count(F.lit(1)).alias("n"))


@query("reason_keys", ", k AS (SELECT session_id, decision_id, CASE decision_id % 5 WHEN 0 THEN result || ':' WHEN 1 THEN reason WHEN 2 THEN '' WHEN 3 THEN result || ':a:b' ELSE result || ':' || reason END AS k FROM decision) SELECT session_id, decision_id, coalesce(nullif(CASE WHEN contains(k, ':') THEN substr(k, instr(k, ':') + 1) ELSE k END, ''), '-') AS reason FROM k", "decision")
def reason_keys(x):
    k = c("decision_id") % 5
    key = F.when(k == 0, F.concat("result", F.lit(":"))).when(k == 1, c("reason")).when(k == 2, "").when(k == 3, F.concat("result", F.lit(":a:b"))).otherwise(F.concat_ws(":", "result", "reason"))
    return x.decision.select("session_id", "decision_id", T.reason_of(key).alias("reason"))


@query("point_kinds", """, p AS (SELECT *, CASE WHEN decision_id % 23 = 0 THEN 'transport' ELSE result END AS kind FROM decision), q AS (SELECT *, kind = 'transport' OR reason IN ('transport_suspected', 'transport_confirmed') AS travel FROM p), l AS (SELECT *, lag(travel) OVER (PARTITION BY session_id ORDER BY line_no) AS before FROM q)
SELECT session_id, decision_id, kind = 'weak' AS weak, travel, kind <> 'weak' AND NOT travel AS trusted, reason = 'transport_recovery' AS recovery, CASE WHEN before IS NOT NULL THEN before OR travel OR reason = 'transport_recovery' END AS on_ride FROM l""", "decision")
def point_kinds(x):
    o = W.partitionBy("session_id").orderBy("line_no")
    rows = x.decision.withColumn("kind", F.when(c("decision_id") % 23 == 0, "transport").otherwise(c("result")))
    rows = rows.withColumns({"k0": F.lag("kind").over(o), "r0": F.lag("reason").over(o)})
    travel, weak = T.is_travel(c("kind"), c("reason")), c("kind") == "weak"
    ride = F.when(c("k0").isNotNull(), T.travel_segment(c("k0"), c("r0"), c("kind"), c("reason")))
    return rows.select("session_id", "decision_id", weak.alias("weak"), travel.alias("travel"), (~weak & ~travel).alias("trusted"), (c("reason") == "transport_recovery").alias("recovery"), ride.alias("on_ride"))


@query("track_outcomes", """, g AS (SELECT *, read_status = 'OK' AND (partial_exists OR ((points > 0 OR weaks > 0) AND log_exists)) AS part, CASE WHEN session_id % 14 = 0 THEN 0 WHEN session_id % 14 = 1 THEN 1 ELSE points END AS pts, CASE WHEN session_id % 14 = 1 THEN 0 ELSE metres END AS far, CASE WHEN session_id % 28 = 0 THEN 0 ELSE weaks END AS weak, CASE WHEN session_id % 56 = 0 THEN 0 ELSE raws END AS raw FROM manifest)
SELECT session_id, CASE WHEN read_status <> 'OK' THEN 'UNREADABLE' WHEN completion <> 'FINISHED' THEN CASE WHEN part THEN 'INTERRUPTED_PARTIAL' ELSE 'NOT_FINISHED_LOG_ONLY' END WHEN integrity <> 'OK' THEN 'INTEGRITY_LOG_ONLY' WHEN pts <= 0 THEN CASE WHEN weak > 0 THEN 'WEAK_ONLY_PARTIAL' WHEN raw > 0 THEN 'NO_TRUSTED_POINT' ELSE 'NO_FIX' END
  WHEN pts = 1 AND far <= 0 THEN 'ANCHOR_ONLY' WHEN gpx_exists THEN 'EXPORTABLE' ELSE 'FILE_MISSING' END AS outcome,
 CASE WHEN read_status <> 'OK' THEN 'BROKEN' WHEN completion <> 'FINISHED' THEN CASE WHEN part THEN 'INTERRUPTED' ELSE 'NOT_FINISHED' END WHEN integrity <> 'OK' THEN 'CHECK' WHEN gpx_exists AND pts > 0 THEN 'EXPORTABLE' WHEN weak > 0 THEN 'WEAK' ELSE 'NO_TRACK' END AS short FROM g""", "manifest")
def track_outcomes(x):
    sid = c("session_id")
    part = T.can_export_partial(c("read_status"), c("partial_exists"), c("points"), c("weaks"), c("log_exists"))
    pts, far = F.when(sid % 14 == 0, 0).when(sid % 14 == 1, 1).otherwise(c("points")), F.when(sid % 14 == 1, 0.0).otherwise(c("metres"))
    weak, raw = F.when(sid % 28 == 0, 0).otherwise(c("weaks")), F.when(sid % 56 == 0, 0).otherwise(c("raws"))
    state = [c(n) for n in ("read_status", "completion", "integrity")]
    return x.manifest.select("session_id", T.track_outcome(*state, pts, weak, raw, far, c("gpx_exists"), part).alias("outcome"), T.track_outcome_short(*state, pts, weak, c("gpx_exists"), part).alias("short"))


@query("policy_changes", ", l AS (SELECT *, lag(min_time) OVER o AS t0, lag(min_distance) OVER o AS d0 FROM policy WINDOW o AS (PARTITION BY session_id ORDER BY line_no)) SELECT session_id, policy_id, t0 IS NULL OR t0 <> min_time OR d0 <> min_distance AS changed, concat('sampling ', state, ' ', min_time // 1000, 's/', CAST(min_distance AS BIGINT), 'm') AS label FROM l", "policy")
def policy_changes(x):
    o = W.partitionBy("session_id").orderBy("line_no")
    before = F.lag(F.struct("min_time", "min_distance")).over(o)
    label = F.concat(F.lit("sampling "), "state", F.lit(" "), F.expr("min_time DIV 1000").cast("string"), F.lit("s/"), c("min_distance").cast("long").cast("string"), F.lit("m"))
    return x.policy.withColumn("before", before).select("session_id", "policy_id", (~c("before").eqNullSafe(F.struct("min_time", "min_distance"))).alias("changed"), label.alias("label"))


@query("timeline_filters", """, i AS (SELECT session_id, decision_id AS id, 'point' AS type, result AS kind FROM decision UNION ALL SELECT session_id, event_id, 'event', NULL FROM status UNION ALL SELECT session_id, policy_id, 'policy', NULL FROM policy)
SELECT 'all' AS filter, session_id, type, id FROM i UNION ALL SELECT 'event', session_id, type, id FROM i WHERE type = 'event' UNION ALL SELECT 'trusted', session_id, type, id FROM i WHERE kind IN ('anchor', 'accept') UNION ALL SELECT kind, session_id, type, id FROM i WHERE kind IN ('weak', 'reject')""", "decision status policy")
def timeline_filters(x):
    part = lambda rows, key, kind, result: rows.select("session_id", c(key).alias("id"), F.lit(kind).alias("type"), result.cast("string").alias("kind"))
    items = part(x.decision, "decision_id", "point", c("result")).unionByName(part(x.status, "event_id", "event", F.lit(None))).unionByName(part(x.policy, "policy_id", "policy", F.lit(None)))
    mine = F.when(c("type") == "event", "event").when(c("kind").isin("anchor", "accept"), "trusted").when(c("kind").isin("weak", "reject"), c("kind"))
    shown = F.array_compact(F.array(F.lit("all"), mine))
    return items.select(F.explode(shown).alias("filter"), "session_id", "type", "id")


def snapshot_lines(x):
    """Snapshots as log lines: one in fourteen has no averages (the keys are absent), one in ten has them as null."""
    null = c("snap_id") % 10 == 0
    value = lambda col: F.when(null, "null").otherwise(F.coalesce(F.col(col), F.lit(0.0)).cast("string"))
    averages = F.when(c("all_cn0").isNull(), "").otherwise(F.concat(F.lit(',"allAvgCn0":'), value("all_cn0"), F.lit(',"top4AvgCn0":'), value("top4_cn0")))
    line = F.concat(F.lit('{"event":"gnss_snapshot","snapshotId":'), c("snap_id").cast("string"), F.lit(',"usedAvgCn0":'), c("used_cn0").cast("string"), averages, F.lit("}"))
    return x.snap.select("session_id", "line_no", line.alias("raw")).withColumn("ev", F.try_parse_json("raw"))


@query("explainable_snapshots", """, s AS (SELECT *, CASE WHEN snap_id % 10 = 0 THEN 0 ELSE all_cn0 END AS a, CASE WHEN snap_id % 10 = 0 THEN 0 ELSE top4_cn0 END AS t4 FROM snap), l AS (SELECT d.session_id, d.result, s.snap_id, s.used_cn0, s.a, s.t4 FROM decision d JOIN s ON d.session_id = s.session_id AND s.snap_id = d.snap_id AND s.all_cn0 IS NOT NULL),
g AS (SELECT session_id, 'all' AS kind, snap_id, used_cn0, a, t4 FROM s WHERE all_cn0 IS NOT NULL UNION ALL SELECT session_id, result, snap_id, used_cn0, a, t4 FROM l WHERE result IN ('weak', 'reject'))
SELECT session_id, kind, count(*) AS n, round(avg(used_cn0), 6) AS used_cn0, round(avg(a), 6) AS all_cn0, round(avg(t4), 6) AS top4_cn0 FROM g GROUP BY 1, 2""", "snap decision")
def explainable_snapshots(x):
    """Averages of the snapshots that have both averages as keys (a null among them counts as zero): of all, and of those that weak and rejected decisions name."""
    rows = snapshot_lines(x).where(jsonl.has("allAvgCn0") & jsonl.has("top4AvgCn0"))
    number = lambda path: F.coalesce(jsonl.get(path, "double"), F.lit(0.0))
    told = rows.select("session_id", jsonl.get("snapshotId", "long").alias("snap_id"), number("usedAvgCn0").alias("used_cn0"), number("allAvgCn0").alias("all_cn0"), number("top4AvgCn0").alias("top4_cn0"))
    named = x.decision.where("result IN ('weak', 'reject')").select("session_id", "snap_id", c("result").alias("kind")).join(told, ["session_id", "snap_id"])
    return told.withColumn("kind", F.lit("all")).unionByName(named).groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in ("used_cn0", "all_cn0", "top4_cn0")])


@query("log_status", """, k AS (SELECT session_id, line_no, seq FROM fix WHERE session_id % 9 <> 0 OR seq < 5), g AS (SELECT session_id, max(line_no) AS last_seq, count(*) + CASE WHEN session_id % 12 = 0 THEN 0 ELSE 1 END AS n FROM k GROUP BY session_id)
SELECT session_id, CASE WHEN session_id % 13 = 1 THEN 'MISSING' WHEN session_id % 13 = 2 THEN 'READ_ERROR' WHEN session_id % 9 = 0 THEN 'INVALID_JSONL' ELSE 'OK' END AS status, CASE WHEN session_id % 13 IN (1, 2) THEN 0 ELSE last_seq END AS last_seq, CASE WHEN session_id % 13 IN (1, 2) THEN 0 ELSE n END AS n FROM g""", "fix")
def log_status(x):
    k = c("session_id") % 13
    found = logs(x).select("session_id", F.when((k == 1) | (k == 2), None).otherwise(c("text")).alias("text"), (k != 1).alias("there"))
    return jsonl.summaries(found)


@query("log_bad_lines", """SELECT session_id, CAST(CASE WHEN session_id % 12 = 0 THEN 5 ELSE 6 END AS BIGINT) AS line_no, 'not a JSON object' AS message, '{"event": "raw_lo' AS text FROM manifest WHERE session_id % 9 = 0""", "manifest")
def log_bad_lines(x):
    return jsonl.bad_lines(jsonl.lines(logs(x)))


@query("import_choice", """, f AS (SELECT session_id // 3 AS drop, session_id, CASE session_id % 4 WHEN 0 THEN concat('a/', session_id, '/Diagnostic.JSONL') WHEN 1 THEN concat('notes', session_id, '.txt') ELSE concat('log', session_id, '.jsonl') END AS path, session_id % 5 AS size FROM manifest),
r AS (SELECT *, row_number() OVER (PARTITION BY drop ORDER BY CASE WHEN session_id % 4 = 0 THEN 0 WHEN size > 0 THEN 1 ELSE 2 END, session_id) AS rn FROM f) SELECT drop, path FROM r WHERE rn = 1""", "manifest")
def import_choice(x):
    sid = c("session_id")
    text = sid.cast("string")
    path = F.when(sid % 4 == 0, F.concat(F.lit("a/"), text, F.lit("/Diagnostic.JSONL"))).when(sid % 4 == 1, F.concat(F.lit("notes"), text, F.lit(".txt"))).otherwise(F.concat(F.lit("log"), text, F.lit(".jsonl")))
    files = x.manifest.select(F.expr("session_id DIV 3").alias("drop"), sid.alias("ord"), path.alias("path"), (sid % 5).alias("size"))
    first = F.struct(T.preferred_log(T.import_kind(c("path")), c("size")).alias("rank"), "ord", "path")
    return files.groupBy("drop").agg(F.min(first).alias("f")).select("drop", "f.path")


@query("reconciliation", """SELECT m.session_id, m.raws = coalesce(r.n, 0) AS raws_match, m.weaks = coalesce(d.weaks, 0) AS weaks_match, m.points = coalesce(d.points, 0) AS points_match, m.gaps = coalesce(d.gaps, 0) AS gaps_match FROM sample m
LEFT JOIN (SELECT session_id, count(*) AS n FROM log_fix GROUP BY 1) r USING (session_id) LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE result = 'weak') AS weaks, count(DISTINCT point_id) AS points, count(*) FILTER (WHERE reason = 'gap_recovery') AS gaps FROM log_decision GROUP BY 1) d USING (session_id)""", "sample log_fix log_decision")
def reconciliation(x):
    r = x.log_fix.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    d = x.log_decision.groupBy("session_id").agg(F.count_if(c("result") == "weak").alias("d_weaks"), F.count_distinct("point_id").alias("d_points"), F.count_if(c("reason") == "gap_recovery").alias("d_gaps"))
    same = lambda a, b: (c(a) == F.coalesce(b, F.lit(0))).alias(f"{a}_match")
    return x.sample.join(r, "session_id", "left").join(d, "session_id", "left").select("session_id", same("raws", "n"), same("weaks", "d_weaks"), same("points", "d_points"), same("gaps", "d_gaps"))


@query("session_lists", FOLD + """ SELECT session_id, 'weak' AS list, decision_id, lat, lng FROM d WHERE result = 'weak' UNION ALL SELECT session_id, 'transport', decision_id, lat, lng FROM d WHERE reason IN ('transport_suspected', 'transport_confirmed', 'transport_recovery')
UNION ALL SELECT session_id, 'trusted', decision_id, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY session_id, point_id ORDER BY decision_id DESC) AS rn FROM d WHERE point_id IS NOT NULL) WHERE rn = 1""", "fix snap motion")
def session_lists(x):
    """What a session keeps of its decisions: trusted points, weak points, and points of rides for display."""
    d = D.decide(x.fix, x.motion, x.snap)
    rides = c("reason").isin("transport_suspected", "transport_confirmed", "transport_recovery")
    trusted = (c("point_id").isNotNull()) & (c("decision_id") == F.max("decision_id").over(W.partitionBy("session_id", "point_id")))
    lists = F.array_compact(F.array(F.when(c("result") == "weak", "weak"), F.when(rides, "transport"), F.when(trusted, "trusted")))
    return d.withColumn("lists", lists).select("session_id", F.explode("lists").alias("list"), "decision_id", "lat", "lng")


@query("geojson_features", PTS + """, g AS (SELECT session_id, segment_id, count(*) AS n, list([lng, lat] ORDER BY line_no) AS l FROM pts WHERE result <> 'weak' GROUP BY 1, 2)
SELECT 'segment' AS kind, session_id, segment_id AS id, n, l[1][1] AS lng, l[len(l)][2] AS lat FROM g WHERE n > 1 UNION ALL SELECT 'point', session_id, raw_id, 1, lng, lat FROM pts""", "fix decision")
def geojson_features(x):
    p = points(x)
    shape = "type string, properties struct<segmentId: bigint, rawPointId: bigint, kind: string>, geometry struct<type: string, coordinates: array<array<double>>>"
    lines = polyline.line_features(p.where("result <> 'weak'"), ["session_id", "segment_id"], properties={"segmentId": c("segment_id")}).withColumn("f", F.from_json("feature", shape))
    l = c("f.geometry.coordinates")  # noqa: E741
    segments = lines.select(F.lit("segment").alias("kind"), "session_id", c("f.properties.segmentId").alias("id"), F.size(l).cast("long").alias("n"), F.get(F.get(l, F.lit(0)), F.lit(0)).alias("lng"), F.element_at(F.element_at(l, -1), 2).alias("lat"))
    one = polyline.point_features(p, {"rawPointId": c("raw_id"), "kind": c("result")}).withColumn("f", F.from_json("feature", shape.replace("array<array<double>>", "array<double>")))
    dots = one.select(F.lit("point").alias("kind"), "session_id", c("f.properties.rawPointId").alias("id"), F.lit(1).cast("long").alias("n"), F.get("f.geometry.coordinates", F.lit(0)).alias("lng"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))
    return segments.unionByName(dots)


@query("lifecycles", """, l AS (SELECT session_id, line_no, CASE WHEN event_id % 59 = 1 THEN 'interrupted' WHEN event_id % 71 = 0 THEN 'error:WRITE_FAILED' ELSE kind END AS kind FROM status),
s AS (SELECT session_id, arg_max(kind, line_no) FILTER (WHERE kind IN ('start_recording', 'finish_recording', 'interrupted') OR kind LIKE 'error:%') AS last, max(line_no) FILTER (WHERE kind LIKE 'error:%') AS broken, max(line_no) FILTER (WHERE kind = 'start_recording') AS started FROM l GROUP BY 1)
SELECT session_id, CASE last WHEN 'finish_recording' THEN 'FINISHED' WHEN 'interrupted' THEN 'INTERRUPTED' WHEN 'error:WRITE_FAILED' THEN 'ERROR' ELSE 'ACTIVE' END AS completion, CASE WHEN broken > coalesce(started, -1) THEN 'ERROR' ELSE 'OK' END AS integrity, coalesce(last = 'start_recording', false) AS active FROM s""", "status")
def lifecycles(x):
    kind = F.when(c("event_id") % 59 == 1, "interrupted").when(c("event_id") % 71 == 0, "error:WRITE_FAILED").otherwise(c("kind"))
    events = x.status.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", kind.alias("kind")))), lambda e: e["kind"]).alias("events"))
    return events.withColumn("s", T.lifecycle(c("events"))).select("session_id", "s.completion", "s.integrity", "s.active")


STATUS = BARO_SQL + SAT_SQL + """, lf AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC) AS rn FROM fix), lp AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC) AS rn FROM pressure WHERE hpa > 0),
ls AS (SELECT session_id, arg_max(kind, line_no) AS text, bool_or(kind = 'finish_recording') AS finished FROM status GROUP BY 1), dd AS (SELECT session_id, count(DISTINCT point_id) AS track_points, sum(metres) AS metres FROM decision GROUP BY 1), ff AS (SELECT session_id, count(*) AS raw_points FROM fix GROUP BY 1), pp AS (SELECT session_id, count(*) FILTER (WHERE hpa > 0) AS pressures FROM pressure GROUP BY 1)
SELECT m.session_id, NOT coalesce(ls.finished, false) AS active, coalesce(ls.finished, false) AS finished, raw_points, track_points, metres AS total_metres, round(CASE WHEN b.ascent >= 0 THEN b.ascent WHEN s.ascent >= 0 THEN s.ascent ELSE -1 END, 6) AS ascent, round(coalesce(b.ascent, -1), 6) AS baro_ascent, round(coalesce(s.ascent, -1), 6) AS gnss_ascent,
 coalesce(b.n, 0) AS baro_n, coalesce(s.n, 0) AS gnss_n, coalesce(b.rejected, 0) AS baro_rejected, coalesce(s.rejected, 0) AS gnss_rejected, CASE WHEN b.ascent >= 0 THEN 'BAROMETER' WHEN s.ascent >= 0 THEN 'GNSS' ELSE 'NONE' END AS source, coalesce(pressures, 0) > 0 AS has_pressure, coalesce(pressures, 0) AS pressures, lp.alt AS raw_baro_alt, ls.text,
 lf.lat, lf.lng, coalesce(lf.acc, -1) AS acc, lf.speed IS NOT NULL AS has_speed, coalesce(lf.speed, -1) AS speed, lf.bearing IS NOT NULL AS has_bearing, coalesce(lf.bearing, -1) AS bearing FROM (SELECT m.session_id FROM manifest m) m
LEFT JOIN ls USING (session_id) LEFT JOIN dd USING (session_id) LEFT JOIN ff USING (session_id) LEFT JOIN pp USING (session_id) LEFT JOIN baro b USING (session_id) LEFT JOIN sat_ s USING (session_id) LEFT JOIN lf ON lf.session_id = m.session_id AND lf.rn = 1 LEFT JOIN lp ON lp.session_id = m.session_id AND lp.rn = 1"""


@query("status_record", STATUS, "fix pressure status decision manifest")
def status_record(x):
    """The flat record of each session's latest state that a recorder announces."""
    last = lambda rows, names: F.max_by(F.struct(*names), "line_no")
    fix = x.fix.groupBy("session_id").agg(F.count(F.lit(1)).alias("raw_points"), last(x.fix, ["lat", "lng", "acc", "speed", "bearing"]).alias("f"))
    sound = x.pressure.where(G.sound_pressure(c("hpa"))).groupBy("session_id").agg(F.count(F.lit(1)).alias("pressures"), F.max_by("alt", "line_no").alias("raw_baro_alt"))
    told = x.status.groupBy("session_id").agg(F.max_by("kind", "line_no").alias("text"), F.bool_or(c("kind") == "finish_recording").alias("finished"))
    made = x.decision.groupBy("session_id").agg(F.count_distinct("point_id").alias("track_points"), F.sum("metres").alias("total_metres"))
    baro, sat = A.fold(barometer_rows(x), A.BAROMETER, A.BAROMETER_GAP), A.fold(satellite_rows(x), A.SATELLITE)
    both = A.selected(baro, sat)
    named = lambda rows, k: rows.select("session_id", *[c(n).alias(f"{k}_{n}") for n in ("ascent", "n", "rejected")])
    out = x.manifest.select("session_id")
    for rows in (fix, sound, told, made, named(baro, "baro"), named(sat, "gnss"), both):
        out = out.join(rows, "session_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    done = F.coalesce("finished", F.lit(False))
    r6 = lambda n: F.round(F.coalesce(n, F.lit(-1.0)), 6).alias(n)
    less = lambda n: F.coalesce(c(f"f.{n}"), F.lit(-1.0)).alias(n)
    return out.select("session_id", (~done).alias("active"), done.alias("finished"), "raw_points", "track_points", "total_metres", r6("ascent"), r6("baro_ascent"), r6("gnss_ascent"), zero("baro_n"), zero("gnss_n"), zero("baro_rejected"), zero("gnss_rejected"),
                      F.coalesce("source", F.lit("NONE")).alias("source"), (F.coalesce("pressures", F.lit(0)) > 0).alias("has_pressure"), zero("pressures"), "raw_baro_alt", "text", "f.lat", "f.lng", less("acc"), c("f.speed").isNotNull().alias("has_speed"), less("speed"), c("f.bearing").isNotNull().alias("has_bearing"), less("bearing"))


@query("tile_budget", """, t AS (SELECT session_id, raw_id, row_number() OVER (PARTITION BY session_id ORDER BY (raw_id * 31) % 997, raw_id) AS rn FROM fix) SELECT session_id, raw_id, rn AS pos FROM t WHERE rn <= greatest(0, least(6, 18 - session_id % 21))""", "fix")
def tile_budget(x):
    """The tiles that a drawing may ask for: the most urgent ones, six at most, eighteen with those that are being loaded."""
    active = c("session_id") % 21
    rows = x.fix.select("session_id", "raw_id", ((c("raw_id") * 31) % 997).alias("priority"), active.alias("active"))
    return O.requested(rows, "priority", "raw_id").select("session_id", "raw_id", "pos")


@query("map_status", """, p AS (SELECT d.session_id, d.line_no, d.decision_id, d.metres, f.lat, f.lng, coalesce(f.acc, 0) AS acc, f.bearing, f.speed, d.result <> 'weak' AND d.reason NOT IN ('transport_suspected', 'transport_confirmed') AS trusted FROM decision d JOIN fix f ON d.session_id = f.session_id AND d.raw_id = f.raw_id WHERE d.point_id IS NOT NULL OR d.result = 'weak'),
t AS (SELECT *, lag(lat) OVER o AS pla, lag(lng) OVER o AS pln, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC) AS rn FROM p WHERE trusted WINDOW o AS (PARTITION BY session_id ORDER BY line_no)), h AS (SELECT *, power(sin(radians(lat - pla) / 2), 2) + cos(radians(pla)) * cos(radians(lat)) * power(sin(radians(lng - pln) / 2), 2) AS a FROM t WHERE rn = 1),
s AS (SELECT session_id, sum(metres) AS own FROM p GROUP BY 1)
SELECT s.session_id, h.decision_id AS last_trusted, greatest(0, h.acc) AS acc, coalesce(m.metres, own) AS metres, CASE WHEN m.ascent >= 0 THEN m.ascent ELSE -1 END AS ascent,
 CASE WHEN h.bearing IS NOT NULL AND h.speed >= 0.8 THEN 'gnss' WHEN 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) >= 5 THEN 'track' ELSE 'none' END AS heading FROM s LEFT JOIN h USING (session_id) LEFT JOIN (SELECT * FROM manifest WHERE read_status = 'OK') m USING (session_id)""", "fix decision manifest")
def map_status(x):
    """The map's state of a session: last trusted point, its accuracy, distance, ascent, and which heading holds there."""
    rows = x.decision.where("point_id IS NOT NULL OR result = 'weak'").select("session_id", "line_no", "decision_id", "raw_id", "metres", "result", "reason").join(x.fix.select("session_id", "raw_id", "lat", "lng", "acc", "bearing", "speed"), ["session_id", "raw_id"])
    own = rows.groupBy("session_id").agg(F.sum("metres").alias("own"))
    o = W.partitionBy("session_id").orderBy("line_no")
    trusted = rows.where((c("result") != "weak") & ~T.is_travel(c("result"), c("reason"))).withColumns({"pla": F.lag("lat").over(o), "pln": F.lag("lng").over(o)})
    last = trusted.groupBy("session_id").agg(F.max_by(F.struct("decision_id", "lat", "lng", "acc", "bearing", "speed", "pla", "pln"), "line_no").alias("p"))
    m = x.manifest.where("read_status = 'OK'").select("session_id", c("metres").alias("told"), F.when(c("ascent") >= 0, c("ascent")).alias("climbed"))
    far = G.haversine(c("p.pla"), c("p.pln"), c("p.lat"), c("p.lng"))
    heading = F.when(c("p.bearing").isNotNull() & (c("p.speed") >= 0.8), "gnss").when(far >= O.HEADING_METRES, "track").otherwise("none")
    return own.join(last, "session_id", "left").join(m, "session_id", "left").select("session_id", c("p.decision_id").alias("last_trusted"), F.greatest(F.lit(0.0), F.when(c("p").isNotNull(), F.coalesce("p.acc", F.lit(0.0)))).alias("acc"), F.coalesce("told", "own").alias("metres"), F.coalesce("climbed", F.lit(-1.0)).alias("ascent"), heading.alias("heading"))


@query("heading_spread", """, s AS (SELECT session_id, raw_id, seq * 700000000 AS t, bearing AS heading FROM fix), w AS (SELECT *, avg(cos(radians(heading))) OVER o AS c, avg(sin(radians(heading))) OVER o AS sn FROM s WINDOW o AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 3000000000 PRECEDING AND CURRENT ROW))
SELECT session_id, raw_id, round(CASE WHEN sqrt(c * c + sn * sn) >= 1 THEN 0 ELSE degrees(sqrt(-2 * ln(greatest(sqrt(c * c + sn * sn), 1e-12)))) END, 3) AS spread FROM w""", "fix")
def heading_spread(x):
    s = x.fix.select("session_id", "raw_id", (c("seq") * 700_000_000).alias("t"), c("bearing").alias("heading"), F.lit(40.0).alias("field"), F.lit(0.0).alias("gyro"), F.lit(True).alias("accurate"), F.lit(0).alias("late"))
    return O.heading_reliability(s).select("session_id", "raw_id", F.round("spread", 3).alias("spread"))


@query("acceptance_report", """, s AS (SELECT session_id // 4 AS batch, session_id, CASE WHEN completion = 'FINISHED' AND integrity = 'OK' AND ascent_source = 'BAROMETER' AND ascent >= 0 AND session_id % 27 > 0 THEN 1 ELSE 0 END AS ok, coalesce(brand || ' ', '') || model AS label, ascent_source, CASE WHEN ascent < 0 THEN '-' ELSE printf('%.1fm', ascent) END AS climb FROM manifest)
SELECT batch, CAST(sum(ok) AS BIGINT) AS valid_n, string_agg('| ' || label || ' | ' || session_id || ' | ' || ascent_source || ' | ' || climb || ' |', chr(10) ORDER BY session_id) AS lines FROM s GROUP BY 1""", "manifest")
def acceptance_report(x):
    """Device lines of the acceptance report of each batch; sinks.acceptance_markdown() makes the whole document."""
    devices, _ = R.consistency(x.manifest.withColumns({"batch": F.expr("session_id DIV 4"), "samples": c("session_id") % 27}))
    line = F.concat(F.lit("| "), T.device_label(c("brand"), c("model"), F.lit(None), F.lit(None)), F.lit(" | "), c("session_id").cast("string"), F.lit(" | "), "ascent_source", F.lit(" | "), T.climb_text(c("ascent")), F.lit(" |"))
    return devices.withColumn("line", line).groupBy("batch").agg(F.count_if("valid").alias("valid_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "line"))), lambda r: r["line"]), "\n").alias("lines"))
