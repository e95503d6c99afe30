"""Event logs, replay conformance, manifests, GPX, polylines."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.operators import ascent, reports
from wayfold.sources import gpx, jsonl, manifest, polyline

S = 1_000_000_000
HEAD = {"event": "session_metadata", "createdElapsedRealtimeNanos": S}


def raw(k, dlat, acc, t, result=None, reason=None, **more):
    row = {"event": "raw_location", "rawPointId": k, "lat": 29.0 + dlat, "lng": 106.0, "accuracy": acc, "elapsedRealtimeNanos": int(t * S)} | more
    return row | ({"expectedResult": result, "expectedReason": reason} if result else {})


def still(t0, t1, n):
    return {"event": "motion_summary", "motionSummaryId": 1, "firstElapsedRealtimeNanos": int(t0 * S), "lastElapsedRealtimeNanos": int(t1 * S), "sampleCount": n, "dynamicAccelRmsMps2": 0.05, "stillScore": 0.83, "isDeviceStill": True}


A = ("anchor", "first_fix_good")
LOGS = {
    "good_walk": ([HEAD, raw(1, 0, 10, 2, *A), raw(2, 0.00018, 3, 12, "accept", "moving_good_fix")], "EXACT", None),
    "weak_signal": ([HEAD, raw(1, 0, 10, 2, *A), raw(2, 0.00018, 31, 12, "weak", "weak_signal_stage1")], "EXACT", None),
    "forced": ([HEAD, {"event": "config_snapshot", "forcedWeakFirstFixEnabled": True}, raw(1, 0, 45, 2, "anchor", "forced_weak_first_fix")], "EXACT", None),
    "impossible": ([HEAD, raw(1, 0, 10, 2, *A), raw(2, 0.01, 5, 3, "reject", "impossible_speed")], "EXACT", None),
    "stationary": ([HEAD, raw(1, 0, 10, 2, *A), raw(2, 1e-6, 10, 3, "reject", "stationary_accel_supported_jitter"), raw(3, 2e-6, 10, 4, "reject", "stationary_accel_supported_jitter")], "EXACT", None),
    "gap": ([HEAD, raw(1, 0, 20, 2, *A, speed=0), raw(2, 0.001, 10, 130, "accept", "gap_recovery", speed=0)], "EXACT", None),
    "refined": ([HEAD, raw(1, 0, 20, 2, *A, speed=0), raw(2, 0.00002, 8, 130, "anchor", "stationary_anchor_refined", speed=0)], "EXACT", None),
    "refined_motion": ([HEAD, raw(1, 0, 20, 2, *A, speed=0), still(7, 8.5, 6), still(9, 11, 6), raw(2, 0.00008, 3, 12, "anchor", "stationary_anchor_refined", speed=0)], "EXACT", None),
    "blocked": ([HEAD, raw(1, 0, 5, 2, *A, speed=0), still(7, 8.5, 12), still(9, 10.5, 12), raw(2, 0.000005, 5, 10, "reject", "rest_candidate", speed=0), still(30, 31.5, 12), raw(3, 0.000006, 5, 31, "reject", "rest_paused_keepalive", speed=0), still(32, 33.5, 12), raw(4, 0.00025, 5, 34, "reject", "stationary_motion_blocked_recovery", speed=1.0)], "EXACT", None),
    "transport": ([HEAD, raw(1, 0, 10, 2, *A), raw(2, 0.0007, 5, 22, "reject", "transport_suspected"), raw(3, 0.0014, 5, 32, "reject", "transport_confirmed"), raw(4, 0.0016, 5, 48, "accept", "transport_recovery")], "EXACT", None),
    "validation": ([HEAD, raw(1, 0, 5, 2, "reject", "provider_not_gps", provider="network"), raw(2, 0, 5, 2, "reject", "missing_elapsed_realtime", hasElapsedRealtimeNanos=False), {**raw(3, 0, 5, 2, "reject", "before_record_start"), "elapsedRealtimeNanos": -1},
                    raw(4, 0, 5, 2, "reject", "location_too_old", eventElapsedRealtimeNanos=33 * S + 1)], "EXACT", None),
    "null_speed": ([HEAD, raw(1, 0, 10, 2, *A, speed=None), raw(2, 0.00018, 3, 12, "accept", "moving_good_fix", speed=None)], "EXACT", None),
    "unexpected": ([HEAD, raw(1, 0, 10, 2, "weak", "weak_first_fix")], "BEST_EFFORT", None),
    "malformed": ([HEAD, raw(1, 0, 10, 2), "{bad", raw(2, 0, 10, 3)], "INVALID_LOG", "malformed_json_line_3"),
    "truncated": ([HEAD, raw(1, 0, 10, 2), '{"event": "raw_loc'], "INVALID_LOG", "malformed_json_line_3"),
    "no_header": ([raw(1, 0, 10, 2), "{bad"], "INVALID_LOG", "missing_session_metadata_before_raw_location"),
    "no_fix": ([HEAD, {"event": "session_event"}], "INVALID_LOG", "no_raw_location_events"),
}


def test_replay_of_the_scenarios(spark, tmp_path):
    for name, (events, *_) in LOGS.items():
        lines = [e if isinstance(e, str) else json.dumps(e) for e in events]
        (tmp_path / f"{name}.jsonl").write_text("\r\n".join(lines) + "\n")
    logs = jsonl.files(spark, f"{tmp_path}/*.jsonl").withColumn("name", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))
    names = {k: i for i, k in enumerate(LOGS)}
    ids = F.coalesce(*[F.when(F.col("name") == k, F.lit(i)) for k, i in names.items()]).cast("long")
    out = {r.session_id: r for r in jsonl.replay_reports(logs.withColumn("session_id", ids)).collect()}
    assert {k: (out[i].status, out[i].why) for k, i in names.items()} == {k: (s, w) for k, (_, s, w) in LOGS.items()}


def test_lines_and_policies(spark):
    logs = spark.createDataFrame([(1, '\n{"event":"a","eventSeq":4}\r\n   \n{"event":"b","eventSeq":9,"speed":null}\nnope\n{"event":"c","eventSeq":10}'), (2, ""), (3, None)], "session_id long, text string")
    rows = jsonl.lines(logs)
    assert [(r.line_no, r.ev is None) for r in rows.orderBy("line_no").collect()] == [(2, False), (4, False), (5, True), (6, False)]
    assert [tuple(r) for r in jsonl.summary(rows).collect()] == [(1, "INVALID_JSONL", 9, 2)]
    good, bad = jsonl.permissive(rows)
    assert good.count() == 3 and [tuple(r) for r in bad.collect()] == [(1, 5, "nope")]
    assert jsonl.or_empty(rows).count() == 0
    with pytest.raises(Exception, match="bad line 5"):
        jsonl.strict(rows).collect()
    seen = rows.select(jsonl.present("speed", "double", True, 0.0).alias("a"), jsonl.present("speed", "double", False, 0.0).alias("b"), "line_no").where("line_no = 4").first()
    assert (seen.a, seen.b) == (0.0, None)


GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"/><trk><trkseg><trkpt lat="29.1" lon="106.1"><ele>5.5</ele><time>2024-01-02T03:04:05Z</time></trkpt><trkpt lat="x" lon="1"/><trkpt lat="0" lon="0"/></trkseg>
<trkseg></trkseg><trkseg><trkpt lat="29.2" lon="106.2"><time>2024-01-02T03:04:05.500+01:00</time></trkpt></trkseg></trk><rte><rtept lat="3" lon="4"/></rte></gpx>"""


def test_gpx(spark):
    nested = "<gpx><trk><trkseg><extensions><trkpt lat='5' lon='6'><x><time> 2024-01-02T03:04:05Z\n</time></x></trkpt></extensions></trkseg></trk></gpx>"
    rows = [(6, nested), (1, GPX), (2, "<gpx><wpt lat='1' lon='2'/></gpx>"), (3, "not xml"), (4, "<!DOCTYPE gpx><gpx><wpt lat='1' lon='2'/></gpx>"), (5, None)]
    out = gpx.read(spark.createDataFrame(rows, "session_id long, gpx string")).orderBy("session_id", "ord").collect()
    assert [(r.session_id, r.segment, r.lat, r.lng, r.ele, r.wall) for r in out] == [
        (1, 1, 29.1, 106.1, 5.5, 1704164645000), (1, 2, 29.2, 106.2, None, 1704161045500), (1, 3, 3.0, 4.0, None, 0), (2, 1, 1.0, 2.0, None, 0), (6, 1, 5.0, 6.0, None, 1704164645000)]
    assert spark.range(1).select(gpx.escape(F.lit("<a & 'b\">"))).first()[0] == "&lt;a &amp; &apos;b&quot;&gt;"


def test_polyline_tolerates_short_and_bad_rows(spark):
    text = "29.1,106.1,5.0,-1.0,1000;29.2,106.2,5.0,90.0,2000,7,weak,12.5,some,3.0,4,960.5,400.0;bad,106,5,1,1;1,2,3"
    out = polyline.read(spark.createDataFrame([(1, text), (2, "")], "session_id long, polyline string")).orderBy("lat").collect()
    assert [(r.lat, r.bearing, r.t, r.result, r.alt, r.reason, r.hpa) for r in out] == [(29.1, None, 0, "accept", None, "foreground_live", None), (29.2, 90.0, 7, "weak", 12.5, "some", 960.5)]


def test_manifest_defaults(spark):
    rows = [(1, '{"completionState":"FINISHED","rawPointCount":7}'), (2, "{x"), (3, None), (4, "[1]")]
    out = {r.session_id: r for r in manifest.parsed(spark.createDataFrame(rows, "session_id long, text string")).collect()}
    assert [out[i].read_status for i in (1, 2, 3, 4)] == ["OK", "INVALID", "MISSING", "INVALID"]
    assert (out[1].rawPointCount, out[1].barometerTotalAscentMeters, out[1].selectedAscentSource) == (7, -1.0, "NONE")


def samples(spark, rows):
    return spark.createDataFrame([(1, k, int(t * S), float(alt), float(vacc), reset, bad) for k, (t, alt, vacc, reset, bad) in enumerate(rows)], "session_id long, ord long, t long, alt double, vacc double, reset boolean, bad boolean")


def test_ascent_numbers(spark):
    one = lambda rows, source, gap=None: ascent.fold(samples(spark, rows), source, gap).first()
    assert one([(1, 100, 5, True, False), (101, 140, 5, False, False)], ascent.SATELLITE).ascent == pytest.approx(6.0)
    assert one([(1, 100, 0, True, False), (11, 110, 0, False, False)], ascent.BAROMETER).ascent == pytest.approx(3.5)
    assert one([(1, 100, 0, False, False)], ascent.BAROMETER).ascent == -1.0
    r = one([(1, 100, 0, False, False), (2, 400, 0, False, False), (3, 100, 0, False, True), (2.5, 101, 0, False, False)], ascent.BAROMETER)
    assert (r.n, r.rejected) == (2, 2)
    assert one([(1, 100, 0, False, False), (40, 130, 0, False, False)], ascent.BAROMETER, ascent.BAROMETER_GAP).ascent == 0.0


def test_consistency_verdicts(spark):
    def batch(b, *devices):
        return [(b, k, "FINISHED", "OK", "BAROMETER", float(a), 50, brand, model) for k, (brand, model, a) in enumerate(devices)]

    rows = batch(1, ("X", "m", 500), ("X", "m", 540), ("X", "m", 520)) + batch(2, ("X", "m", 500), ("Y", "n", 660)) + batch(3, ("X", "m", 500), ("X", "n", 560)) + batch(4, ("X", "m", 40), ("Y", "n", 52)) + batch(5, ("X", "m", 500))
    df = spark.createDataFrame(rows, "batch long, session_id long, completion string, integrity string, ascent_source string, ascent double, samples int, brand string, model string")
    devices, batches = reports.consistency(df)
    assert {r.batch: (r.device_group, r.verdict) for r in batches.collect()} == {
        1: ("same-model", "PASS"), 2: ("cross-brand-same-algorithm", "REVIEW"), 3: ("same-brand", "PASS"), 4: ("cross-brand-same-algorithm", "PASS"), 5: ("same-model", "FAIL")}
    assert devices.count() == len(rows)
