"""Exports: what is written, and what keeps a track from being written."""

import glob
import json
import re

from pyspark.sql import functions as F

from wayfold.operators import joins, reports
from wayfold.plans import scenario
from wayfold.plans.reports import linked
from wayfold.plans.fields import points
from wayfold.plans.catalogue import QUERIES
from wayfold.plans.registry import Inputs
from wayfold.sources import gpx, manifest, sinks

SF = "/root/testdata/sf0.001"
COLS = "session_id long, ord long, point_id long, raw_id long, decision_id long, result string, reason string"


def test_export_errors_in_order(spark):
    good = [(k, k, k) for k in (1, 2, 3)]
    cases = {1: good, 2: [(1, 1, 1), (3, 2, 2)], 3: [(1, 9, 1)], 4: [(1, 1, 99)], 5: [(1, 1, 2), (2, 2, 2)], 6: [(1, 1, 3), (2, 2, 2)], 7: [(1, 0, 1), (5, 1, 1)]}
    rows = [(s, i, p, r, d, "accept", "moving_good_fix") for s, ps in cases.items() for i, (p, r, d) in enumerate(ps)]
    rows += [(8, 0, 1, 1, 1, "weak", "x"), (9, 0, 1, 1, 1, "anchor", ""), (10, 0, 1, 1, 1, "anchor", None)]
    df = spark.createDataFrame(rows, COLS)
    from pyspark.sql import functions as F

    got = {r.session_id: r.error for r in sinks.export_error(df, F.lit(5), F.lit(5)).collect()}
    assert got == {1: None, 2: "POINT_ID", 3: "RAW_ID", 4: "DECISION_ID", 5: "REPEATED", 6: "ORDER", 7: "RAW_ID", 8: "RESULT", 9: "REASON", 10: "REASON"}
    accepted = spark.createDataFrame([(1, 1), (1, 2)], "session_id long, decision_id long")
    assert {r.session_id: r.error for r in sinks.export_error(df.where("session_id = 1"), F.lit(5), F.lit(5), accepted).collect()} == {1: "NOT_ACCEPTED"}


def test_tracks_reports_and_logs_are_written(spark, tmp_path):
    x = Inputs(spark, SF)
    errors = QUERIES["trusted_export_error"](spark, SF)
    sinks.write_tracks(points(x), errors, f"{tmp_path}/gpx")
    fine = {r.session_id for r in errors.where("error IS NULL").collect()}
    files = {kind: {int(f.split("session_id=")[1].split("/")[0]): open(f).read() for f in glob.glob(f"{tmp_path}/gpx/{kind}/*/*.txt")} for kind in ("trusted", "partial")}
    assert set(files["trusted"]) == fine and len(files["partial"]) == 15
    for kind, texts in files.items():
        for sid, text in texts.items():
            assert len(gpx.parse(text)) == text.count("<trkpt") == int(re.search("<hike:trackPointCount>(\\d+)<", text)[1]) and f"<hike:partial>{str(kind == 'partial').lower()}<" in text
            assert all(f"<hike:{name}>" in text for name in gpx.POINT_FIELDS)
    weak = reports.weak_signal(linked(x), x.fix, joins.gap_windows(x.decision, x.snap), x.status)
    sinks.write_reports(weak, f"{tmp_path}/report", "Weak signal", sinks.WEAK_SECTIONS)
    rows = [json.loads(line) for f in glob.glob(f"{tmp_path}/report/json/*.json") for line in open(f)]
    assert len(rows) == 15 and all("findings" in r for r in rows)
    assert sum(open(f).read().count("# Weak signal") for f in glob.glob(f"{tmp_path}/report/text/*.txt")) == 15
    from pyspark.sql import functions as F

    status = scenario.relation(spark, SF, "status").withColumn("body", F.to_json(F.struct(F.col("kind").alias("eventType"))))
    sinks.append_events(status, f"{tmp_path}/log")
    lines = [json.loads(line) for f in glob.glob(f"{tmp_path}/log/*.txt") for line in open(f)]
    assert len(lines) == status.count() and {"sessionId", "eventSeq", "schemaVersion", "eventElapsedRealtimeNanos", "eventType"} == set(lines[0])
    manifest.write(scenario.relation(spark, SF, "manifest"), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 15
    (tmp_path / "s" / "one").mkdir(parents=True)
    (tmp_path / "s" / "one" / "session.json").write_text('{"completionState": "FINISHED"}')
    assert [(r.session_id, r.completionState) for r in manifest.listed(spark, f"{tmp_path}/s").collect()] == [("one", "FINISHED")]


def test_weak_report_of_sessions_without_fixes(spark):
    x = Inputs(spark, SF)
    d = linked(x).where("session_id = 1").withColumn("session_id", F.lit(77).cast("long"))
    late = x.status.where("kind = 'no_location_timeout'").limit(1).withColumn("session_id", F.lit(78).cast("long"))
    out = {r.session_id: r for r in reports.weak_signal(d, x.fix.where("session_id = 2"), joins.gap_windows(x.decision, x.snap).limit(0), late).collect()}
    assert set(out) == {2, 77, 78} and out[77].raw_n == 0 and out[77].weak_n > 0 and out[78].timeout_n == 1 and out[2].findings == ["NONE"] or "STALE_RATIO" in out[2].findings


def test_replay_and_batch_reports_as_json(spark, tmp_path):
    from test_sources import A, HEAD, raw

    from wayfold.sources import jsonl

    logs = {"b.jsonl": [HEAD, raw(1, 0, 10, 2, *A), raw(2, 0.00018, 3, 12, "weak", "no")], "a.jsonl": [HEAD, raw(1, 0, 10, 2, *A)], "c.jsonl": [{"event": "x"}]}
    for name, events in logs.items():
        (tmp_path / name).write_text("\n".join(json.dumps(e) for e in events))
    found = jsonl.batch(spark, str(tmp_path))
    names = {r.session_id: r.file_name for r in found.select("session_id", "file_name").collect()}
    assert names == {1: "a.jsonl", 2: "b.jsonl", 3: "c.jsonl"}
    out = jsonl.replay_reports(found)
    one = {r.session_id: json.loads(r.json) for r in sinks.replay_json(out, jsonl.replay(found)).collect()}
    assert (one[1]["status"], one[1]["mismatchCount"], one[1]["decisions"][0]["matchesExpectation"]) == ("EXACT", 0, True)
    assert (one[2]["status"], one[2]["decisionCount"], [d["matchesExpectation"] for d in one[2]["decisions"]]) == ("BEST_EFFORT", 2, [True, False])
    assert (one[3]["status"], one[3]["invalidReason"], one[3]["decisions"]) == ("INVALID_LOG", "no_raw_location_events", [])
    batch = json.loads(sinks.replay_batch_json(out.join(found.select("session_id", "file_name"), "session_id")).first().json)
    assert (batch["totalCount"], batch["exactCount"], batch["bestEffortCount"], batch["invalidLogCount"]) == (3, 1, 1, 1)
    assert [i["inputFileName"] for i in batch["items"]] == ["a.jsonl", "b.jsonl", "c.jsonl"]
    assert {r.status: r.n for r in jsonl.replay_batch(out).collect()} == {"EXACT": 1, "BEST_EFFORT": 1, "INVALID_LOG": 1}


def test_sample_report_sections_and_acceptance_markdown(spark, tmp_path):
    x = Inputs(spark, SF)
    counts = reports.sample_counts(x.log_fix, x.log_decision, x.policy, x.status, x.snap, x.motion)
    made = reports.sample_verdict(x.sample.join(counts, "session_id", "left").fillna(0))
    text = {r.session_id: r.text for r in sinks.sectioned(made, "Sample report", sinks.SAMPLE_SECTIONS).collect()}
    assert len(text) == made.count() and all(t.startswith("# Sample report\n\nsessionId=") and "\n## Verdict\n- verdict=" in t for t in text.values())
    devices, batches = reports.consistency(x.manifest.withColumns({"batch": F.expr("session_id DIV 4"), "samples": F.col("session_id") % 27}))
    done = {r.batch: r.report for r in sinks.acceptance_markdown(devices, batches).collect()}
    assert set(done) == {r.batch for r in batches.collect()}
    for b, report in done.items():
        assert report.count("\n| ") == 2 + devices.where(F.col("batch") == b).count() and "- Verdict: " in report


def test_geojson_collections(spark):
    from wayfold.sources import polyline

    p = spark.createDataFrame([(1, 1, 106.0, 29.0, "accept"), (1, 2, 106.1, 29.1, "weak"), (2, 1, 107.0, 30.0, "accept")], "session_id long, line_no long, lng double, lat double, result string")
    dots = {r.session_id: json.loads(r.collection) for r in polyline.collection(polyline.point_features(p, {"kind": F.col("result")}), ["session_id"]).collect()}
    assert [f["properties"]["kind"] for f in dots[1]["features"]] == ["accept", "weak"] and dots[2]["features"][0]["geometry"] == {"type": "Point", "coordinates": [107.0, 30.0]}
    lines = [json.loads(r.feature) for r in polyline.line_features(p, ["session_id"]).collect()]
    assert [f["geometry"]["coordinates"] for f in lines] == [[[106.0, 29.0], [106.1, 29.1]]]


def test_clean_up_of_interrupted_writes(spark, tmp_path):
    folder = tmp_path / "one"
    folder.mkdir()
    for name in (*manifest.TEMPORARY[:2], "session.json", "notes.tmp"):
        (folder / name).write_text("x")
    assert manifest.clean_up(spark, str(tmp_path), "one") == 2 and manifest.clean_up(spark, str(tmp_path), "one") == 0
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["notes.tmp", "session.json"]
