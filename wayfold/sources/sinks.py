"""Writing what sessions export: tracks, reports and acceptance lists. Spark's commit makes writes whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import gpx


def export_error(points: DataFrame, raw_count: Column, decision_count: Column, accepted: DataFrame | None = None) -> DataFrame:
    """session_id, error: the first thing wrong with a trusted track, in the order of its points; null if nothing is.

    points: session_id, ord, point_id, raw_id, decision_id, result, reason. accepted: session_id, decision_id
    of accepted decisions.
    """
    o = W.partitionBy("session_id").orderBy("ord")
    rows = points.withColumns({"rn": F.row_number().over(o), "before": F.max("decision_id").over(o.rowsBetween(W.unboundedPreceding, -1)), "raws": raw_count, "decisions": decision_count})
    if accepted is not None:
        known = accepted.select(F.col("session_id").alias("a_session"), F.col("decision_id").alias("a_decision")).distinct()
        rows = rows.join(known, (F.col("session_id") == F.col("a_session")) & (F.col("decision_id") == F.col("a_decision")), "left")
        stray = F.col("a_decision").isNull()
    else:
        stray = F.lit(False)
    c = F.col
    error = (
        F.when(c("point_id") != c("rn"), "POINT_ID").when((c("raw_id") <= 0) | (c("raw_id") > c("raws")), "RAW_ID").when((c("decision_id") <= 0) | (c("decision_id") > c("decisions")), "DECISION_ID")
        .when(c("decision_id") == c("before"), "REPEATED").when(c("decision_id") < c("before"), "ORDER").when(~c("result").isin("anchor", "accept"), "RESULT").when(stray, "NOT_ACCEPTED").when(F.coalesce("reason", F.lit("")) == "", "REASON")
    )
    return rows.withColumn("error", error).groupBy("session_id").agg(F.min_by("error", F.when(c("error").isNotNull(), c("ord"))).alias("error"))


def _write_files(texts: DataFrame, folder: str, name: str) -> None:
    """One file a session: folder/session_id=<id>/<part>.txt, each written whole by its task."""
    texts.select("session_id", F.col(name).alias("value")).repartition("session_id").write.mode("overwrite").partitionBy("session_id").text(folder, lineSep="\n")


def write_tracks(points: DataFrame, errors: DataFrame, folder: str) -> None:
    """GPX files of sessions without an error under folder/trusted, and of all with points under folder/partial."""
    fine = errors.where("error IS NULL").select("session_id")
    _write_files(gpx.written(points.where("result IN ('anchor', 'accept')").join(fine, "session_id", "left_semi")), f"{folder}/trusted", "gpx")
    _write_files(gpx.written(points, partial=True), f"{folder}/partial", "gpx")


def replay_json(reports: DataFrame, decisions: DataFrame, key: str = "session_id") -> DataFrame:
    """session_id and json: each log's replay report with its decisions in line order.

    reports: as jsonl.replay_reports(). decisions: as jsonl.replay().
    """
    c = F.col
    one = F.struct(c("line_no").alias("lineNumber"), c("raw_id").alias("rawPointId"), c("result").alias("actualResult"), c("reason").alias("actualReason"), c("expected_result").alias("expectedResult"), c("expected_reason").alias("expectedReason"), F.coalesce("hit", F.lit(True)).alias("matchesExpectation"))
    made = decisions.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("decisions"))
    rows = reports.join(made, key, "left")
    body = F.struct("status", F.coalesce("why", F.lit("")).alias("invalidReason"), c("n").alias("decisionCount"), c("misses").alias("mismatchCount"), F.coalesce("decisions", F.array()).alias("decisions"))
    return rows.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def replay_batch_json(reports: DataFrame, name: str = "file_name") -> DataFrame:
    """One row with json: the counts of a batch, and its items in the order of their file names."""
    c = F.col
    item = F.struct(c(name).alias("inputFileName"), "status", F.coalesce("why", F.lit("")).alias("invalidReason"), c("n").alias("decisionCount"), c("misses").alias("mismatchCount"))
    kinds = [F.count_if(c("status") == status).alias(label) for status, label in (("EXACT", "exactCount"), ("BEST_EFFORT", "bestEffortCount"), ("INVALID_LOG", "invalidLogCount"))]
    whole = reports.agg(F.count(F.lit(1)).alias("totalCount"), *kinds, F.array_sort(F.collect_list(item)).alias("items"))  # one line a log, of a batch that a user chose
    return whole.select(F.to_json(F.struct(*whole.columns)).alias("json"))


def sectioned(reports: DataFrame, title: str, sections: dict[str, dict[str, str]]) -> DataFrame:
    """session_id and text of reports: a title, the id, and sections of lines, each a label and the column whose value it shows."""
    kinds = dict(reports.dtypes)

    def shown(column: str) -> Column:
        if kinds[column].startswith("array"):
            return F.when(F.size(column) > 0, F.array_join(column, "; ")).otherwise(F.lit("-"))
        value = F.format_string("%.1f", column) if kinds[column] == "double" else F.col(column).cast("string")
        return F.coalesce(value, F.lit("-"))

    lines = [F.concat(F.lit(f"# {title}\n\nsessionId="), F.col("session_id").cast("string"))]
    for name, fields in sections.items():
        lines.append(F.lit(f"\n## {name}"))
        lines += [F.concat(F.lit(f"- {label}="), shown(column)) for label, column in fields.items()]
    return reports.select("session_id", F.concat_ws("\n", *lines).alias("text"))


#: Sections of the two reports.
WEAK_SECTIONS = {
    "Fixes": {"RawLocation": "raw_n", "stale": "stale_n", "staleRatio": "stale_ratio"},
    "Weak": {"decisions": "weak_n", "withGnss": "weak_linked", "accuracy": "weak_acc", "used": "weak_used", "usedCn0": "weak_cn0", "top4Cn0": "weak_top4"},
    "Rejected": {"decisions": "reject_n", "withGnss": "reject_linked", "accuracy": "reject_acc", "used": "reject_used", "usedCn0": "reject_cn0", "top4Cn0": "reject_top4"},
    "Transport": {"decisions": "ride_n", "withGnss": "ride_linked", "usedCn0": "ride_cn0", "top4Cn0": "ride_top4"},
    "Gaps": {"recoveries": "gap_n", "withBefore": "before_n", "withAfter": "after_n", "beforeTop4": "before_top4", "afterTop4": "after_top4", "timeouts": "timeout_n", "longestTimeout": "timeout_max"},
    "Findings": {"findings": "findings"},
}
SAMPLE_SECTIONS = {
    "Verdict": {"verdict": "verdict", "blocking": "blocking", "review": "review", "excluded": "excluded"},
    "Times": {"diagnosticSeconds": "diagnostic_seconds", "rawSeconds": "raw_seconds", "longestInterval": "longest_gap", "meanInterval": "mean_gap", "longIntervals": "long_gaps"},
    "Counts": {"raw": "raw_n", "decisions": "decision_n", "trusted": "trusted_n", "weak": "weak_n", "rejected": "reject_n", "gaps": "gap_n", "gapsWithoutDistance": "gap_zero_n", "timeouts": "timeout_n", "snapshots": "snap_n", "motions": "motion_n", "policies": "policy_n"},
}


def write_reports(reports: DataFrame, folder: str, title: str = "Report", sections: dict[str, dict[str, str]] | None = None) -> None:
    """Reports as JSON lines, and as text in their sections (by default one with every column)."""
    reports.write.mode("overwrite").json(f"{folder}/json")
    sections = sections or {"Values": {c: c for c in reports.columns if c != "session_id"}}
    sectioned(reports, title, sections).select(F.col("text").alias("value")).write.mode("overwrite").text(f"{folder}/text")


def acceptance_markdown(devices: DataFrame, batches: DataFrame, batch: str = "batch") -> DataFrame:
    """The acceptance report of each batch as Markdown: verdict block and a line for each device. Both frames as reports.consistency() gives them."""
    from ..functions import fields as T

    c = F.col
    percent = lambda x: F.when(x.isNull(), "-").otherwise(T.percent_text(x))
    cells = [c("verdict"), T.device_label(c("brand"), c("model"), F.lit(None), F.lit(None)), c("session_id").cast("string"), c("ascent_source"), T.metres_text(c("ascent")), T.metres_text(c("away")), percent(c("rel")), F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("-"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    lines = devices.withColumn("line", line).groupBy(batch).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    head = [F.concat(F.lit("- Devices: "), c("device_group")), F.concat(F.lit("- Verdict: "), c("verdict")), F.concat(F.lit("- Median ascent: "), T.metres_text(c("median_ascent"))), F.concat(F.lit("- Largest relative deviation: "), percent(c("max_rel"))), F.concat(F.lit("- Largest absolute deviation: "), T.metres_text(c("max_away")))]
    names = ("Verdict", "Device", "Session", "Source", "Ascent", "Deviation", "Relative", "Notes")
    table = f"| {' | '.join(names)} |\n|{' --- |' * len(names)}"
    return batches.join(lines, batch).select(batch, F.concat_ws("\n", F.lit("# Consistency of barometer ascent\n"), *head, F.lit(f"\n{table}"), "lines").alias("report"))


def append_events(events: DataFrame, path: str) -> None:
    """Append the lines of jsonl.with_envelope() to a log's folder."""
    from .jsonl import with_envelope

    # A session's lines stay together and in order; sessions need none among them.
    with_envelope(events).repartition("session_id").sortWithinPartitions("session_id", "event_seq").select("line").write.mode("append").text(path)
