"""Event logs: one JSON object a line, read with the line numbers and the five ways to meet bad lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """Whole logs of a folder or glob: path, text (a log is one row, as its lines are ordered)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def lines(logs: DataFrame, key: str = "session_id") -> DataFrame:
    """Lines that aren't blank, numbered from 1 with blank ones counted, and parsed; ev is null for bad ones."""
    split = logs.select(key, F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    raw = F.trim(F.regexp_replace("raw", "^\\s+|\\s+$", ""))
    rows = split.select(key, (F.col("pos") + 1).cast("long").alias("line_no"), raw.alias("raw")).where("raw <> ''")
    # Only objects are events.
    return rows.withColumn("ev", F.when(F.col("raw").startswith("{"), F.try_parse_json("raw")))


def get(path: str, kind: str):
    """A field of ev, null where it is absent, null or of another kind."""
    return F.try_variant_get("ev", f"$.{path}", kind)


def has(path: str):
    """Whether ev has the field, a null included."""
    return F.coalesce(F.array_contains(F.json_object_keys("raw"), path), F.lit(False))


def present(path: str, kind: str, null_is_present: bool, default):
    """A field with the reader's view of null: replay takes a null as the default, other readers as absent."""
    value = get(path, kind)
    return F.when(has(path), F.coalesce(value, F.lit(default).cast(kind))) if null_is_present else value


def first_bad(rows: DataFrame, key: str = "session_id") -> DataFrame:
    return rows.groupBy(key).agg(F.min(F.when(F.col("ev").isNull(), F.col("line_no"))).alias("bad_line"))


def gated(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """rows with their event, and what holds for their whole log: why (the first reason, in line order, that it cannot be replayed; null if it can), start_t and forced.

    All are windows by key, so a log is dealt once however many readers its lines have.
    """
    event = get("event", "string")
    whole = W.partitionBy(key)
    created = get("createdElapsedRealtimeNanos", "long")
    seen = rows.withColumns({
        "event": event,
        "begun": F.last(F.when(event == "session_metadata", F.coalesce(created, F.lit(-1).cast("long"))), ignorenulls=True).over(whole.orderBy("line_no")),
    })
    e, line = F.col("event"), F.col("line_no")
    fault = F.when(F.col("ev").isNull(), F.concat(F.lit("malformed_json_line_"), line.cast("string"))).when((e == "raw_location") & (F.coalesce("begun", F.lit(-1)) <= 0), "missing_session_metadata_before_raw_location")
    seen = seen.withColumn("fault", fault).withColumns({
        "why": F.min_by("fault", F.when(F.col("fault").isNotNull(), line)).over(whole),
        "raws": F.count_if(e == "raw_location").over(whole),
        "start_t": F.max_by(created, F.when(e == "session_metadata", line)).over(whole),
        "forced": F.coalesce(F.max_by(F.coalesce(get("forcedWeakFirstFixEnabled", "boolean"), F.lit(False)), F.when(e == "config_snapshot", line)).over(whole), F.lit(False)),
    })
    return seen.withColumn("why", F.coalesce("why", F.when(F.col("raws") == 0, "no_raw_location_events"))).drop("begun", "fault", "raws")


def replay_gates(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """The first reason, in line order, why a log cannot be replayed; null if it can."""
    return gated(rows, key).groupBy(key).agg(F.first("why").alias("why"))


def summary(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Events and last sequence number before the first bad line, and whether there is one."""
    bad = first_bad(rows, key)
    seq = get("eventSeq", "long")
    good = rows.join(bad, key).where(F.col("bad_line").isNull() | (F.col("line_no") < F.col("bad_line"))).withColumn("seq", seq).where("seq IS NOT NULL")
    counts = good.groupBy(key).agg(F.max_by("seq", "line_no").alias("last_seq"), F.count(F.lit(1)).alias("n"))
    return bad.join(counts, key, "left").select(key, F.when(F.col("bad_line").isNull(), "OK").otherwise("INVALID_JSONL").alias("status"), F.coalesce("last_seq", F.lit(-1)).alias("last_seq"), F.coalesce("n", F.lit(0)).alias("n"))


def strict(rows: DataFrame) -> DataFrame:
    """rows, failing at the first bad line that is read."""
    return rows.withColumn("ev", F.when(F.col("ev").isNull(), F.raise_error(F.concat(F.lit("bad line "), F.col("line_no").cast("string"))).cast("variant")).otherwise(F.col("ev")))


def permissive(rows: DataFrame, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad ones with the first 160 characters."""
    return rows.where("ev IS NOT NULL"), rows.where("ev IS NULL").select(key, "line_no", F.substring("raw", 1, 160).alias("text"))


def or_empty(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """The rows of logs without a bad line; a log with one counts as empty."""
    return rows.join(first_bad(rows, key).where("bad_line IS NULL").select(key), key, "left_semi")


def raw_locations(rows: DataFrame, null_is_present: bool, key: str = "session_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Fixes of a log, with the defaults of its reader (replay: null_is_present) and the columns also."""
    event = get("event", "string") == "raw_location"
    t = F.coalesce(get("elapsedRealtimeNanos", "long"), F.lit(0).cast("long"))
    acc = F.when(F.coalesce(get("hasAccuracy", "boolean"), F.lit(True)), present("accuracy", "double", null_is_present, 0.0))
    return rows.where(event).select(
        key, "line_no", F.coalesce(get("rawPointId", "long"), F.lit(0).cast("long")).alias("raw_id"), F.coalesce(get("provider", "string"), F.lit("gps")).alias("provider"), F.coalesce(get("hasElapsedRealtimeNanos", "boolean"), F.lit(True)).alias("has_t"),
        t.alias("t"), F.coalesce(get("eventElapsedRealtimeNanos", "long"), t + 1_000_000).alias("recv"), F.coalesce(get("lat", "double"), F.lit(float("nan"))).alias("lat"), F.coalesce(get("lng", "double"), F.lit(float("nan"))).alias("lng"), acc.alias("acc"),
        present("speed", "double", null_is_present, 0.0).alias("speed"), F.coalesce(get("mock", "boolean"), F.lit(False)).alias("mock"), get("sourceGnssSnapshotId", "long").alias("snap_id"), get("expectedResult", "string").alias("expected_result"), get("expectedReason", "string").alias("expected_reason"), *also,
    )


def motions(rows: DataFrame, key: str = "session_id") -> DataFrame:
    n = lambda path, kind: F.coalesce(get(path, kind), F.lit(0).cast(kind))
    return rows.where(get("event", "string") == "motion_summary").select(
        key, "line_no", n("motionSummaryId", "long").alias("motion_id"), n("firstElapsedRealtimeNanos", "long").alias("t0"), n("lastElapsedRealtimeNanos", "long").alias("t1"), n("sampleCount", "long").alias("samples"),
        n("dynamicAccelRmsMps2", "double").alias("rms"), n("stillScore", "double").alias("score"), F.coalesce(get("isDeviceStill", "boolean"), get("deviceStill", "boolean"), F.lit(False)).alias("still"))


def snapshots(rows: DataFrame, key: str = "session_id") -> DataFrame:
    cn0 = F.coalesce(get("usedAvgCn0", "double"), F.lit(0.0))
    return rows.where(get("event", "string") == "gnss_snapshot").select(
        key, "line_no", get("snapshotId", "long").alias("snap_id"), F.coalesce(get("receivedElapsedRealtimeNanos", "long"), get("eventElapsedRealtimeNanos", "long")).alias("t"), F.coalesce(get("usedInFixTotal", "long"), F.lit(0).cast("long")).alias("used"),
        cn0.alias("used_cn0"), F.coalesce(get("top4AvgCn0", "double"), cn0).alias("top4_cn0"))


def with_envelope(events: DataFrame, key: str = "session_id", order: str = "line_no") -> DataFrame:
    """Lines to append to a log: the event's own fields (column body, a JSON object) behind the envelope."""
    seq = F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long")
    head = F.to_json(F.struct(F.col(key).cast("string").alias("sessionId"), seq.alias("eventSeq"), F.lit(1).alias("schemaVersion"), F.col("t").alias("eventElapsedRealtimeNanos")))
    return events.select(key, seq.alias("event_seq"), F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(","), F.substring("body", 2, 1_000_000_000)).alias("line"))


def replay(logs: DataFrame, key: str = "session_id") -> DataFrame:
    """Decisions of replayable logs against what they expect: one row a fix, and hit (null: nothing expected)."""
    return _replayed(gated(lines(logs, key), key), key)


def _replayed(seen: DataFrame, key: str) -> DataFrame:
    from ..plans import decide as D

    fine = seen.where("why IS NULL")
    fixes = raw_locations(fine, True, key, ("start_t", "forced"))
    made = D.decide(fixes, motions(fine, key), snapshots(fine, key))
    want = fixes.select(key, "line_no", "expected_result", "expected_reason")
    hit = (F.col("result") == F.coalesce("expected_result", "result")) & (F.col("reason") == F.coalesce("expected_reason", "reason"))
    none = F.col("expected_result").isNull() & F.col("expected_reason").isNull()
    return made.join(want, [key, "line_no"]).withColumn("hit", F.when(~none, hit))


def replay_reports(logs: DataFrame, key: str = "session_id") -> DataFrame:
    """Status of each log: INVALID_LOG with the reason, EXACT, or BEST_EFFORT."""
    seen = gated(lines(logs, key), key)
    gates = seen.groupBy(key).agg(F.first("why").alias("why"))
    d = _replayed(seen, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("expected_n"), F.count_if(~F.col("hit")).alias("misses"))
    status = F.when(F.col("why").isNotNull(), "INVALID_LOG").when((F.col("misses") == 0) & (F.col("expected_n") == F.col("n")), "EXACT").otherwise("BEST_EFFORT")
    return gates.join(d, key, "left").select(key, status.alias("status"), "why", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("misses", F.lit(0)).alias("misses"))


def replay_batch(reports: DataFrame) -> DataFrame:
    """How many logs have each status."""
    return reports.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def summaries(logs: DataFrame, key: str = "session_id") -> DataFrame:
    """summary() of logs (text, there) with their state: MISSING where there is none, READ_ERROR where it gave no text."""
    made = summary(lines(logs.where("there AND text IS NOT NULL"), key), key)
    rows = logs.select(key, "there", F.col("text").isNull().alias("unread")).join(made, key, "left")
    status = F.when(~F.col("there"), "MISSING").when(F.col("unread"), "READ_ERROR").otherwise(F.coalesce("status", F.lit("OK")))
    none = F.lit(0).cast("long")
    return rows.select(key, status.alias("status"), F.greatest(none, F.coalesce("last_seq", none)).alias("last_seq"), F.coalesce("n", none).alias("n"))


def bad_lines(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Lines that are no JSON objects, with what is wrong and their first 160 characters."""
    return permissive(rows, key)[1].select(key, "line_no", F.lit("not a JSON object").alias("message"), "text")


def batch(spark: SparkSession, folder: str) -> DataFrame:
    """The logs of a folder: file_name (their order), session_id (its rank) and text."""
    found = files(spark, f"{folder}/*.jsonl").withColumn("file_name", F.regexp_extract("path", r"([^/]+)$", 1))
    return found.withColumn("session_id", F.dense_rank().over(W.orderBy("file_name")).cast("long"))  # file names of one folder
