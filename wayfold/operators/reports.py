"""Report aggregates: weak-signal report, sample report, diagnostic summary, device consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def mean(cond: Column, value: Column) -> Column:
    """The mean of value where cond holds and value is known; 0 without any."""
    return F.coalesce(F.avg(F.when(cond, value)), F.lit(0.0))


def chosen(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]), lambda c: c.isNotNull())


def weak_signal(decisions: DataFrame, fixes: DataFrame, gaps: DataFrame, status: DataFrame) -> DataFrame:
    """One row a session. decisions carry linked_id, used, used_cn0, top4_cn0 and raw_acc."""
    weak, reject = F.col("result") == "weak", F.col("result") == "reject"
    ride = (reject & F.col("reason").startswith("transport_")) | (~reject & (F.col("reason") == "transport_recovery"))
    linked = F.col("linked_id").isNotNull()

    def group(name: str, cond: Column) -> list[Column]:
        return [
            F.count_if(cond).alias(f"{name}_n"), F.count_if(cond & linked).alias(f"{name}_linked"), mean(cond & (F.col("raw_acc") > 0), F.col("raw_acc")).alias(f"{name}_acc"),
            mean(cond & linked, F.col("used")).alias(f"{name}_used"), mean(cond & linked, F.col("used_cn0")).alias(f"{name}_cn0"), mean(cond & linked, F.col("top4_cn0")).alias(f"{name}_top4"),
        ]

    d = decisions.groupBy("session_id").agg(*group("weak", weak), *group("reject", reject), *group("ride", ride), F.count_if(F.col("reason") == "gap_recovery").alias("gap_n"))
    r = fixes.groupBy("session_id").agg(F.count("*").alias("raw_n"), F.count_if("stale").alias("stale_n"))
    g = gaps.groupBy("session_id").agg(F.count("before_top4").alias("before_n"), F.count("after_top4").alias("after_n"), F.coalesce(F.avg("before_top4"), F.lit(0.0)).alias("before_top4"), F.coalesce(F.avg("after_top4"), F.lit(0.0)).alias("after_top4"))
    s = status.where("kind = 'no_location_timeout'").groupBy("session_id").agg(F.count("*").alias("timeout_n"), (F.max("waited") / 1000.0).alias("timeout_max"))
    # A session may have decisions, or a timeout, and no fix.
    out = r.join(d, "session_id", "full").join(g, "session_id", "left").join(s, "session_id", "full").fillna(0)
    stale = F.when(F.col("raw_n") > 0, F.col("stale_n") / F.col("raw_n")).otherwise(0.0)
    c = F.col
    findings = chosen(
        ("WEAK_LOW_CN0", (c("weak_n") > 0) & (c("weak_cn0") > 0) & (c("weak_cn0") < 25)), ("WEAK_FEW_SATS", (c("weak_n") > 0) & (c("weak_used") > 0) & (c("weak_used") < 5)), ("STALE_RATIO", stale > 0.20),
        ("WEAK_UNLINKED", c("weak_n") > c("weak_linked")), ("REJECT_UNLINKED", c("reject_n") > c("reject_linked")), ("TRANSPORT_UNLINKED", c("ride_n") > c("ride_linked")),
        ("GAP_OR_NO_FIX", (c("gap_n") > 0) | (c("timeout_n") > 0)), ("TRANSPORT_GOOD_SIGNAL", (c("ride_n") > 0) & (c("ride_cn0") >= 25)),
    )
    quiet = (F.size(findings) == 0) & (c("weak_n") == 0) & (c("reject_n") == 0) & (c("gap_n") == 0) & (c("timeout_n") == 0)
    return out.withColumn("stale_ratio", stale).withColumn("findings", F.when(quiet, F.array(F.lit("NONE"))).otherwise(findings))


#: What a sample report leaves out: power, and how other maps read the tracks.
NOT_JUDGED = ("POWER", "MAP_COMPATIBILITY")


def sample_counts(fixes: DataFrame, decisions: DataFrame, policies: DataFrame, status: DataFrame, snaps: DataFrame, motions: DataFrame) -> DataFrame:
    """The counts of a session's log by kind of event, and its times; one row for each session that has any."""
    from .windows import earlier

    one = F.lit(1)
    top = F.max(F.when(F.col("t") > 0, F.col("t"))).over(earlier("line_no"))
    gap = F.when(F.col("t") > F.col("top"), (F.col("t") - F.col("top")) / 1e9)
    r = fixes.withColumn("top", top).groupBy("session_id").agg(
        F.count(one).alias("raw_n"), F.count_if("stale").alias("stale_n"), ((F.max("t") - F.min_by("t", F.when(F.col("t") > 0, F.col("line_no")))) / 1e9).alias("raw_seconds"), F.count_if(gap > 60).alias("long_gaps"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("longest_gap"))
    why, res = F.col("reason"), F.col("result")
    rides = ((res == "reject") & why.isin("transport_suspected", "transport_confirmed")) | ((res == "accept") & (why == "transport_recovery"))
    d = decisions.groupBy("session_id").agg(
        F.count(one).alias("decision_n"), trusted_points().alias("trusted_n"), F.count_if(res == "weak").alias("weak_n"), F.count_if(res == "reject").alias("reject_n"), F.count_if(why == "gap_recovery").alias("gap_n"),
        F.count_if((why == "gap_recovery") & (F.col("metres") == 0) & (F.col("moving") == 0)).alias("gap_zero_n"), F.count_if(rides).alias("ride_n"))
    p = policies.groupBy("session_id").agg(F.count(one).alias("policy_n"), F.count_if(F.col("min_distance") != 0).alias("distance_requests"))
    s = status.where("kind = 'no_location_timeout'").groupBy("session_id").agg(F.count(one).alias("timeout_n"))
    events = fixes.select("session_id", "line_no", F.col("recv").alias("t"))
    for other, at in ((decisions, "t"), (policies, "t"), (status, "t"), (motions, "t1")):
        events = events.unionAll(other.select("session_id", "line_no", at))
    span = F.greatest(F.lit(0).cast("long"), F.max("t") - F.min_by("t", "line_no")) / 1e9
    out = events.where("t > 0").groupBy("session_id").agg(span.alias("diagnostic_seconds"))
    for counts in (r, d, p, s, snaps.groupBy("session_id").agg(F.count(one).alias("snap_n")), motions.groupBy("session_id").agg(F.count(one).alias("motion_n"))):
        out = out.join(counts, "session_id", "full")
    return out


def evidence(sessions: DataFrame, points: DataFrame, decisions: DataFrame, status: DataFrame) -> DataFrame:
    """Counts, averages and findings (level:CODE) of each session, also of one without fixes or decisions.

    sessions: session_id, bad_lines. points: fixes with their last decision's result and reason, and their snapshot.
    """
    has = F.col("linked_id").isNotNull()

    def totals(kind: str, cond: Column) -> list[Column]:
        linked = F.count_if(cond & has)
        averages = [F.coalesce(F.try_divide(F.sum(F.when(cond & has, F.coalesce(F.col(m), F.lit(0)))), linked), F.lit(0.0)).alias(f"{kind}_{m}") for m in ("used", "used_cn0", "top4_cn0", "all_cn0")]
        return [F.count_if(cond).alias(f"{kind}_n"), linked.alias(f"{kind}_linked"), F.coalesce(F.avg(F.when(cond, F.col("acc"))), F.lit(0.0)).alias(f"{kind}_acc"), *averages]

    c = F.col
    m = points.groupBy("session_id").agg(F.count(F.lit(1)).alias("raw_n"), F.count_if("stale").alias("stale_n"), F.count_if(c("reason") == "gap_recovery").alias("gap_n"),
                                         *totals("weak", c("result") == "weak"), *totals("reject", c("result") == "reject"), *totals("ride", c("reason").startswith("transport_")))
    d = decisions.groupBy("session_id").agg(F.count(F.lit(1)).alias("decision_n"))
    t = status.where("kind = 'no_location_timeout'").groupBy("session_id").agg(F.count(F.lit(1)).alias("timeout_n"), (F.max("waited") / 1000.0).alias("timeout_max"))
    out = sessions.join(m, "session_id", "left").join(d, "session_id", "left").join(t, "session_id", "left").fillna(0)
    findings = chosen(
        ("fail:PARSE_ERRORS", c("bad_lines") > 0), ("fail:NO_RAW", c("raw_n") == 0), ("fail:NO_DECISION", c("decision_n") == 0), ("review:RAW_DECISION_COUNT", (c("raw_n") > 0) & (c("decision_n") > 0) & (c("raw_n") != c("decision_n"))),
        ("review:WEAK_UNLINKED", c("weak_n") > c("weak_linked")), ("review:REJECT_UNLINKED", c("reject_n") > c("reject_linked")), ("review:STALE_RATIO", (c("raw_n") > 0) & (F.try_divide(c("stale_n"), c("raw_n")) > 0.2)),
        ("review:WEAK_LOW_CN0", (c("weak_n") > 0) & (c("weak_used_cn0") > 0) & (c("weak_used_cn0") < 25)), ("review:WEAK_FEW_SATS", (c("weak_n") > 0) & (c("weak_used") > 0) & (c("weak_used") < 5)),
        ("review:GAP_OR_NO_FIX", (c("gap_n") > 0) | (c("timeout_n") > 0)), ("info:TRANSPORT_GOOD_SIGNAL", (c("ride_n") > 0) & (c("ride_used_cn0") >= 25)),
    )
    return out.withColumn("findings", F.when(F.size(findings) > 0, findings).otherwise(F.array(F.lit("pass:COMPLETE"))))


def sample_verdict(m: DataFrame) -> DataFrame:
    """Verdict and rule codes of a session. m: one row a session with the counts of manifest and log."""
    c = F.col
    blocking = chosen(
        ("MANIFEST_UNREADABLE", c("read_status") != "OK"), ("LOG_MISSING", ~c("log_exists")), ("LOG_STATUS", c("log_status") != "OK"), ("LOG_PARSE", c("parse_failed")), ("NOT_FINISHED", c("completion") != "FINISHED"), ("INTEGRITY", c("integrity") != "OK"), ("NO_RAW", c("raw_n") == 0), ("NO_DECISION", c("decision_n") == 0),
        ("NO_TRACK_POINT", c("points") <= 0), ("RAW_COUNT", c("raws") != c("raw_n")), ("TRACK_COUNT", c("points") != c("trusted_n")), ("WEAK_COUNT", c("weaks") != c("weak_n")), ("GAP_COUNT", c("gaps") != c("gap_n")), ("RAW_DECISION_COUNT", c("raw_n") != c("decision_n")),
        ("MIN_DISTANCE", c("distance_requests") > 0), ("GAP_DELTA", c("gap_n") != c("gap_zero_n")),
    )
    minutes = c("raw_seconds") / 60.0
    review = chosen(
        ("SEQ_MISMATCH", c("last_seq") != c("log_seq")), ("SHORT", minutes < 30), ("LONG", minutes > 65), ("SLIGHTLY_LONG", (minutes > 60) & (minutes <= 65)), ("RAW_INTERVAL", c("long_gaps") > 0), ("MEAN_INTERVAL", c("mean_gap") > 15),
        ("NO_POLICY", c("policy_n") == 0), ("TIMEOUT", c("timeout_n") > 0), ("TRANSPORT", c("ride_n") > 0), ("WEAK_RATIO", F.try_divide(c("weak_n"), c("decision_n")) > 0.30), ("REJECT_RATIO", F.try_divide(c("reject_n"), c("decision_n")) > 0.50),
    )
    out = m.withColumns({"blocking": blocking, "review": review, "excluded": F.array(*map(F.lit, NOT_JUDGED))})
    return out.withColumn("verdict", F.when(F.size("blocking") > 0, "FAIL").when(F.size("review") > 0, "REVIEW").otherwise("PASS"))


def trusted_points() -> Column:
    """Distinct positive point ids, and trusted rows without one."""
    trusted = F.col("result").isin("anchor", "accept")
    return F.count_distinct(F.when(trusted & (F.col("point_id") > 0), F.col("point_id"))) + F.count_if(trusted & ~F.coalesce(F.col("point_id") > 0, F.lit(False)))


#: Pass and review limits of the relative deviation by device group.
GROUP_LIMITS = {"same-model": (0.08, 0.12), "same-brand": (0.12, 0.15), "cross-brand-same-algorithm": (0.12, 0.18), "unknown-device": (0.12, 0.18)}
#: Below each median, the absolute deviation that passes.
LOW_ASCENT = ((50.0, 15.0), (100.0, 20.0), (300.0, 25.0))


def _limits(which: int) -> Column:
    out = F.lit(GROUP_LIMITS["same-model"][which])
    for name, pair in GROUP_LIMITS.items():
        out = F.when(F.col("device_group") == name, pair[which]).otherwise(out)
    return out


def exclusions() -> Column:
    c = F.col
    return chosen(
        ("COMPLETION", F.coalesce(c("completion"), F.lit("")) != "FINISHED"), ("INTEGRITY", F.coalesce(c("integrity"), F.lit("")) != "OK"), ("SOURCE", F.coalesce(c("ascent_source"), F.lit("")) != "BAROMETER"),
        ("ASCENT", c("ascent").isNull() | (c("ascent") < 0)), ("SAMPLES", ~F.coalesce(c("samples") > 0, F.lit(False))),
    )


def consistency(sessions: DataFrame, batch: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Verdicts of the devices of each batch, and of each batch.

    sessions: batch, session_id, completion, integrity, ascent_source, ascent, samples, brand, model.
    """
    key = lambda name: F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    rows = sessions.withColumns({"reasons": exclusions(), "b": key("brand"), "m": key("model")}).withColumn("valid", F.size("reasons") == 0)
    known = (F.col("b") != "") & (F.col("m") != "")
    v = rows.where("valid").groupBy(batch).agg(
        F.count("*").alias("valid_n"), F.median("ascent").alias("median_ascent"), F.count_if(~known).alias("nameless"), F.count_distinct(F.when(F.col("b") != "", F.col("b"))).alias("brands"), F.count_distinct("b", "m").alias("models"))
    group = (
        F.when(F.col("valid_n") < 2, F.when((F.col("valid_n") == 1) & (F.col("nameless") == 0), "same-model").otherwise("unknown-device")).when(F.col("nameless") > 0, "unknown-device")
        .when(F.col("models") <= 1, "same-model").when(F.col("brands") <= 1, "same-brand").otherwise("cross-brand-same-algorithm")
    )
    low = F.lit(None).cast("double")
    for limit, metres in reversed(LOW_ASCENT):
        low = F.when(F.col("median_ascent") < limit, metres).otherwise(low)
    every = rows.groupBy(batch).agg(F.count("*").alias("all_n"))
    info = every.join(v, batch, "left").fillna({"valid_n": 0, "nameless": 0, "brands": 0, "models": 0}).withColumn("device_group", group).withColumn("low_limit", low)
    gone = F.abs(F.col("ascent") - F.col("median_ascent"))
    devices = rows.join(info, batch).withColumn("away", F.when(F.col("valid"), gone)).withColumn("rel", F.when(F.col("valid"), gone / F.greatest("median_ascent", F.lit(100.0))))
    ok = (F.col("away") <= F.col("low_limit")) | (F.col("rel") <= _limits(0))
    devices = devices.withColumn("verdict", F.when(~F.col("valid"), "EXCLUDED").when(ok, "PASS").when(F.col("rel") <= _limits(1), "REVIEW").otherwise("FAIL"))
    worst = devices.groupBy(batch).agg(F.max("rel").alias("max_rel"), F.max("away").alias("max_away"))
    batches = info.join(worst, batch)
    passes = F.coalesce((F.col("max_rel") <= _limits(0)) | (F.col("max_away") <= F.col("low_limit")), F.lit(False))
    held = (F.col("all_n") > F.col("valid_n")) | (F.col("device_group") == "unknown-device")
    batches = batches.withColumn("verdict", F.when(F.col("valid_n") < 2, "FAIL").when(passes, F.when(held, "REVIEW").otherwise("PASS")).when(F.col("max_rel") <= _limits(1), "REVIEW").otherwise("FAIL"))
    return devices, batches


#: Constellation numbers by the name of their counts; the rest are unknown or other.
SYSTEMS_SQL = {"gps": "kind = 1", "sbas": "kind = 2", "glonass": "kind = 3", "qzss": "kind = 4", "beidou": "kind = 5", "galileo": "kind = 6", "irnss": "kind = 7", "unknown": "kind = 0", "other": "kind > 7"}


def satellite_summary(sats: DataFrame, keys: list[str]) -> DataFrame:
    """One quality snapshot of each set of satellites."""
    used, cn0 = F.col("used"), F.col("cn0")
    ranked = F.slice(F.sort_array(F.collect_list("cn0"), asc=False), 1, 4)
    kinds = []
    for name, which in SYSTEMS_SQL.items():
        kinds += [F.count_if(F.expr(which)).alias(f"{name}_visible"), F.count_if(F.expr(which) & used).alias(f"{name}_used")]
    first = F.min_by("carrier", F.when(F.col("carrier") > 0, F.col("ord")))
    return sats.groupBy(*keys).agg(
        F.count("*").alias("visible"), F.count_if(used).alias("used"), mean(used & (cn0 > 0), cn0).alias("used_cn0"), mean(cn0 > 0, cn0).alias("all_cn0"), F.aggregate(ranked, F.lit(0.0), lambda a, b: a + b).alias("top4_sum"), F.size(ranked).alias("top4_n"),
        F.count_if(cn0 < 20).alias("low_visible"), F.count_if(used & (cn0 < 25)).alias("weak_used"), *kinds, first.alias("first_carrier"), F.min("carrier").alias("least_carrier"), F.max("carrier").alias("most_carrier"),
    ).withColumn("top4_cn0", F.when(F.col("top4_n") > 0, F.col("top4_sum") / F.col("top4_n")).otherwise(0.0)).withColumn(
        "dual", F.coalesce(F.greatest(F.col("most_carrier") - F.col("first_carrier"), F.col("first_carrier") - F.col("least_carrier")) >= 1e6, F.lit(False))
    ).drop("top4_sum", "top4_n", "first_carrier", "least_carrier", "most_carrier")
