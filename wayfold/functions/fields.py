"""Text, state and policy functions of sessions and decisions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)


def duration_text(seconds: Column) -> Column:
    """h:mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def ascent_text(x: Column) -> Column:
    return F.when(x < 0, "-").otherwise(one_decimal(x))


def percent_text(x: Column) -> Column:
    return F.concat(one_decimal(x * 100), F.lit("%"))


def key(x: Column) -> Column:
    """Trimmed and lower-cased; null is empty."""
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def device_label(brand: Column, model: Column, name: Column, maker: Column) -> Column:
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    both = F.nullif(F.concat_ws(" ", some(brand), some(model)), F.lit(""))
    return F.coalesce(both, some(name), some(maker), F.lit("unknown"))


def number(text: Column) -> Column:
    """A finite number or null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def coerced(text: Column, missing: Column) -> Column:
    """As loose parsers read JSON: a missing field is null, null and blank are 0, else a finite number or null."""
    return F.when(missing, F.lit(None).cast("double")).when(text.isNull() | (F.trim(text) == ""), 0.0).otherwise(number(text))


def sort_time(*candidates: Column) -> Column:
    return F.coalesce(*candidates, F.lit(0).cast("long"))


def decision_kind(result: Column) -> Column:
    return F.when(result.isin("anchor", "accept", "weak", "reject"), result).otherwise("raw")


#: Our explanations of decision reasons: code -> (title, meaning).
REASONS = {
    "first_fix_good": ("First fix", "The first trusted position, with good accuracy"),
    "first_fix_relaxed": ("First fix, relaxed", "The first trusted position, with fair accuracy"),
    "forced_weak_first_fix": ("Forced first fix", "A weak first position that the user accepted"),
    "weak_first_fix": ("Weak first fix", "Too weak to begin a track"),
    "weak_signal_stage1": ("Weak signal", "Accuracy is above what a trusted point needs"),
    "non_positive_delta_time": ("Time order", "Not later than the last trusted point"),
    "impossible_speed": ("Impossible speed", "Farther than a walker can have come"),
    "transport_suspected": ("Vehicle suspected", "Pace and distance fit a vehicle"),
    "transport_confirmed": ("Vehicle", "Still moving as in a vehicle"),
    "transport_recovery": ("Out of the vehicle", "Slow for long enough; a new segment begins"),
    "stationary_keepalive": ("Standing", "Within the accuracy of the last point; noted from time to time"),
    "stationary_jitter": ("Jitter", "Within the accuracy of the last point"),
    "gap_recovery": ("After a gap", "The first point after a long silence"),
    "moving_good_fix": ("Moving", "A trusted step"),
    "stationary_anchor_refined": ("Better anchor", "A more accurate position of the same rest"),
    "stationary_accel_supported_jitter": ("Still jitter", "Rest explains the difference"),
    "rest_candidate": ("Perhaps resting", "Slow, near and still"),
    "rest_paused_keepalive": ("Resting", "Near the rest's anchor"),
    "rest_probing_stationary": ("Still resting", "Probing found no movement"),
    "rest_probing_confirming_moving": ("Perhaps moving", "Waiting for a second moving point"),
    "stationary_motion_blocked_recovery": ("Held at rest", "The motion sensor says still"),
    "rest_moving_recovery": ("Moving again", "Movement is confirmed; a new segment begins"),
}


def recovery_state(read: Column, log_exists: Column, completion: Column, integrity: Column) -> Column:
    return (
        F.when(read == "MISSING", "MISSING_MANIFEST").when(read == "INVALID", "INVALID_MANIFEST").when(~log_exists, "ABORTED").when((integrity == "ERROR") | (completion == "ERROR"), "ERROR")
        .when(completion == "FINISHED", "FINISHED").when(completion.isin("ACTIVE", "INTERRUPTED"), "INTERRUPTED").otherwise("UNKNOWN")
    )


def can_export(read: Column, completion: Column, integrity: Column, points: Column, gpx: Column) -> Column:
    return (read == "OK") & (completion == "FINISHED") & (integrity == "OK") & (points > 0) & gpx


def can_export_partial(read: Column, partial: Column, points: Column, weaks: Column, log_exists: Column) -> Column:
    return (read == "OK") & (partial | (((points > 0) | (weaks > 0)) & log_exists))


def unavailable(read: Column, completion: Column, integrity: Column, points: Column, gpx: Column, partial: Column) -> Column:
    """Why a session has no trusted export."""
    return (
        F.when(read != "OK", "UNREADABLE").when(completion != "FINISHED", F.when(partial, "PARTIAL_ONLY").otherwise("NOT_FINISHED")).when(integrity != "OK", "INTEGRITY")
        .when(points <= 0, F.when(partial, "NO_POINTS_PARTIAL").otherwise("NO_POINTS")).when(~gpx, "FILE_MISSING").otherwise("NONE")
    )


#: Reasons that ask for the weak-signal sampling policy, and each policy's interval in milliseconds.
WEAK_REASONS = ("accuracy_too_large", "first_fix_accuracy_too_large", "weak_first_fix", "weak_signal_stage1", "invalid_accuracy", "location_too_old", "impossible_speed")
INTERVALS = {"STARTING": 1000, "MOVING": 3000, "SIGNAL_WEAK": 2000, "REST_PROBING": 1000, "REST_PAUSED": 10000, "PAUSED": 10000}


def sampling_state(active: Column, silent: Column, reason: Column, points: Column, rest: Column, paused: Column) -> Column:
    return (
        F.when(~active, "STARTING").when(silent | F.coalesce(reason.isin(*WEAK_REASONS), F.lit(False)), "SIGNAL_WEAK").when(points <= 0, "STARTING").when(rest == "REST_PROBING", "REST_PROBING")
        .when(rest == "REST_PAUSED", "REST_PAUSED").when(paused, "PAUSED").otherwise("MOVING")
    )


def sampling_interval(state: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, millis in INTERVALS.items():
        out = F.when(state == name, millis).otherwise(out)
    return out


def safe_session_id(text: Column) -> Column:
    """No path can be made of it: not empty, no separators, no parent folder."""
    return F.coalesce((text != "") & ~F.contains(text, F.lit("/")) & ~F.contains(text, F.lit("\\")) & ~F.contains(text, F.lit("..")), F.lit(False))


def import_kind(path: Column) -> Column:
    """manifest, log or null, by the last part of a path."""
    return F.when(path.rlike(r"(?i)(^|/)session\.json$"), "manifest").when(path.rlike(r"(?i)(^|/)diagnostic\.jsonl$"), "log")


def marker_time(elapsed: Column, wall: Column) -> Column:
    return F.when(elapsed > 0, elapsed).when(wall > 0, wall * 1_000_000).otherwise(F.lit(0).cast("long"))


def pressure_text(hpa: Column) -> Column:
    """Non-finite pressures as text, for JSON; null for those that are numbers."""
    return F.when(F.isnan(hpa), "NaN").when(hpa == float("inf"), "Infinity").when(hpa == -float("inf"), "-Infinity")


def seconds_text(x: Column) -> Column:
    """0.0s, seconds with one decimal, or minutes from 60 seconds on."""
    return F.when(x <= 0, "0.0s").when(x >= 60, F.concat(one_decimal(x / 60), F.lit("min"))).otherwise(F.concat(one_decimal(x), F.lit("s")))


def metres_text(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(F.concat(one_decimal(x), F.lit("m")))


def climb_text(x: Column) -> Column:
    """Metres of ascent; none is below zero."""
    return F.when(x.isNull() | F.isnan(x) | (x < 0), "-").otherwise(F.concat(one_decimal(x), F.lit("m")))


def long_duration_text(seconds: Column) -> Column:
    """The two largest of hours, minutes and seconds; - for none."""
    whole = F.floor(seconds + 0.5).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "-").when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def device_path(brand: Column, maker: Column, model: Column, name: Column) -> Column:
    """Brand (else maker), model and name as far as they are known."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" / ", F.coalesce(some(brand), some(maker)), some(model), some(name))


def sensor_name(kind: Column) -> Column:
    """The platform's numbers of acceleration sensors."""
    return F.when(kind == 10, "TYPE_LINEAR_ACCELERATION").when(kind == 1, "TYPE_ACCELEROMETER").otherwise(F.concat(F.lit("TYPE_"), kind.cast("string")))


def reason_of(key: Column) -> Column:
    """What is behind the first colon of result:reason; without a colon all of it; - for nothing."""
    rest = F.when(F.contains(key, F.lit(":")), F.substring(key, F.instr(key, ":") + 1, F.length(key))).otherwise(key)
    return F.coalesce(F.nullif(rest, F.lit("")), F.lit("-"))


#: Our text for reasons without an explanation.
UNEXPLAINED = ("No reason recorded", "No explanation of this reason; look at the result, its context and the raw fields")

TRAVEL = ("transport_suspected", "transport_confirmed")


def is_travel(result: Column, reason: Column) -> Column:
    return F.coalesce((result == "transport") | reason.isin(*TRAVEL), F.lit(False))


def travel_segment(from_result: Column, from_reason: Column, to_result: Column, to_reason: Column) -> Column:
    """Whether the line between two points is a ride's: either end is, or the second ends one."""
    return is_travel(from_result, from_reason) | is_travel(to_result, to_reason) | F.coalesce(to_reason == "transport_recovery", F.lit(False))


def track_outcome(read: Column, completion: Column, integrity: Column, points: Column, weaks: Column, raws: Column, metres: Column, gpx: Column, partial: Column) -> Column:
    """What became of a session's track."""
    return (
        F.when(read != "OK", "UNREADABLE").when(completion != "FINISHED", F.when(partial, "INTERRUPTED_PARTIAL").otherwise("NOT_FINISHED_LOG_ONLY")).when(integrity != "OK", "INTEGRITY_LOG_ONLY")
        .when(points <= 0, F.when(weaks > 0, "WEAK_ONLY_PARTIAL").when(raws > 0, "NO_TRUSTED_POINT").otherwise("NO_FIX")).when((points == 1) & (metres <= 0), "ANCHOR_ONLY").when(gpx, "EXPORTABLE").otherwise("FILE_MISSING")
    )


def track_outcome_short(read: Column, completion: Column, integrity: Column, points: Column, weaks: Column, gpx: Column, partial: Column) -> Column:
    return (
        F.when(read != "OK", "BROKEN").when(completion != "FINISHED", F.when(partial, "INTERRUPTED").otherwise("NOT_FINISHED")).when(integrity != "OK", "CHECK")
        .when(gpx & (points > 0), "EXPORTABLE").when(weaks > 0, "WEAK").otherwise("NO_TRACK")
    )


def lifecycle(events: Column) -> Column:
    """(completion, integrity, active) after a session's events (kinds in order): start, finish, interrupt, or an error code."""
    state = lambda completion, integrity, active: F.struct(completion.alias("completion"), integrity.alias("integrity"), active.alias("active"))
    start = state(F.lit("ACTIVE"), F.lit("OK"), F.lit(False))

    def step(s: Column, e: Column) -> Column:
        return (
            F.when(e == "start_recording", state(F.lit("ACTIVE"), F.lit("OK"), F.lit(True))).when(e == "finish_recording", state(F.lit("FINISHED"), s["integrity"], F.lit(False)))
            .when(e == "interrupted", state(F.lit("INTERRUPTED"), s["integrity"], F.lit(False))).when(F.startswith(e, F.lit("error:")), state(F.lit("ERROR"), F.lit("ERROR"), F.lit(False))).otherwise(s)
        )

    return F.aggregate(events, start, step)


def preferred_log(kind: Column, size: Column) -> Column:
    """Rank of a file among those dropped in: a log by its name, else one that is not empty, else any."""
    return F.when(kind == "log", 0).when(size > 0, 1).otherwise(2)
