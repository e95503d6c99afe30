"""Ascent by smoothed trends: one scalar state folded over a session's ordered samples, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SECOND

#: Smoothing, least climb and least drop (with the factor of vertical accuracy) by source.
BAROMETER = {"alpha": 0.35, "climb": (3.0, 0.0), "drop": (1.5, 0.0)}
TERRAIN = {"alpha": 0.25, "climb": (5.0, 0.0), "drop": (3.0, 0.0)}
SATELLITE = {"alpha": 0.15, "climb": (5.0, 0.8), "drop": (3.0, 0.4)}
TOP_SPEED = 2.0
BAROMETER_GAP = 30 * SECOND

_FIELDS = "total double, filtered double, base double, peak double, last_t bigint, vacc double, n bigint, rejected bigint, some boolean"


def _limit(rule: tuple[float, float], vacc: Column) -> Column:
    return F.greatest(F.lit(rule[0]), vacc * rule[1]) if rule[1] else F.lit(rule[0])


def fold(samples: DataFrame, source: dict, max_gap: int | None = None, key: str = "session_id") -> DataFrame:
    """session, ascent (-1 with fewer than two samples), n, rejected.

    samples: session_id, ord, t, alt, vacc, reset (restart from this sample) and bad (counted as
    rejected). A gap of more than max_gap restarts too.
    """
    alpha = source["alpha"]
    pending = lambda s: F.when((s["peak"] - s["base"]) >= _limit(source["climb"], s["vacc"]), s["peak"] - s["base"]).otherwise(0.0)
    state = lambda total, filtered, base, peak, last_t, vacc, n, rejected, some: F.struct(
        total.cast("double").alias("total"), filtered.cast("double").alias("filtered"), base.cast("double").alias("base"), peak.cast("double").alias("peak"), last_t.cast("long").alias("last_t"),
        vacc.cast("double").alias("vacc"), n.cast("long").alias("n"), rejected.cast("long").alias("rejected"), some.cast("boolean").alias("some"),
    )

    def step(s: Column, x: Column) -> Column:
        first = s["filtered"].isNull()
        reset = x["reset"] if max_gap is None else (x["reset"] | (~first & (x["t"] - s["last_t"] > max_gap)))
        restart = state(s["total"] + F.coalesce(pending(s), F.lit(0.0)), x["alt"], x["alt"], x["alt"], x["t"], x["vacc"], s["n"] + 1, s["rejected"], F.lit(True))
        late = (x["t"] <= s["last_t"]) | (F.abs(x["alt"] - s["filtered"]) / ((x["t"] - s["last_t"]) / 1e9) > TOP_SPEED)
        gated = x["bad"] | (~first & late)
        skip = state(s["total"], s["filtered"], s["base"], s["peak"], s["last_t"], s["vacc"], s["n"], s["rejected"] + 1, s["some"])
        f = F.when(first, x["alt"]).otherwise(x["alt"] * alpha + s["filtered"] * (1.0 - alpha))
        rise = first | (f >= s["peak"])
        turned = ~rise & (s["peak"] - f >= _limit(source["drop"], x["vacc"]))
        gain = F.when(turned & (s["peak"] - s["base"] >= _limit(source["climb"], x["vacc"])), s["peak"] - s["base"]).otherwise(0.0)
        on = state(s["total"] + gain, f, F.when(first | turned, f).otherwise(s["base"]), F.when(rise | turned, f).otherwise(s["peak"]), x["t"], x["vacc"], s["n"] + 1, s["rejected"], F.lit(True))
        return F.when(x["bad"], skip).when(reset, restart).when(gated, skip).otherwise(on)

    null = F.lit(None)
    zero = state(F.lit(0.0), null, null, null, F.lit(0), null, F.lit(0), F.lit(0), F.lit(False))
    listed = F.array_sort(F.collect_list(F.struct("ord", "t", "alt", "vacc", "reset", "bad")))
    rows = samples.groupBy(key).agg(F.aggregate(listed, zero, step).alias("s"))
    ascent = F.when(F.col("s.some") & (F.col("s.n") >= 2), F.col("s.total") + F.coalesce(pending(F.col("s")), F.lit(0.0))).otherwise(-1.0)
    return rows.select(key, ascent.alias("ascent"), F.col("s.n").alias("n"), F.col("s.rejected").alias("rejected"))


def sound_satellite(alt: Column, vacc: Column, acc: Column) -> Column:
    return F.coalesce(alt.isNotNull() & (vacc > 0) & (vacc <= 12) & (acc > 0) & (acc <= 30), F.lit(False))


#: Reasons of anchors and of points that a vehicle made, and the least step of a satellite sample in metres.
ANCHORS = ("first_fix_good", "first_fix_relaxed", "forced_weak_first_fix", "gap_recovery", "transport_recovery", "rest_moving_recovery", "stationary_anchor_refined")
RIDES = ("transport_suspected", "transport_confirmed", "impossible_speed")
LEAST_STEP = 5.0


def satellite_samples(points: DataFrame) -> DataFrame:
    """Samples of track points (session_id, ord, t, alt, vacc, acc, reason, metres): anchors restart, walking steps of LEAST_STEP count."""
    anchor = F.col("reason").isin(*ANCHORS)
    taken = sound_satellite(F.col("alt"), F.col("vacc"), F.col("acc")) & (anchor | ((F.col("reason") == "moving_good_fix") & (F.col("metres") >= LEAST_STEP)))
    return points.where(taken).select("session_id", "ord", "t", "alt", "vacc", anchor.alias("reset"), F.lit(False).alias("bad"))


def barometer_samples(points: DataFrame) -> DataFrame:
    """Samples of track points that carry a pressure (session_id, ord, t, alt, hpa, reason): anchors restart, those of rides don't count."""
    taken = (F.col("hpa") > 0) & ~F.isnan("hpa") & ~F.col("reason").isin(*RIDES)
    return points.where(taken).select("session_id", "ord", "t", "alt", F.lit(0.0).alias("vacc"), F.col("reason").isin(*ANCHORS).alias("reset"), F.lit(False).alias("bad"))


def selected(barometer: DataFrame, satellite: DataFrame) -> DataFrame:
    """The barometer's ascent if it has one, else the satellites', else none."""
    rows = barometer.select("session_id", F.col("ascent").alias("baro")).join(satellite.select("session_id", F.col("ascent").alias("sat")), "session_id", "full_outer")
    b, s = F.coalesce("baro", F.lit(-1.0)), F.coalesce("sat", F.lit(-1.0))
    return rows.select("session_id", F.when(b >= 0, b).when(s >= 0, s).otherwise(-1.0).alias("ascent"), F.when(b >= 0, "BAROMETER").when(s >= 0, "GNSS").otherwise("NONE").alias("source"))
