"""Data-driven and running windows, gaps and islands, greedy throttles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SECOND


def running(*order: str, key: str = "session_id") -> W:
    return W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def earlier(*order: str, key: str = "session_id") -> W:
    return W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def in_order(rows: DataFrame, names: list[str], fresh: Callable, schema: str) -> DataFrame:
    """A fold per session in arrival order: fresh() makes a session's object with row(...) and end().

    Both return output rows. A partition's sessions come one after the other, sorted, in batches;
    only the object of the current one is held.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session = None, None
        for part in parts:
            out = []
            for row in zip(*(part[n].tolist() for n in names)):
                if now is None or row[0] != session:
                    if now is not None:
                        out += now.end()
                    now, session = fresh(), row[0]
                out += now.row(*row)
            yield pd.DataFrame(out, columns=columns)
        if now is not None:
            yield pd.DataFrame(now.end(), columns=columns)

    return rows.select(*names).repartition(names[0]).sortWithinPartitions(*names[:2]).mapInPandas(run, schema)


def greedy(rows: DataFrame, keep: Callable, schema: str) -> DataFrame:
    """Per session and in arrival order, the rows that keep(last kept row, row) lets through.

    Which row stays depends on the last one that stayed, so no window function can say it.
    """

    class Kept:
        last = None

        def row(self, *row):
            if self.last is not None and not keep(self.last, row):
                return []
            self.last = row
            return [row]

        def end(self):
            return []

    return in_order(rows, [c.split()[0] for c in schema.split(", ")], Kept, schema)


def throttled(samples: DataFrame, gap: int = SECOND) -> DataFrame:
    """Samples at least gap after the last kept one."""
    return greedy(samples, lambda last, row: row[3] - last[3] >= gap, "session_id long, line_no long, sample_id long, t long")


def distinct_steps(points: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Points that differ from the last kept one by more than the tolerance in either direction."""
    return greedy(points, lambda last, row: abs(row[3] - last[3]) > tolerance or abs(row[4] - last[4]) > tolerance, "session_id long, line_no long, raw_id long, lat double, lng double")


def motion_windows(samples: DataFrame, width: int = SECOND, least: int = 5, still: float = 0.70) -> DataFrame:
    """Tumbling windows that open at a sample and close with the first one a width or more later.

    samples: session_id, line_no, t, dynamic (metres per second squared). The rest at the end makes a
    window too. A window is still with enough samples and a high score.
    """

    class Windows:
        def __init__(self):
            self.first, self.made = None, 0

        def row(self, sid, line, t, d):
            if self.first is None:
                self.first, self.n, self.squares = t, 0, 0.0
            self.sid, self.last = sid, t
            self.n += 1
            self.squares += d * d
            return self.end() if t - self.first >= width else []

        def end(self):
            if self.first is None:
                return []
            rms = (self.squares / self.n) ** 0.5
            score = min(1.0, max(0.0, 1.0 - rms / 0.30))
            self.made += 1
            out = [(self.sid, self.made, self.first, self.last, self.n, rms, score, self.n >= least and score >= still)]
            self.first = None
            return out

    return in_order(samples, ["session_id", "line_no", "t", "dynamic"], Windows, "session_id long, window_id long, t0 long, t1 long, samples long, rms double, score double, still boolean")


def since_reset(rows: DataFrame, reset: F.Column, order: str = "line_no") -> DataFrame:
    """rows with island_: how many resets came up to each row (gaps and islands)."""
    return rows.withColumn("island_", F.sum(F.when(reset, 1).otherwise(0)).over(running(order)))


#: Reasons that count as resting, and how many of them or of keepalives pause the sampling.
JITTERS = ("stationary_jitter", "stationary_anchor_refined", "stationary_accel_supported_jitter", "rest_candidate", "rest_paused_keepalive", "rest_probing_stationary", "stationary_motion_blocked_recovery", "rest_probing_confirming_moving")
KEEPALIVES_TO_PAUSE, JITTERS_TO_PAUSE = 2, 10
#: Live points kept of a session, and the least distance that gives a heading in metres.
LIVE_POINTS = 1000
HEADING_METRES = 5.0


def stationary_runs(decisions: DataFrame) -> DataFrame:
    """decisions with keepalives and jitters since the last decision that was neither, and whether they pause the sampling."""
    keep, jitter = F.col("reason") == "stationary_keepalive", F.col("reason").isin(*JITTERS)
    w = W.partitionBy("session_id", "island_").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = since_reset(decisions, ~(keep | jitter)).withColumns({"keepalives": F.count_if(keep).over(w), "jitters": F.count_if(jitter).over(w)})
    return rows.withColumn("paused", (F.col("keepalives") >= KEEPALIVES_TO_PAUSE) | (F.col("jitters") >= JITTERS_TO_PAUSE)).drop("island_")


def newest(rows: DataFrame, many: int, order: str = "line_no") -> DataFrame:
    """The last rows of each session, as a bounded buffer keeps them."""
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc(order)))
    return rows.withColumn("rank_", rank).where(F.col("rank_") <= many).drop("rank_")


#: Tiles that one drawing may ask for, and that may be under way together.
TILES_A_DRAWING, TILES_UNDER_WAY = 6, 18


def requested(tiles: DataFrame, priority: str, tie: str) -> DataFrame:
    """tiles (session_id, active: how many are under way) that a drawing asks for, with pos, the most urgent first."""
    pos = F.row_number().over(W.partitionBy("session_id").orderBy(priority, tie)).cast("long")
    room = F.least(F.lit(TILES_A_DRAWING), TILES_UNDER_WAY - F.col("active"))
    return tiles.withColumn("pos", pos).where((F.col("pos") <= TILES_A_DRAWING) & (F.col("pos") <= room))


def heading_reliability(samples: DataFrame, width: int = 3 * SECOND) -> DataFrame:
    """samples (t, heading, field, gyro, accurate) with the spread over the last width and the verdict."""
    w = W.partitionBy("session_id").orderBy("t").rangeBetween(-width, 0)
    c, s = F.avg(F.cos(F.radians("heading"))).over(w), F.avg(F.sin(F.radians("heading"))).over(w)
    r = F.sqrt(c * c + s * s)
    spread = F.when(r >= 1, 0.0).otherwise(F.degrees(F.sqrt(-2 * F.ln(F.greatest(r, F.lit(1e-12))))))
    out = samples.withColumns({"n": F.count("heading").over(w), "spread": spread, "top_gyro": F.max("gyro").over(w)})
    verdict = (
        F.when(F.col("heading").isNull(), "sensor_unavailable").when(F.col("late") > 500_000_000, "heading_stale").when(~F.col("accurate"), "sensor_accuracy_low")
        .when((F.col("field") < 20) | (F.col("field") > 80), "magnetic_norm_outlier").when((F.col("n") < 3) | (F.col("spread") > 15), "heading_jitter").when(F.col("top_gyro") > 0.5, "device_rotating").otherwise("reliable")
    )
    return out.withColumn("verdict", verdict)


def time_markers(points: DataFrame, every: int = 600 * SECOND) -> DataFrame:
    """Marks at whole multiples of `every` after a session's first point, interpolated between points.

    points: session_id, ord, t, lat, lng. Steps back in time bear no mark.
    """
    w = W.partitionBy("session_id").orderBy("ord")
    first = F.first("t").over(running("ord"))
    top = F.max("t").over(earlier("ord"))
    steps = points.withColumns({"p_t": F.lag("t").over(w), "p_lat": F.lag("lat").over(w), "p_lng": F.lag("lng").over(w), "t_first": first, "t_top": top})
    # A mark belongs to the first forward step that reaches it.
    low = F.floor((F.greatest("p_t", "t_top") - F.col("t_first")) / every) + 1
    high = F.floor((F.col("t") - F.col("t_first")) / every)
    marks = steps.where((F.col("t") > F.col("p_t")) & (low <= high)).withColumn("k", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    at = F.col("t_first") + F.col("k") * every
    part = (at - F.col("p_t")) / (F.col("t") - F.col("p_t"))
    return marks.where(at >= F.col("p_t")).select("session_id", "k", at.alias("t"), (F.col("p_lat") + (F.col("lat") - F.col("p_lat")) * part).alias("lat"), (F.col("p_lng") + (F.col("lng") - F.col("p_lng")) * part).alias("lng"))
