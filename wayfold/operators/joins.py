"""As-of, interval, nearest and arrival-bounded joins, as equi-joins on time cells and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SECOND


def in_cells(left: DataFrame, right: DataFrame, left_time: str, right_from: str, right_to: str, reach: int, key: str = "session_id") -> DataFrame:
    """Pairs of one key whose left time may lie within reach of a right interval.

    Right intervals are put into every cell of width reach that they touch once widened by
    reach; a left row looks in its own cell only. Each pair is found once; the caller filters.
    Columns of the right side that clash, the key included, get the suffix _r.
    """
    cells = F.sequence(F.floor((F.col(right_from) - reach) / reach).cast("long"), F.floor((F.col(right_to) + reach) / reach).cast("long"))
    r = right.withColumn("cell_r", F.explode(cells))
    for c in right.columns:
        if c in left.columns:
            r = r.withColumnRenamed(c, f"{c}_r")
    l = left.withColumn("cell_l", F.floor(F.col(left_time) / reach).cast("long"))  # noqa: E741
    return l.join(r, (F.col(key) == F.col(f"{key}_r")) & (F.col("cell_l") == F.col("cell_r"))).drop("cell_l", "cell_r")


def asof_snapshot(fixes: DataFrame, snaps: DataFrame, reach: int = 3 * SECOND) -> DataFrame:
    """Each fix with the nearest earlier snapshot within reach, else the nearest later one.

    Only snapshots that arrived before the fix count; ties go to the first arrival.
    """
    s = snaps.select("session_id", F.col("snap_id").alias("match_id"), F.col("t").alias("s_t"), F.col("line_no").alias("s_line"))
    pairs = in_cells(fixes.select("session_id", "raw_id", "t", "line_no"), s, "t", "s_t", "s_t", reach)
    dt = F.col("t") - F.col("s_t")
    near = pairs.where((F.abs(dt) <= reach) & (F.col("s_line") < F.col("line_no")))
    best = near.groupBy("session_id", "raw_id").agg(F.min(F.struct((dt < 0).alias("future"), F.abs(dt).alias("age"), "s_line", "match_id")).alias("m"))
    return fixes.join(best, ["session_id", "raw_id"], "left").select(
        "session_id", "raw_id", F.col("m.match_id").alias("match_id"), F.col("m.age").alias("age"), F.col("m.future").alias("future"), F.col("m").isNull().alias("no_match")
    )


def by_arrival(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows with the last right row of their key that arrived before them (left join).

    Columns of the right side get the suffix _r.
    """
    r = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    on = (F.col("session_id") == F.col("session_id_r")) & (F.col(left_key) == F.col(f"{right_key}_r")) & (F.col("line_no_r") < F.col("line_no"))
    pairs = left.join(r, on, "left")
    newest = W.partitionBy("session_id", "line_no").orderBy(F.desc_nulls_last("line_no_r"))
    return pairs.withColumn("n_", F.row_number().over(newest)).where("n_ = 1").drop("n_")


def decision_snapshots(decisions: DataFrame, fixes: DataFrame, snaps: DataFrame) -> DataFrame:
    """Decisions with their own snapshot, else (if they name none) their fix's."""
    with_raw = by_arrival(decisions, fixes.select("session_id", "line_no", "raw_id", "snap_id", "acc"), "raw_id", "raw_id")
    named = with_raw.select(*decisions.columns, F.col("acc_r").alias("raw_acc"), F.col("raw_id_r").isNotNull().alias("has_raw"), F.coalesce("snap_id", "snap_id_r").alias("wanted"))
    return by_arrival(named, snaps, "wanted", "snap_id")


def gap_windows(decisions: DataFrame, snaps: DataFrame, reach: int = 30 * SECOND) -> DataFrame:
    """Each gap recovery with the nearest snapshots at or before and after it, within reach."""
    gaps = decisions.where("reason = 'gap_recovery'").select("session_id", "decision_id", "t")
    s = snaps.select("session_id", F.col("snap_id"), F.col("t").alias("s_t"), F.col("line_no").alias("s_line"), "top4_cn0")
    pairs = in_cells(gaps, s, "t", "s_t", "s_t", reach)
    dt = F.col("t") - F.col("s_t")
    pick = lambda cond: F.min(F.when(cond & (F.abs(dt) <= reach), F.struct(F.abs(dt).alias("age"), "s_line", "snap_id", "top4_cn0")))
    best = pairs.groupBy("session_id", "decision_id").agg(pick(dt >= 0).alias("b"), pick(dt < 0).alias("a"))
    return gaps.join(best, ["session_id", "decision_id"], "left").select(
        "session_id", "decision_id", F.col("b.snap_id").alias("before_id"), F.col("a.snap_id").alias("after_id"), F.col("b.top4_cn0").alias("before_top4"), F.col("a.top4_cn0").alias("after_top4")
    )


def nearest_motion(points: DataFrame, motions: DataFrame, reach: int = 5 * SECOND) -> DataFrame:
    """Each point with the motion summary whose interval is nearest (0 inside it), within reach."""
    m = motions.select("session_id", "motion_id", "t0", "t1", F.col("line_no").alias("m_line"))
    pairs = in_cells(points.select("session_id", "raw_id", "t"), m, "t", "t0", "t1", reach)
    far = F.greatest(F.lit(0).cast("long"), F.col("t0") - F.col("t"), F.col("t") - F.col("t1"))
    best = pairs.withColumn("far", far).where(F.col("far") <= reach).groupBy("session_id", "raw_id").agg(F.min(F.struct("far", "t0", "m_line", "motion_id")).alias("m"))
    return points.join(best, ["session_id", "raw_id"], "left").select("session_id", "raw_id", F.col("m.motion_id").alias("motion_id"), F.col("m.far").alias("far"))


def latest_before(rows: DataFrame, other: DataFrame, fields: list[str], valid: F.Column | None = None) -> DataFrame:
    """Rows with a struct `latest` of the other relation's last row by arrival (one pass over the union)."""
    a = rows.withColumn("of_", F.lit(1)).withColumn("seen_", F.lit(None).cast(other.select(F.struct(*fields).alias("s")).schema[0].dataType))
    o = other if valid is None else other.where(valid)
    b = o.select("session_id", "line_no", F.lit(0).alias("of_"), F.struct(*fields).alias("seen_"))
    w = W.partitionBy("session_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn("latest", F.last("seen_", ignorenulls=True).over(w)).where("of_ = 1").drop("of_", "seen_")


def diagnostic_points(fixes: DataFrame, decisions: DataFrame, snaps: DataFrame) -> DataFrame:
    """Fixes with result and reason of their last decision (null: none), and the snapshot that it, else the fix, names."""
    last = decisions.groupBy("session_id", "raw_id").agg(F.max_by(F.struct("result", "reason", "snap_id"), "line_no").alias("d"))
    rows = fixes.join(last, ["session_id", "raw_id"], "left").withColumn("wanted", F.coalesce("d.snap_id", "snap_id"))
    s = snaps.select(F.col("session_id").alias("s_session"), F.col("snap_id").alias("linked_id"), "used", "used_cn0", "top4_cn0", "all_cn0")
    joined = rows.join(s, (F.col("session_id") == F.col("s_session")) & (F.col("wanted") == F.col("linked_id")), "left")
    return joined.select("session_id", "raw_id", "acc", "stale", "d.result", "d.reason", "linked_id", "used", "used_cn0", "top4_cn0", "all_cn0")
