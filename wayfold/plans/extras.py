"""Queries of display, route, heading and report details."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo as G
from ..operators import windows as O
from ..sources import sinks
from .registry import query
from .windows import MARKERS

c = F.col


@query("screen_points", """, m AS (SELECT session_id, raw_id, lat, lng, (lng + 180) / 360 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS y FROM fix), b AS (SELECT session_id, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM m GROUP BY 1)
SELECT m.session_id, raw_id, round((x - 0.79) * 4096 + 540, 6) AS sx, round((y - 0.41) * 4096 + 960, 6) AS sy, round(20 + (lng - w) / greatest(e - w, 1e-6) * 760, 6) AS fx, round(20 + (n - lat) / greatest(n - s, 1e-6) * 560, 6) AS fy FROM m JOIN b USING (session_id)""", "fix")
def screen_points(x):
    rows = x.fix
    box = rows.groupBy("session_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    mx, my = G.mercator(c("lat"), c("lng"))
    sx, sy = G.screen(mx, my, F.lit(0.79), F.lit(0.41), F.lit(4096.0), F.lit(1080.0), F.lit(1920.0))
    fx, fy = G.in_frame(c("lat"), c("lng"), c("s"), c("w"), c("n"), c("e"), 800.0, 600.0, 20.0)
    return rows.join(box, "session_id").select("session_id", "raw_id", *[F.round(v, 6).alias(k) for k, v in (("sx", sx), ("sy", sy), ("fx", fx), ("fy", fy))])


TILES = """, b AS (SELECT session_id, (min(lng) + 180) / 360 AS x0, (max(lng) + 180) / 360 AS x1, min((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2) AS y0, max((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2) AS y1 FROM fix WHERE lat <> 0 GROUP BY 1),
k AS (SELECT session_id, unnest(range(CAST(floor(x0 * 262144) AS BIGINT), CAST(floor(x1 * 262144) AS BIGINT) + 1)) AS tx, y0, y1 FROM b), tiles AS (SELECT session_id, tx, unnest(range(CAST(floor(y0 * 262144) AS BIGINT), CAST(floor(y1 * 262144) AS BIGINT) + 1)) AS ty FROM k)"""


def tiles(x):
    box = x.fix.where("lat <> 0").withColumns(dict(zip(("mx", "my"), G.mercator(c("lat"), c("lng"))))).groupBy("session_id").agg(F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1"))
    return box.select("session_id", F.explode(G.covering_tiles(c("x0"), c("y0"), c("x1"), c("y1"), F.lit(18))).alias("t")).select("session_id", "t.tx", "t.ty")


@query("covering_tiles", TILES + " SELECT session_id, tx, ty, concat('17/', tx // 2, '/', ty // 2) AS parent FROM tiles", "fix")
def covering_tiles(x):
    return tiles(x).select("session_id", "tx", "ty", G.parent_tile(c("tx"), c("ty"), F.lit(18)).alias("parent"))


@query("tile_requests", TILES + ", m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY abs(tx - 208255) + abs(ty - 109500), tx, ty) AS pos FROM tiles) SELECT session_id, tx, ty, pos FROM m WHERE pos <= 6", "fix")
def tile_requests(x):
    near = F.abs(c("tx") - 208255) + F.abs(c("ty") - 109500)
    pos = F.row_number().over(W.partitionBy("session_id").orderBy(near, "tx", "ty")).cast("long")
    return tiles(x).withColumn("pos", pos).where("pos <= 6")


@query("timeline_filter", "SELECT 'trusted' AS filter, session_id, decision_id AS id FROM decision WHERE result IN ('accept', 'anchor') UNION ALL SELECT 'weak', session_id, decision_id FROM decision WHERE result = 'weak' UNION ALL SELECT 'event', session_id, event_id FROM status", "decision status")
def timeline_filter(x):
    rows = x.decision.select("session_id", c("decision_id").alias("id"), "result", F.lit("point").alias("kind")).unionByName(x.status.select("session_id", c("event_id").alias("id"), F.lit(None).cast("string").alias("result"), F.lit("event").alias("kind")))
    name = F.when(c("kind") == "event", "event").when(c("result").isin("accept", "anchor"), "trusted").when(c("result") == "weak", "weak")
    return rows.withColumn("filter", name).where("filter IS NOT NULL").select("filter", "session_id", "id")


@query("route_markers", ", p AS (SELECT session_id, seq // 20 AS part, line_no AS ord, t, lat, lng FROM fix WHERE lat <> 0)" + MARKERS.replace("{every}", "60000000000") + """
SELECT session_id, part AS segment, CAST(k AS BIGINT) AS k, round(pla + (lat - pla) * ((ft + k * 60000000000 - pt) / (t - pt)), 9) AS lat FROM m WHERE ft + k * 60000000000 >= pt""", "fix")
def route_markers(x):
    rows = x.fix.where("lat <> 0").withColumns({"segment": F.expr("seq DIV 20"), "ord": c("line_no")})
    # Marks begin anew with each segment of the route.
    keyed = rows.select(F.struct("session_id", "segment").alias("session_id"), "ord", "t", "lat", "lng")
    return O.time_markers(keyed, 60_000_000_000).select("session_id.session_id", "session_id.segment", "k", F.round("lat", 9).alias("lat"))


@query("heading_ladder", """SELECT session_id, raw_id, CASE WHEN bearing IS NOT NULL AND speed >= 0.8 THEN 'gnss' WHEN raw_id % 4 = 1 THEN 'track' WHEN raw_id % 3 = 0 AND bearing IS NOT NULL THEN 'live' WHEN raw_id % 5 = 2 THEN 'compass' ELSE 'none' END AS source,
 coalesce(bearing IS NOT NULL AND speed >= 0.8, false) AS reliable FROM fix""", "fix")
def heading_ladder(x):
    sound = F.coalesce(c("bearing").isNotNull() & (c("speed") >= 0.8), F.lit(False))
    source = F.when(sound, "gnss").when(c("raw_id") % 4 == 1, "track").when((c("raw_id") % 3 == 0) & c("bearing").isNotNull(), "live").when(c("raw_id") % 5 == 2, "compass").otherwise("none")
    return x.fix.select("session_id", "raw_id", source.alias("source"), sound.alias("reliable"))


@query("snapshot_averages", "SELECT session_id, count(*) AS n, count(*) FILTER (WHERE all_cn0 IS NOT NULL AND top4_cn0 IS NOT NULL) AS explained, round(avg(used_cn0) FILTER (WHERE all_cn0 IS NOT NULL AND top4_cn0 IS NOT NULL), 6) AS used_cn0, round(avg(all_cn0), 6) AS all_cn0, round(avg(top4_cn0), 6) AS top4_cn0 FROM snap GROUP BY 1", "snap")
def snapshot_averages(x):
    told = c("all_cn0").isNotNull() & c("top4_cn0").isNotNull()
    return x.snap.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(told).alias("explained"), F.round(F.avg(F.when(told, c("used_cn0"))), 6).alias("used_cn0"), F.round(F.avg("all_cn0"), 6).alias("all_cn0"), F.round(F.avg("top4_cn0"), 6).alias("top4_cn0"))


@query("trusted_export_error", """, p AS (SELECT *, row_number() OVER o AS rn, max(decision_id) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM decision WHERE point_id IS NOT NULL WINDOW o AS (PARTITION BY session_id ORDER BY line_no)),
e AS (SELECT session_id, line_no, CASE WHEN decision_id % 239 = 0 THEN 'POINT_ID' WHEN raw_id > 100000000 OR raw_id <= 0 THEN 'RAW_ID' WHEN decision_id <= 0 THEN 'DECISION_ID' WHEN decision_id = before THEN 'REPEATED' WHEN decision_id < before THEN 'ORDER' WHEN decision_id % 7 = 0 THEN 'NOT_ACCEPTED' END AS error FROM p)
SELECT session_id, arg_min(error, line_no) FILTER (WHERE error IS NOT NULL) AS error FROM e GROUP BY 1""", "decision")
def trusted_export_error(x):
    rn = F.row_number().over(W.partitionBy("session_id").orderBy("line_no"))
    rows = x.decision.where("point_id IS NOT NULL").select("session_id", c("line_no").alias("ord"), F.when(c("decision_id") % 239 == 0, rn + 1).otherwise(rn).alias("point_id"), "raw_id", "decision_id", "result", "reason")
    return sinks.export_error(rows, F.lit(100_000_000), F.lit(1 << 40), x.decision.where("decision_id % 7 <> 0"))
