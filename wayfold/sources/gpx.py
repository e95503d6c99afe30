"""GPX tracks: reading by a bounded-memory table function, writing by Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The patterns of times, and the names of a point's own fields in the order they are written.
TIME_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX")


def escape(text: Column) -> Column:
    """XML-escaped text; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def time_millis(text: Column) -> Column:
    """Epoch milliseconds of a GPX time in one of four patterns; 0 where there is none."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(*[F.unix_millis(F.try_to_timestamp(trimmed, F.lit(p))) for p in TIME_PATTERNS], F.lit(0)).cast("long")


def with_breaks(points: DataFrame, order: str) -> DataFrame:
    """points with trkseg: a weak point is a segment of its own; segment ids don't break a track."""
    w = W.partitionBy("session_id").orderBy(order)
    weak = F.col("result") == "weak"
    starts = weak | F.coalesce(F.lag(weak).over(w), F.lit(True))
    return points.withColumn("trkseg", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


POINT_FIELDS = ("sessionId", "partial", "trackPointId", "segmentId", "sourceRawPointId", "sourceDecisionId", "elapsedRealtimeNanos", "accuracy", "decisionResult", "decisionReason", "distanceDeltaMeters", "movingTimeDeltaSeconds")
HEAD = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="wayfold" xmlns="http://www.topografix.com/GPX/1/1" xmlns:hike="urn:wayfold:track">'


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<hike:{name}>"), value, F.lit(f"</hike:{name}>"))


def _time(millis: Column) -> Column:
    return F.concat(F.lit("<time>"), F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time>"))


def written(points: DataFrame, order: str = "line_no", partial: bool = False) -> DataFrame:
    """session_id and gpx text, of sessions with a point.

    points: session_id, point_id, segment_id, raw_id, decision_id, result, reason, t, wall, lat, lng,
    alt (or null), acc, metres, moving, snap_id (or null) and the order. Metadata hold the track's
    name, first time, totals, number of points and whether it is a part. Numbers are written in
    full, times in UTC to the second.
    """
    text = lambda name, default="": F.coalesce(F.col(name).cast("string"), F.lit(default))
    values = (text("session_id"), F.lit(str(partial).lower()), text("point_id", "0"), text("segment_id", "0"), text("raw_id"), text("decision_id"), text("t"), text("acc", "0.0"), escape(F.col("result")), escape(F.col("reason")), text("metres"), text("moving"))
    fields = [_element(name, value) for name, value in zip(POINT_FIELDS, values)]
    snapshot = F.coalesce(_element("sourceGnssSnapshotId", F.col("snap_id").cast("string")), F.lit(""))
    ele = F.coalesce(F.concat(F.lit("<ele>"), F.col("alt").cast("string"), F.lit("</ele>")), F.lit(""))
    point = F.concat(F.lit('<trkpt lat="'), text("lat"), F.lit('" lon="'), text("lng"), F.lit('">'), ele, _time(F.col("wall")), F.lit("<extensions>"), *fields, snapshot, F.lit("</extensions></trkpt>"))
    join = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), "")
    segments = with_breaks(points, order).withColumn("point", point).groupBy("session_id", "trkseg").agg(
        join(order, "point").alias("body"), F.sum("metres").alias("metres"), F.sum("moving").alias("moving"), F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "wall")).alias("first"))
    segments = segments.withColumn("segment", F.concat(F.lit("<trkseg>"), "body", F.lit("</trkseg>")))
    whole = segments.groupBy("session_id").agg(join("trkseg", "segment").alias("trk"), F.sum("metres").alias("metres"), F.sum("moving").alias("moving"), F.sum("n").alias("n"), F.min("first")["wall"].alias("wall"))
    totals = [_element("totalDistanceMeters", text("metres")), _element("movingTimeSeconds", text("moving")), _element("trackPointCount", text("n")), _element("partial", F.lit(str(partial).lower()))]
    metadata = F.concat(F.lit("<metadata><name>Track "), escape(F.col("session_id").cast("string")), F.lit("</name>"), _time(F.col("wall")), F.lit("<extensions>"), *totals, F.lit("</extensions></metadata>"))
    return whole.select("session_id", F.concat(F.lit(HEAD), metadata, F.lit("<trk><name>Track</name>"), "trk", F.lit("</trk></gpx>")).alias("gpx"))


def parse(text: str) -> list[tuple[int, float, float, float | None, str | None]]:
    """(segment, lat, lng, ele, time) of a GPX text: track points, then route points, and way points only if there are neither.

    Groups that have points are numbered from 1; points may be nested in them.

    Documents with a DOCTYPE are refused. Coordinates that are bad, out of range or zero are passed over.
    """
    import xml.etree.ElementTree as ET

    if "<!DOCTYPE" in text.upper():
        raise ValueError("a GPX file must not have a DOCTYPE")
    root = ET.fromstring(text)
    local = lambda e: e.tag.rpartition("}")[2].lower()
    out: list[tuple] = []
    segment = 1

    def take(points: list) -> bool:
        found = False
        for p in points:
            try:
                lat, lng = float(p.get("lat")), float(p.get("lon"))
            except (TypeError, ValueError):
                continue
            if not (abs(lat) <= 90 and abs(lng) <= 180) or (lat == 0 and lng == 0):
                continue
            ele = time = None
            for c in p:
                if local(c) == "ele":
                    try:
                        ele = float(c.text)
                    except (TypeError, ValueError):
                        ele = None
            for c in p.iter():
                if local(c) == "time":
                    time = "".join(c.itertext())
                    break
            out.append((segment, lat, lng, ele, time))
            found = True
        return found

    every = list(root.iter())
    for group, point in (("trkseg", "trkpt"), ("rte", "rtept")):
        for g in every:
            if local(g) == group and take([p for p in g.iter() if local(p) == point]):
                segment += 1
    if not out:
        take([p for p in every if local(p) == "wpt"])
    return out


def read(files: DataFrame) -> DataFrame:
    """Points of GPX texts. files: session_id and gpx; a text that is no XML gives no points."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for part in parts:
            rows = []
            for sid, text in zip(part["session_id"], part["gpx"]):
                try:
                    rows += [(sid, k, *p) for k, p in enumerate(parse(text or ""))]
                except (ET.ParseError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["session_id", "ord", "segment", "lat", "lng", "ele", "time"])

    raw = files.select("session_id", "gpx").mapInPandas(run, "session_id long, ord long, segment long, lat double, lng double, ele double, time string")
    return raw.withColumn("wall", time_millis(F.col("time"))).drop("time")
