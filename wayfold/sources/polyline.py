"""Track points as text: rows by semicolons, up to thirteen fields by commas; and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("lat", "lng", "acc", "bearing", "wall", "t", "result", "alt", "reason", "vacc", "pressure_t", "hpa", "baro_alt")
_ABSENT = {"bearing": "-1.0", "alt": "NaN", "vacc": "NaN", "pressure_t": "0", "hpa": "NaN", "baro_alt": "NaN"}


def written(points: DataFrame) -> DataFrame:
    """session_id, polyline (points by time, then by place)."""
    cells = [F.coalesce(F.col(f).cast("string"), F.lit(_ABSENT.get(f, ""))) for f in FIELDS]
    rows = points.select("session_id", "t", "line_no", F.concat_ws(",", *cells).alias("row"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "line_no", "row"))), lambda r: r["row"]), ";").alias("polyline"))


def read(lines: DataFrame) -> DataFrame:
    """Points of polylines. Rows with under five fields or a bad number are passed over; later fields have defaults."""
    rows = lines.select("session_id", F.posexplode(F.split("polyline", ";")).alias("pos", "row")).withColumn("c", F.split("row", ",")).where(F.size("c") >= 5)

    def number(i: int, kind: str, default) -> Column:
        return F.when(F.size("c") > i, F.get("c", F.lit(i)).try_cast(kind)).otherwise(F.lit(default).cast(kind))

    text = lambda i, default: F.when(F.size("c") > i, F.get("c", F.lit(i))).otherwise(default)
    nan = float("nan")
    kinds = {0: ("double", None), 1: ("double", None), 2: ("double", None), 3: ("double", None), 4: ("long", None), 5: ("long", 0), 7: ("double", nan), 9: ("double", nan), 10: ("long", 0), 11: ("double", nan), 12: ("double", nan)}
    cells = {FIELDS[i]: number(i, *k) for i, k in kinds.items()} | {"result": text(6, "accept"), "reason": text(8, "foreground_live")}
    out = rows.select("session_id", "pos", *[c.alias(n) for n, c in cells.items()])
    good = F.lit(True)
    for n in FIELDS:
        if n not in ("result", "reason"):
            good = good & F.col(n).isNotNull()
    known = lambda n: F.when(~F.isnan(F.col(n)), F.col(n))
    return out.where(good).withColumns({"bearing": F.when(F.col("bearing") >= 0, F.col("bearing")), "alt": known("alt"), "vacc": known("vacc"), "hpa": known("hpa"), "baro_alt": known("baro_alt")})


def line_features(points: DataFrame, keys: list[str], order: str = "line_no", properties: dict[str, Column] | None = None) -> DataFrame:
    """A GeoJSON line for each group of two points or more."""
    pair = F.transform(F.array_sort(F.collect_list(F.struct(order, "lng", "lat"))), lambda p: F.array(p["lng"], p["lat"]))
    rows = points.groupBy(*keys).agg(pair.alias("coordinates"))
    return rows.where(F.size("coordinates") > 1).select(*keys, _feature("LineString", F.col("coordinates"), properties or {}))


def point_features(points: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """A GeoJSON point for each point."""
    return points.select("session_id", _feature("Point", F.array("lng", "lat"), properties))


def _feature(kind: str, coordinates: Column, properties: dict[str, Column]) -> Column:
    named = F.struct(*[v.alias(k) for k, v in properties.items()]) if properties else F.create_map()
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), named.alias("properties"), geometry.alias("geometry"))).alias("feature")


def collection(features: DataFrame, keys: list[str]) -> DataFrame:
    """The features of each key as one GeoJSON collection."""
    return features.groupBy(*keys).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("feature")), ","), F.lit("]}")).alias("collection"))
