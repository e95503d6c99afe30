"""Geometry, sensor and satellite functions as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS

#: The longest latitude of the web map projection.
MERCATOR_LIMIT = 85.05112878
LIGHT_SPEED = 299_792_458.0
WEEK_NANOS = 604_800.0e9


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    dlng = F.radians(lng2 - lng1)
    y = F.sin(dlng) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlng)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def seconds(start: Column, end: Column) -> Column:
    """Seconds between elapsed nanos; 0 where the start is unknown or the order is wrong."""
    return F.when((start <= 0) | (end <= start), 0.0).otherwise((end - start) / 1e9)


def barometer_altitude(hpa: Column) -> Column:
    """Standard-atmosphere metres."""
    return 44330.0 * (1.0 - F.pow(hpa / 1013.25, F.lit(1.0 / 5.255)))


def sound_pressure(hpa: Column) -> Column:
    return F.coalesce(~F.isnan(hpa) & (hpa > 0) & (hpa < float("inf")), F.lit(False))


def still_score(rms: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - rms / 0.30))


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def dynamic_acceleration(raw: Column, x: Column, y: Column, z: Column) -> Column:
    """raw: whether gravity is still in the reading."""
    return F.when(raw, F.abs(norm(x, y, z) - 9.80665)).otherwise(norm(x, y, z))


def degrees360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def heading_delta(a: Column, b: Column) -> Column:
    """Shortest arc between headings."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def cardinal(x: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.pmod(F.floor(x / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Web map coordinates in [0, 1]."""
    phi = F.radians(F.least(F.lit(MERCATOR_LIMIT), F.greatest(F.lit(-MERCATOR_LIMIT), lat)))
    return (lng + 180) / 360, (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / F.lit(3.141592653589793)) / 2


def zoom_of(scale: Column) -> Column:
    return F.least(F.lit(22), F.greatest(F.lit(2), F.floor(F.log2(scale / 256) + 0.5).cast("int")))


def circle_pixels(metres: Column, lat: Column, scale: Column) -> Column:
    """Radius on screen of an accuracy circle; scale is the pixels of the world's width."""
    return metres * scale / (40_075_016.686 * F.greatest(F.lit(0.15), F.cos(F.radians(lat))))


def tile(x: Column, y: Column, zoom: Column) -> tuple[Column, Column, Column]:
    """Tile column (wrapped), row (clamped) and key of a map point."""
    n = F.pow(F.lit(2.0), zoom)
    tx = F.pmod(F.floor(x * n).cast("long"), n.cast("long"))
    ty = F.least(n.cast("long") - 1, F.greatest(F.lit(0).cast("long"), F.floor(y * n).cast("long")))
    return tx, ty, F.concat_ws("/", zoom.cast("string"), tx.cast("string"), ty.cast("string"))


def shifted(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Display position: inside the box of the shifted datum, moved by its published polynomial."""
    pi = F.lit(3.141592653589793)
    x, y = lng - 105.0, lat - 35.0
    wave = lambda v, parts: sum((amp * F.sin(v * f * pi) for amp, f in parts), F.lit(0.0)) * 2.0 / 3.0
    common = wave(x, ((20.0, 6.0), (20.0, 2.0)))
    dlat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + common
    dlat = dlat + wave(y, ((20.0, 1.0), (40.0, 1.0 / 3.0))) + wave(y, ((160.0, 1.0 / 12.0), (320.0, 1.0 / 30.0)))
    dlng = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + common
    dlng = dlng + wave(x, ((20.0, 1.0), (40.0, 1.0 / 3.0))) + wave(x, ((150.0, 1.0 / 12.0), (300.0, 1.0 / 30.0)))
    # The Krasovsky ellipsoid: half axis and squared eccentricity.
    axis, ecc = 6378245.0, 0.006693421622965943
    phi = F.radians(lat)
    w = 1.0 - ecc * F.sin(phi) * F.sin(phi)
    dlat = F.degrees(dlat / (axis * (1.0 - ecc) / (w * F.sqrt(w))))
    dlng = F.degrees(dlng / (axis / F.sqrt(w) * F.cos(phi)))
    inside = lng.between(72.004, 137.8347) & lat.between(0.8293, 55.8271)
    return F.when(inside, lat + dlat).otherwise(lat), F.when(inside, lng + dlng).otherwise(lng)


def pseudorange(time_nanos: Column, full_bias: Column, bias: Column, sent_nanos: Column) -> Column:
    """Metres from receiver clock and satellite time; null without a clock or out of range."""
    received = (time_nanos - (full_bias + F.coalesce(bias, F.lit(0.0)))) % WEEK_NANOS
    received = F.when(received < 0, received + WEEK_NANOS).otherwise(received)
    gap = (received - sent_nanos) * 1e-9
    metres = F.when(gap < 0, gap + 604_800.0).otherwise(gap) * LIGHT_SPEED
    return F.when((metres > 0) & (metres <= 1e8), metres)


#: Satellite systems by number.
CONSTELLATIONS = {1: "GPS", 2: "SBAS", 3: "GLONASS", 4: "QZSS", 5: "BeiDou", 6: "Galileo", 7: "IRNSS"}
#: Bits of a measurement's state, the first that is set names it.
MEASUREMENT_STATES = {1: "CODE_LOCK", 2: "BIT_SYNC", 4: "SUBFRAME", 8: "TOW"}


def constellation(kind: Column) -> Column:
    out = F.lit("UNK")
    for number, name in CONSTELLATIONS.items():
        out = F.when(kind == number, name).otherwise(out)
    return out


def measurement_state(state: Column) -> Column:
    return F.coalesce(*[F.when(state.bitwiseAND(bit) != 0, name) for bit, name in MEASUREMENT_STATES.items()], F.lit("UNKNOWN"))


def signal_level(accuracy: Column, used: Column, visible: Column, max_cn0: Column) -> Column:
    """0 to 4: the better of what accuracy and satellites say. Unknown accuracy is null."""
    by_accuracy = F.when(accuracy <= 8, 4).when(accuracy <= 18, 3).when(accuracy <= 40, 2).when(accuracy.isNotNull(), 1).otherwise(0)
    by_sky = F.when((used >= 8) & (max_cn0 >= 35), 4).when((used >= 5) & (max_cn0 >= 28), 3).when((used >= 3) & (max_cn0 >= 22), 2)
    return F.greatest(by_accuracy, by_sky.when((visible > 0) | (max_cn0 > 0), 1).otherwise(0))


def screen(x: Column, y: Column, centre_x: Column, centre_y: Column, scale: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Screen position of a map point: pixels from the centre, by the width of the world in pixels."""
    return (x - centre_x) * scale + width / 2, (y - centre_y) * scale + height / 2


def in_frame(lat: Column, lng: Column, south: Column, west: Column, north: Column, east: Column, width: float, height: float, pad: float) -> tuple[Column, Column]:
    """Position in a drawing of fixed size, north up, with a border; a frame without extent is widened."""
    high, wide = F.greatest(north - south, F.lit(1e-6)), F.greatest(east - west, F.lit(1e-6))
    return pad + (lng - west) / wide * (width - 2 * pad), pad + (north - lat) / high * (height - 2 * pad)


def parent_tile(tx: Column, ty: Column, zoom: Column) -> Column:
    """Key of the tile one zoom level up; null at the top."""
    return F.when(zoom > 0, F.concat_ws("/", (zoom - 1).cast("string"), F.shiftright(tx, 1).cast("string"), F.shiftright(ty, 1).cast("string")))


def covering_tiles(x0: Column, y0: Column, x1: Column, y1: Column, zoom: Column) -> Column:
    """Tiles that a box of map points touches, as an array of (tx, ty); columns wrap, rows are clamped."""
    n = F.pow(F.lit(2.0), zoom).cast("long")
    cols = F.transform(F.sequence(F.floor(x0 * n).cast("long"), F.floor(x1 * n).cast("long")), lambda c: F.pmod(c, n))
    rows = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(y0 * n).cast("long")), F.least(n - 1, F.floor(y1 * n).cast("long")))
    return F.flatten(F.transform(cols, lambda c: F.transform(rows, lambda r: F.struct(c.alias("tx"), r.alias("ty")))))
