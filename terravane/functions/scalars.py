"""Integer geometry, time and coordinate functions as Catalyst expressions.

Coordinates are nanodegrees (bigint) or e7 (degrees times 10 million); distances are whole metres; times are seconds
after a service day's midnight and may pass 86400. Everything is integer arithmetic, so results don't depend on
the platform, and everything stays inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METERS_PER_DEGREE = 111320
#: Metres per degree of longitude that edge_m() takes for all latitudes.
EDGE_METERS_PER_DEGREE_LON = 68000
CELL_E7 = 50_000
E7 = 10_000_000


def lit(x: Column | int | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x).cast("bigint")


def div(a: Column | int, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", lit(a), lit(b))


def floor_div(a: Column, b: int) -> Column:
    """Integer division that rounds toward minus infinity; b is positive."""
    return div(a - F.pmod(a, F.lit(b).cast("bigint")), b)


def isqrt(x: Column) -> Column:
    """The integer square root, exact up to 2 ** 62: the double root, put right by one either way."""
    r = F.floor(F.sqrt(x.cast("double"))).cast("bigint")
    return F.when(r * r > x, r - 1).when((r + 1) * (r + 1) <= x, r + 1).otherwise(r)


def _cosines() -> Column:
    """round(cos(d degrees) * 1e6) for d from 0 to 90."""
    return F.array(*[F.lit(round(math.cos(math.radians(d)) * 1_000_000)).cast("bigint") for d in range(91)])


def cos_q6(abs_e7: Column) -> Column:
    """The cosine times a million of an absolute latitude, interpolated between whole degrees."""
    whole, part = div(abs_e7, E7), abs_e7 % E7
    table = _cosines()
    left, right = F.get(table, whole.cast("int")), F.get(table, whole.cast("int") + 1)
    return F.when(abs_e7 >= 90 * E7, F.lit(0).cast("bigint")).otherwise(left - div((left - right) * part, E7))


def meters_per_degree_lon(lat_e7: Column) -> Column:
    return div(METERS_PER_DEGREE * cos_q6(F.abs(lat_e7.cast("bigint"))) + 500_000, 1_000_000)


def direct_squared(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """The square of the metres between two e7 points, before the root is cut. Filters test this one: the root repeats its argument."""
    a, b, c, d = (x.cast("bigint") for x in (lat_a, lon_a, lat_b, lon_b))
    dy = div((c - a) * METERS_PER_DEGREE, E7)
    dx = div((d - b) * meters_per_degree_lon(div(a + c, 2)), E7)
    return dx * dx + dy * dy


def direct_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Metres between two e7 points; the mean latitude scales longitude. 0 for neighbours closer than a metre."""
    return isqrt(direct_squared(lat_a, lon_a, lat_b, lon_b))


def edge_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Metres of a walking edge: one scale of longitude for all latitudes, half a metre rounded up on each axis, 1 at least."""
    a, b, c, d = (x.cast("bigint") for x in (lat_a, lon_a, lat_b, lon_b))
    dx = div(F.abs(b - d) * EDGE_METERS_PER_DEGREE_LON + 5_000_000, E7)
    dy = div(F.abs(a - c) * METERS_PER_DEGREE + 5_000_000, E7)
    return F.greatest(isqrt(dx * dx + dy * dy), F.lit(1).cast("bigint"))


def walk_seconds(meters: Column) -> Column:
    """Seconds at 4.8 km/h, rounded up."""
    return div(meters * 3600 + 4799, 4800)


def walk_minutes(meters: Column) -> Column:
    return div(meters * 3 + 249, 250)


def cell(e7: Column) -> Column:
    """The transfer grid's cell of one axis."""
    return floor_div(e7.cast("bigint"), CELL_E7)


def e7_from_nano(nano: Column) -> Column:
    """e7 of nanodegrees, halves away from zero; null outside 32 bits."""
    v = div(nano + F.when(nano >= 0, F.lit(50)).otherwise(F.lit(-50)), 100)
    return F.when(v.between(-(1 << 31), (1 << 31) - 1), v)


def coord_text(value: Column, digits: int = 9) -> Column:
    """Decimal text of a fixed-point coordinate: 9 digits for nanodegrees, 7 for e7."""
    scale = 10**digits
    size = F.abs(value)
    return F.concat(F.when(value < 0, "-").otherwise(""), div(size, scale).cast("string"), F.lit("."), F.lpad((size % scale).cast("string"), digits, "0"))


def compass(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """One of eight directions; an axis twice the other decides alone."""
    dlat, dlon = lat_b - lat_a, lon_b - lon_a
    ns = F.when(dlat >= 0, "north").otherwise("south")
    ew = F.when(dlon >= 0, "east").otherwise("west")
    return F.when(F.abs(dlon) * 2 < F.abs(dlat), ns).when(F.abs(dlat) * 2 < F.abs(dlon), ew).otherwise(F.concat_ws("-", ns, ew))


def padded(low: Column, high: Column, least: int = 5_000_000) -> tuple[Column, Column]:
    """An interval with a tenth of its span on either side, least at least."""
    pad = F.greatest(div(high - low, 10), F.lit(least).cast("bigint"))
    return low - pad, high + pad


def area_score(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """The area of a box in square microdegrees, 1 for one without an extent."""
    span = lambda a, b: F.least(div(b - a, 1000) + 1, F.lit(0xFFFFFFFF).cast("bigint"))
    return F.when((max_lon <= min_lon) | (max_lat <= min_lat), F.lit(1).cast("bigint")).otherwise(span(min_lon, max_lon) * span(min_lat, max_lat))


def gap(min_a: Column, max_a: Column, min_b: Column, max_b: Column) -> Column:
    """What lies between two intervals; 0 where they meet."""
    return F.greatest(F.lit(0).cast("bigint"), min_b - max_a, min_a - max_b)


def image_height(width: int, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """The height of an image of a box that is width wide: longitude counts three fifths, 1 to 10 000; null for a box without an extent."""
    across = F.greatest(div((max_lon - min_lon) * 3 + 2, 5), F.lit(1).cast("bigint"))
    height = div((max_lat - min_lat) * width + div(across, 2), across)
    return F.when((max_lon > min_lon) & (max_lat > min_lat), F.greatest(F.lit(1), F.least(F.lit(10_000), height)).cast("int"))


def fnv1a32(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's bytes."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.filter(F.sequence(F.lit(0), div(F.length(hexed), 2).cast("int")), lambda i: i > 0), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.aggregate(bytes_, F.lit(2_166_136_261).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b) * 16_777_619, F.lit(1 << 32)))


# -- tiles


def tile_x(lon_nano: Column, zoom: int) -> Column:
    axis = 1 << zoom
    shifted = F.greatest(F.lit(0), F.least(F.lit(360_000_000_000), lon_nano + 180_000_000_000))
    return F.least(div(shifted * axis, 360_000_000_000), F.lit(axis - 1).cast("bigint"))


def tile_y(lat_nano: Column, zoom: int) -> Column:
    axis = 1 << zoom
    shifted = F.greatest(F.lit(0), F.least(F.lit(180_000_000_000), F.lit(90_000_000_000) - lat_nano))
    return F.least(div(shifted * axis, 180_000_000_000), F.lit(axis - 1).cast("bigint"))


def tile_bounds(x: Column, y: Column, zoom: int) -> dict[str, Column]:
    axis = 1 << zoom
    return {
        "min_lon": div(x * 360_000_000_000, axis) - 180_000_000_000,
        "max_lon": div((x + 1) * 360_000_000_000, axis) - 180_000_000_000,
        "min_lat": F.lit(90_000_000_000) - div((y + 1) * 180_000_000_000, axis),
        "max_lat": F.lit(90_000_000_000) - div(y * 180_000_000_000, axis),
    }


def tile_id(x: Column, y: Column, zoom: int) -> Column:
    return F.lit(zoom << 58).cast("bigint") + F.shiftleft(x.cast("bigint"), 29) + y


def route_tile_id(x: Column, y: Column) -> Column:
    """The metric grid's tile id."""
    return F.shiftleft(x.cast("bigint") + (1 << 28), 29).bitwiseOR(y.cast("bigint") + (1 << 28))


# -- time


def gtfs_seconds(text: Column) -> Column:
    """Seconds of H+:MM:SS with hours to 71; null for anything else."""
    part = lambda k: F.regexp_extract(text, r"^([0-9]{1,9}):([0-5][0-9]):([0-5][0-9])$", k)
    hours = part(1).try_cast("bigint")
    return F.when(hours <= 71, hours * 3600 + part(2).try_cast("bigint") * 60 + part(3).try_cast("bigint"))


def gtfs_e7(text: Column) -> Column:
    """e7 of a decimal coordinate, cut after seven digits; null beyond 180 or for anything else."""
    shape = r"^(-?)([0-9]{1,3})(?:\.([0-9]*))?$"
    t = F.trim(text)
    whole = F.regexp_extract(t, shape, 2).try_cast("bigint")
    part = F.substring(F.rpad(F.regexp_extract(t, shape, 3), 7, "0"), 1, 7).try_cast("bigint")
    v = whole * E7 + part
    return F.when(whole <= 180, F.when(F.regexp_extract(t, shape, 1) == "-", -v).otherwise(v))


def mode_of(route_type: Column) -> Column:
    """1 tram, 2 subway, 3 train, 4 bus, 5 other."""
    t = route_type
    return (
        F.when((t == 0) | t.between(900, 999), 1)
        .when((t == 1) | t.between(400, 499), 2)
        .when((t == 2) | t.between(100, 199), 3)
        .when((t == 3) | t.between(700, 799), 4)
        .otherwise(5)
    )


def mode_bit(mode: Column) -> Column:
    return F.when((mode < 1) | (mode > 31), F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), (mode - 1).cast("int"))).cast("bigint")


def mode_name(mode: Column) -> Column:
    return F.when(mode == 1, "tram").when(mode == 2, "subway").when(mode == 3, "train").when(mode == 4, "bus").otherwise("other")


def weekday_of(yyyymmdd: Column) -> Column:
    """0 for Monday of a date written as a number."""
    return F.weekday(F.make_date(div(yyyymmdd, 10000).cast("int"), (div(yyyymmdd, 100) % 100).cast("int"), (yyyymmdd % 100).cast("int")))


def clock(seconds: Column) -> Column:
    """HH:MM, with the days that a time lies after its service day."""
    days = div(seconds, 86400)
    hm = F.format_string("%02d:%02d", div(seconds % 86400, 3600), div(seconds % 3600, 60))
    return F.when(days > 0, F.concat(hm, F.lit(" (+"), days.cast("string"), F.lit("d)"))).otherwise(hm)


def parse_when(text: str) -> tuple[int, int]:
    """(date, seconds) of YYYY-MM-DDTHH:MM[:SS]."""
    import re

    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d)(?::(\d\d))?", text)
    if not m:
        raise ValueError(f"not a departure or arrival: {text!r}")
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups())
    if not (2000 <= y <= 2100 and 1 <= mo <= 12 and 1 <= d <= 31 and h <= 23 and mi <= 59 and s <= 59):
        raise ValueError(f"out of range: {text!r}")
    return y * 10000 + mo * 100 + d, h * 3600 + mi * 60 + s


def parse_bbox(text: str) -> tuple[int, int, int, int]:
    """Nanodegrees of MINLON,MINLAT,MAXLON,MAXLAT with up to nine fraction digits."""
    import re

    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError("a box has four coordinates")
    out = []
    for p in parts:
        m = re.fullmatch(r"(-?)(\d{1,3})(?:\.(\d{1,9}))?", p)
        if not m or int(m[2]) > 180:
            raise ValueError(f"not a coordinate: {p!r}")
        v = int(m[2]) * 1_000_000_000 + int((m[3] or "").ljust(9, "0"))
        out.append(-v if m[1] else v)
    if out[0] > out[2] or out[1] > out[3]:
        raise ValueError("a box's least coordinates come first")
    return tuple(out)
