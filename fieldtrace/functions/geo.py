"""Geometry on latitudes and longitudes as column expressions. Angles are degrees, lengths metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; the root is clamped to 1 for antipodes."""
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2)))


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres with the cosine of the middle latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return EARTH * F.sqrt(x * x + y * y)


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference, with 111 320 m to a degree."""
    return (lon - lon0) * 111_320.0 * F.cos(F.radians(lat0)), (lat - lat0) * 111_320.0


#: Metres of a degree of a great circle on a sphere of the radius above.
ARC = EARTH * math.pi / 180


def frame_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference, on a sphere."""
    return (lon - lon0) * ARC * F.cos(F.radians(lat0)), (lat - lat0) * ARC


def plane_bearing(x: Column, y: Column) -> Column:
    """The bearing of a point of a local frame from its origin, from 0 up to 360; null within half a metre."""
    return F.when(F.sqrt(x * x + y * y) >= 0.5, F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from 0 up to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360.0, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """From 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def axial_angle(a: Column, b: Column) -> Column:
    """Between two axes without a sense, from 0 to 90."""
    d = angle_between(a, b)
    return F.when(d > 90, 180 - d).otherwise(d)


#: The sixteen points of the compass.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def compass(deg: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor((deg + 11.25) / 22.5) % 16 + 1).cast("int"))


def cell(lat: Column, lon: Column, per_degree: int) -> tuple[Column, Column]:
    """Indices of the grid cell of 1 / per_degree degrees."""
    return F.floor(lat * per_degree).cast("long"), F.floor(lon * per_degree).cast("long")


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Place in the unit square of the web map, from the north-west corner."""
    s = F.sin(F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), lat))))
    return lon / 360 + 0.5, 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def segment_place(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the segment a-b the point is closest, from 0 to 1; 0 for a segment of no length."""
    vx, vy = bx - ax, by - ay
    length = vx * vx + vy * vy
    return F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * vx + (py - ay) * vy) / length)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_place(px, py, ax, ay, bx, by)
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(dx * dx + dy * dy)


def circle_interval(cx: Column, cy: Column, radius: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The part of the segment, as parameters from 0 to 1, inside the circle; nulls if there is none."""
    vx, vy, wx, wy = bx - ax, by - ay, ax - cx, ay - cy
    a, b, c = vx * vx + vy * vy, 2 * (wx * vx + wy * vy), wx * wx + wy * wy - radius * radius
    inside = c <= 0
    disc = b * b - 4 * a * c
    low = F.when(a == 0, F.when(inside, 0.0)).when(disc >= 0, F.greatest(F.lit(0.0), (-b - F.sqrt(disc)) / (2 * a)))
    high = F.when(a == 0, F.when(inside, 1.0)).when(disc >= 0, F.least(F.lit(1.0), (-b + F.sqrt(disc)) / (2 * a)))
    return F.when(low <= high, low), F.when(low <= high, high)


def ring_area(ring: Column) -> Column:
    """Signed area (counter-clockwise positive) of a closed ring of points x, y."""
    n = F.size(ring)
    return F.aggregate(
        F.sequence(F.lit(1), n - 1),
        F.lit(0.0),
        lambda s, i: s + (F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"] - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"]) / 2,
    )


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a closed ring of points x, y, by the parity of crossings to its east."""

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0) + a["x"])

    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(False), lambda inside, i: inside != crosses(i))


def cone_ring(x: Column, y: Column, heading: Column, half: float, reach: float, steps: int = 8) -> Column:
    """A closed ring around a field of view: the point, then an arc of ``steps`` parts ``reach`` away."""
    arc = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.struct((x + reach * F.sin(F.radians(heading - half + k * (2 * half / steps)))).alias("x"), (y + reach * F.cos(F.radians(heading - half + k * (2 * half / steps)))).alias("y")))
    apex = F.array(F.struct(x.alias("x"), y.alias("y")))
    # the arc runs clockwise with the heading, so it is turned round for a counter-clockwise ring
    return F.concat(apex, F.reverse(arc), apex)


def disc_ring(x: Column, y: Column, radius: float, steps: int = 24) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.struct((x + radius * F.cos(k % steps * (2 * math.pi / steps))).alias("x"), (y + radius * F.sin(k % steps * (2 * math.pi / steps))).alias("y")))


def rotated(east: Column, north: Column, turn: Column) -> tuple[Column, Column]:
    """A vector turned clockwise by ``turn`` degrees."""
    c, s = F.cos(F.radians(turn)), F.sin(F.radians(turn))
    return east * c + north * s, north * c - east * s


def sun_events(day: Column, lat: Column, lon: Column, altitude: float = -0.833) -> tuple[Column, Column, Column]:
    """(rise, set, state) of the sun by the sunrise equation: times as epoch seconds, state ``day``, ``night`` or null."""
    n = F.datediff(day, F.lit("2000-01-01").cast("date")).cast("double") + 0.0008
    mean = n - lon / 360.0
    m = F.radians(F.pmod(357.5291 + 0.98560028 * mean, F.lit(360.0)))
    center = 1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)
    ecliptic = F.radians(F.pmod(F.degrees(m) + center + 180 + 102.9372, F.lit(360.0)))
    noon = 2451545.0 + mean + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * ecliptic)
    sin_d = F.sin(ecliptic) * F.sin(F.radians(F.lit(23.44)))
    cos_h = (F.sin(F.radians(F.lit(altitude))) - F.sin(F.radians(lat)) * sin_d) / (F.cos(F.radians(lat)) * F.sqrt(1 - sin_d * sin_d))
    half = F.when(F.abs(cos_h) <= 1, F.degrees(F.acos(cos_h)) / 360)
    seconds = lambda j: (j - 2440587.5) * 86400
    return seconds(noon - half), seconds(noon + half), F.when(cos_h < -1, "day").when(cos_h > 1, "night")


def ellipse(cxx: Column, cxy: Column, cyy: Column) -> tuple[Column, Column, Column]:
    """(semi-major, semi-minor, bearing of the major axis) of a covariance of east and north."""
    mid, dif = (cxx + cyy) / 2, (cxx - cyy) / 2
    root = F.sqrt(dif * dif + cxy * cxy)
    return F.sqrt(F.greatest(mid + root, F.lit(0.0))), F.sqrt(F.greatest(mid - root, F.lit(0.0))), F.pmod(90 - F.degrees(F.atan2(2 * cxy, cxx - cyy)) / 2, F.lit(180.0))
