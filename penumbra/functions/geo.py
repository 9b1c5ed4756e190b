"""Geographic scalar functions as Column expressions; degrees in, metres out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius and metres in a degree of latitude; fixed values.
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bearing_change(before: Column, after: Column) -> Column:
    """Signed turn in (-180, 180]; to the right is positive."""
    turn = F.pmod(after - before, F.lit(360.0))
    return F.when(turn > 180, turn - 360).otherwise(turn)


def turn_class(turn: Column) -> Column:
    """Straight, slight, turn or sharp by the size of a turn; the limits 20, 50 and 120 degrees are fixed values."""
    size = F.abs(turn)
    side = F.when(turn > 0, "right").otherwise("left")
    return (
        F.when(size < 20, F.lit("straight"))
        .when(size < 50, F.concat(F.lit("slight_"), side))
        .when(size < 120, side)
        .otherwise(F.concat(F.lit("sharp_"), side))
    )


def local_xy(lon: Column, lat: Column, origin_lon: Column, origin_lat: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin on the tangent plane."""
    return (lon - origin_lon) * METRES_PER_DEGREE * F.cos(F.radians(origin_lat)), (lat - origin_lat) * METRES_PER_DEGREE


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Share t in [0, 1] along a segment nearest to a point, and the distance to it, in plane units."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0))))
    )
    return t, F.sqrt(F.pow(px - (ax + t * dx), F.lit(2)) + F.pow(py - (ay + t * dy), F.lit(2)))


def expand_bounds(south: Column, west: Column, north: Column, east: Column, metres: float) -> list[Column]:
    """Bounds grown by metres on every side; the cosine is at least 0.2 near the poles."""
    dlat = F.lit(metres / METRES_PER_DEGREE)
    dlon = dlat / F.greatest(F.lit(0.2), F.cos(F.radians((south + north) / 2)))
    return [south - dlat, west - dlon, north + dlat, east + dlon]


def boxes_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two (south, west, north, east) boxes share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2.0 * float(1 << zoom)).cast("long")


def tile_west(x: Column, zoom: int) -> Column:
    return x / float(1 << zoom) * 360.0 - 180.0


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - y * 2.0 / float(1 << zoom)))))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres; the equatorial radius is a fixed value."""
    return F.radians(lon) * 6378137.0, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * 6378137.0


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / 6378137.0), F.degrees(F.atan(F.exp(y / 6378137.0)) * 2.0 - math.pi / 2)


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """A digit a zoom level, from the bits of the tile numbers."""
    digits = [
        (F.shiftright(x, z).bitwiseAND(F.lit(1)) + F.shiftright(y, z).bitwiseAND(F.lit(1)) * 2).cast("string") for z in reversed(range(zoom))
    ]
    return F.concat(*digits)


def quadkey_tile(key: Column) -> Column:
    """Struct (x, y) of a quadkey."""
    digits = F.transform(F.filter(F.split(key, ""), lambda d: d != ""), lambda d: d.cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    return F.aggregate(
        digits,
        zero,
        lambda s, d: F.struct((s["x"] * 2 + d % 2).alias("x"), (s["y"] * 2 + F.floor(d / 2).cast("long")).alias("y")),
    )


def grid_cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _fold_ring(ring: Column, step, zero: Column) -> Column:
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), zero, lambda s, e: step(s, e["p"], e["q"]))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a ring of {x, y} structs, closed or not."""
    return _fold_ring(ring, lambda s, p, q: s + (p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0)) / 2.0


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of the points."""
    n = F.size(ring)
    return tuple(F.aggregate(ring, F.lit(0.0), lambda s, p, a=a: s + p[a]) / n for a in ("x", "y"))  # type: ignore[misc]


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule with half-open edges, so a shared edge belongs to one side only."""

    def step(inside: Column, p: Column, q: Column) -> Column:
        crosses = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.when(crosses & (x < at), ~inside).otherwise(inside)

    return _fold_ring(ring, step, F.lit(False))


def point_in_triangle(px: Column, py: Column, a: tuple, b: tuple, c: tuple) -> Column:
    """Whether a point lies in or on a triangle, by the signs of three cross products."""

    def cross(p, q):
        return (q[0] - p[0]) * (py - p[1]) - (q[1] - p[1]) * (px - p[0])

    sides = [cross(a, b), cross(b, c), cross(c, a)]
    return ~(F.least(*sides) < 0) | ~(F.greatest(*sides) > 0)


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, box: tuple) -> tuple[Column, Column]:
    """Parameters (t0, t1) of a segment's part inside (xmin, ymin, xmax, ymax); null where it misses the box."""
    dx, dy = bx - ax, by - ay
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    outside = F.lit(False)
    for d, p, least, most in ((dx, ax, box[0], box[2]), (dy, ay, box[1], box[3])):
        one, two = (least - p) / F.nullif(d, F.lit(0.0)), (most - p) / F.nullif(d, F.lit(0.0))
        low.append(F.coalesce(F.least(one, two), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(one, two), F.lit(1.0)))
        outside = outside | ((d == 0) & ((p < least) | (p > most)))
    t0, t1 = F.greatest(*low), F.least(*high)
    hit = ~outside & (t0 <= t1)
    return F.when(hit, t0), F.when(hit, t1)
