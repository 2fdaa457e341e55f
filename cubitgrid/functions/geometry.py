"""Geometry as column expressions: all of it stays in generated code or higher-order functions."""

from __future__ import annotations

from math import cos, pi, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree in the local equirectangular frame.
METRES_PER_DEGREE = 111_320.0
COS_OCTAGON, SIN_OCTAGON = cos(pi / 8), sin(pi / 8)
EARTH_RADIUS_M = 6_371_000.0


# frames and transforms


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of the frame's origin."""
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE


def from_local(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a place in the frame."""
    return lat0 + y / METRES_PER_DEGREE, lon0 + x / (METRES_PER_DEGREE * F.cos(F.radians(lat0)))


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Counter-clockwise about the origin."""
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def turned_box(x0: Column, y0: Column, x1: Column, y1: Column, angle: Column) -> tuple[Column, Column, Column, Column]:
    """The axis-aligned box around a box that is turned by an angle about the origin."""
    x, y = rotate((x0 + x1) / 2, (y0 + y1) / 2, angle)
    c, s = F.abs(F.cos(angle)), F.abs(F.sin(angle))
    w, h = ((x1 - x0) * c + (y1 - y0) * s) / 2, ((x1 - x0) * s + (y1 - y0) * c) / 2
    return x - w, y - h, x + w, y + h


def normal_angle(angle: Column) -> Column:
    """The direction of a rectangle's sides within [-45, 45) degrees, in radians."""
    turned = angle % (pi / 2)
    return F.when(turned >= pi / 4, turned - pi / 2).when(turned < -pi / 4, turned + pi / 2).otherwise(turned)


def snap(v: Column, grid: float) -> Column:
    """The nearest multiple of grid; halves go up, as floor(v + 0.5) does."""
    return F.floor(v / grid + 0.5) * grid


def map_poly(poly: Column, point) -> Column:
    """A nested multipolygon (parts, rings, points) with every point changed."""
    return F.transform(poly, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))


def poly_to_local(poly: Column, lat0: Column, lon0: Column) -> Column:
    """Points (x: longitude, y: latitude) in the frame's metres."""
    def point(p: Column) -> Column:
        x, y = to_local(p["y"], p["x"], lat0, lon0)
        return F.struct(x.alias("x"), y.alias("y"))

    return map_poly(poly, point)


def poly_from_local(poly: Column, lat0: Column, lon0: Column) -> Column:
    def point(p: Column) -> Column:
        lat, lon = from_local(p["x"], p["y"], lat0, lon0)
        return F.struct(lon.alias("x"), lat.alias("y"))

    return map_poly(poly, point)


def poly_rotate(poly: Column, angle: Column) -> Column:
    def point(p: Column) -> Column:
        x, y = rotate(p["x"], p["y"], angle)
        return F.struct(x.alias("x"), y.alias("y"))

    return map_poly(poly, point)


def all_points(poly: Column) -> Column:
    return F.flatten(F.flatten(poly))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring, counter-clockwise from the lower left corner."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def morton(x: Column, y: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """16 bits of each coordinate, scaled to the box and interleaved, x first."""
    def spread(v: Column, lo: Column, hi: Column) -> Column:
        n = F.floor((v - lo).cast("double") / F.greatest((hi - lo).cast("double"), F.lit(1.0)) * 65535).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
        return n

    return spread(x, minx, maxx).bitwiseOR(F.shiftleft(spread(y, miny, maxy), 1))


# distances


def span_gap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """How far two spans are apart; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), lo2 - hi, lo - hi2)


def octagon_near(dx: Column, dy: Column, gap: float) -> Column:
    """Whether rectangles dx, dy >= 0 apart touch once each is grown by the octagon around half a gap."""
    return F.greatest(dx * COS_OCTAGON + dy * SIN_OCTAGON, dx * SIN_OCTAGON + dy * COS_OCTAGON) <= gap


def point_segment(px: Column, py: Column, x1, y1, x2, y2) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.least(F.greatest(F.when(F.lit(0.0) + square > 0, ((px - x1) * dx + (py - y1) * dy) / square).otherwise(0.0), F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - x1 - t * dx, py - y1 - t * dy)


def octagon_gap(dx: Column, dy: Column, gap: float) -> Column:
    """Distance between the outlines of rectangles dx, dy >= 0 apart, each grown by the octagon around half a gap."""
    r = gap / COS_OCTAGON
    s = r * cos(pi / 4)
    out = F.least(point_segment(dx, dy, r, 0.0, s, s), point_segment(dx, dy, s, s, 0.0, r))
    return F.when(octagon_near(dx, dy, gap), 0.0).otherwise(out)


def segments_distance(a, b, c, d) -> Column:
    """Distance between segments ab and cd (pairs of columns): 0 if they properly cross, else the least of four."""
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    crossing = (cross(a, b, c) * cross(a, b, d) < 0) & (cross(c, d, a) * cross(c, d, b) < 0)
    return F.when(crossing, 0.0).otherwise(F.least(point_segment(*a, *c, *d), point_segment(*b, *c, *d), point_segment(*c, *a, *b), point_segment(*d, *a, *b)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


# convex hulls (open, counter-clockwise arrays of points) against each other


def turned_on(ring: Column) -> Column:
    """An open ring begun one point later."""
    return F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))


def _axes(hull: Column) -> Column:
    """Outward normals of a hull's sides."""
    return F.zip_with(hull, turned_on(hull), lambda p, q: F.struct((q["y"] - p["y"]).cast("double").alias("x"), (p["x"] - q["x"]).cast("double").alias("y")))


def octagon_reach(nx: Column, ny: Column, gap: float) -> Column:
    """How far the octagon around a gap reaches along an axis, times the axis's length."""
    x, y = F.abs(nx), F.abs(ny)
    return F.greatest(x, y, (x + y) * sqrt(0.5)) * (gap / COS_OCTAGON)


def hulls_near(a: Column, b: Column, gap: float) -> Column:
    """Whether two hulls touch once each is grown by the octagon around half a gap: no normal of a side of either, or of
    the octagon, separates them. With a gap of 0, whether the hulls themselves have a point in common."""
    octagon = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((COS_OCTAGON, SIN_OCTAGON), (SIN_OCTAGON, COS_OCTAGON), (COS_OCTAGON, -SIN_OCTAGON), (SIN_OCTAGON, -COS_OCTAGON))])
    along = lambda hull, n: F.transform(hull, lambda p: p["x"] * n["x"] + p["y"] * n["y"])

    def apart(n: Column) -> Column:
        one, other = along(a, n), along(b, n)
        return F.greatest(F.array_min(other) - F.array_max(one), F.array_min(one) - F.array_max(other)) > octagon_reach(n["x"], n["y"], gap)

    return ~F.exists(F.concat(_axes(a), _axes(b), octagon), apart)


def hulls_within(a: Column, b: Column, limit: float) -> Column:
    """Whether two hulls have a point in common or their sides come within a distance: a corner of the one is nearest then."""
    def from_corners(hull: Column, other: Column) -> Column:
        sides = F.zip_with(other, turned_on(other), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        return F.exists(hull, lambda c: F.exists(sides, lambda s: point_segment(c["x"], c["y"], s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]) <= limit))

    return from_corners(a, b) | from_corners(b, a) | hulls_near(a, b, 0.0)


# predicates and measures over rings


def _edges(ring: Column) -> Column:
    """Consecutive pairs of a closed ring's points."""
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, 1, n - 1).alias("p"), F.slice(ring, 2, n - 1).alias("q"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against one closed ring."""
    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return (((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])).cast("int")

    return F.aggregate(_edges(ring), F.lit(0), lambda acc, e: acc + F.when(e["p"]["y"] != e["q"]["y"], crosses(e)).otherwise(0)) % 2 == 1


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd test over all rings, so that holes count as outside."""
    return F.aggregate(F.transform(rings, lambda r: in_ring(x, y, r).cast("int")), F.lit(0), lambda acc, v: acc + v) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, positive if counter-clockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2


def in_convex(x: Column, y: Column, hull: Column) -> Column:
    """On or inside an open, counter-clockwise hull of three or more points."""
    turned = F.concat(F.slice(hull, 2, F.size(hull) - 1), F.slice(hull, 1, 1))
    left = F.zip_with(hull, turned, lambda p, q: (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]) >= 0)
    return (F.size(hull) >= 3) & F.forall(left, lambda v: v)


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point from a ring's boundary."""
    return F.array_min(F.transform(_edges(ring), lambda e: point_segment(x, y, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"])))


# tiles


def tile(lat: Column, lon: Column, zoom: int = 13) -> tuple[Column, Column, Column, Column]:
    """Web-Mercator tile and the pixel within it, by floor: (tile_x, tile_y, px, py)."""
    n = float(2**zoom)
    x = (lon + 180) / 360 * n
    rad = F.radians(lat)
    y = (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / pi) / 2 * n
    tx, ty = F.floor(x), F.floor(y)
    px, py = F.least(F.floor((x - tx) * 256), F.lit(255)), F.least(F.floor((y - ty) * 256), F.lit(255))
    return tuple(c.cast("int") for c in (tx, ty, px, py))


def pixel_elevation(red: Column, green: Column, blue: Column) -> Column:
    return red * 256 + green + blue / 256 - 32768


def octagon_points(r: float) -> list[tuple[float, float]]:
    """Corners of the octagon around a circle of radius r, counter-clockwise from due east."""
    far = r / cos(pi / 8)
    return [(far * cos(k * pi / 4), far * sin(k * pi / 4)) for k in range(8)]

