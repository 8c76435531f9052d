"""Geometry on coordinates as native expressions: boxes, points, segments and rings of (x, y) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in a degree for nearness (longitude by the cosine of the latitude) and for simplification.
METRES_LON, METRES_LAT, METRES_LOD = 111_320.0, 110_540.0, 111_320.0


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def intersects_view(b, west: float, south: float, east: float, north: float) -> Column:
    """Closed overlap of a box column (its name) with a view, as plain comparisons that reach the Parquet scan."""
    c = lambda f: F.col(f"{b}.{f}")
    return (c("xmin") <= east) & (c("xmax") >= west) & (c("ymin") <= north) & (c("ymax") >= south)


def contains_point(b, lon: float | Column, lat: float | Column) -> Column:
    c = lambda f: F.col(f"{b}.{f}")
    return (c("xmin") <= lon) & (c("xmax") >= lon) & (c("ymin") <= lat) & (c("ymax") >= lat)


def anchored_in(b, west: float, south: float, east: float, north: float) -> Column:
    """The box's lower corner lies in the view: prunes both ends, counts every box once."""
    return F.col(f"{b}.xmin").between(west, east) & F.col(f"{b}.ymin").between(south, north)


def centre_distance(b, lon0: float, lat0: float) -> Column:
    """Squared distance in degrees of the box's centre from a point, with longitudes shrunk by the latitude's cosine."""
    import math

    c = lambda f: F.col(f"{b}.{f}")
    dx, dy = (c("xmin") + c("xmax")) / 2 - lon0, (c("ymin") + c("ymax")) / 2 - lat0
    k = math.cos(math.radians(lat0))
    return dx * k * (dx * k) + dy * dy


def metres(lon: Column, lat: Column, lon0: float | Column, lat0: float | Column) -> tuple[Column, Column]:
    """Planar metres from an origin."""
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(lat0)
    return (lon - lon0) * METRES_LON * F.cos(F.radians(lat0)), (lat - lat0) * METRES_LAT


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def clip_segment(x1: Column, y1: Column, x2: Column, y2: Column, west: float | Column, south: float | Column, east: float | Column, north: float | Column) -> tuple[Column, Column]:
    """Parameters (t0, t1) of the part of a segment inside a box (Liang-Barsky); t0 > t1: nothing is inside."""
    dx, dy = x2 - x1, y2 - y1
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    sides = ((-dx, x1 - west), (dx, as_column(east) - x1), (-dy, y1 - south), (dy, as_column(north) - y1))
    enter = [F.when(p < 0, F.try_divide(q, p)) for p, q in sides]
    leave = [F.when(p > 0, F.try_divide(q, p)) for p, q in sides]
    beside = [F.when((p == 0) & (q < 0), F.lit(2.0)) for p, q in sides]
    return F.greatest(F.lit(0.0), *enter, *beside), F.least(F.lit(1.0), *leave)  # both skip nulls


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring of (x, y): positive if counter-clockwise."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside a closed ring (even-odd ray casting; points on the boundary are not defined)."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return F.when((a["y"] > y) != (b["y"] > y), x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)

    return F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0), lambda acc, i: acc + crosses(i).cast("int")) % 2 == 1


def _edges(ring: Column, found) -> Column:
    return F.exists(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: found(F.get(ring, i), F.get(ring, i + 1)))


def ring_meets_box(ring: Column, b: str) -> Column:
    """Whether a closed ring's area and a box (its column) share a point: an edge passes through the box, or the box lies inside."""
    c = lambda f: F.col(f"{b}.{f}")

    def passes(p: Column, q: Column) -> Column:
        t0, t1 = clip_segment(p["x"], p["y"], q["x"], q["y"], c("xmin"), c("ymin"), c("xmax"), c("ymax"))
        return t0 <= t1

    return _edges(ring, passes) | ring_contains(ring, c("xmin"), c("ymin"))


def segments_meet(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether two closed segments share a point; segments on one line meet where their boxes do."""
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    near = (F.greatest(ax, bx) >= F.least(cx, dx)) & (F.greatest(cx, dx) >= F.least(ax, bx)) & (F.greatest(ay, by) >= F.least(cy, dy)) & (F.greatest(cy, dy) >= F.least(ay, by))
    return near & (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) <= 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0)


def ring_meets_segment(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a closed ring's area and a segment share a point."""
    return _edges(ring, lambda p, q: segments_meet(p["x"], p["y"], q["x"], q["y"], x1, y1, x2, y2)) | ring_contains(ring, x1, y1)


def box_distance(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Distance of a point from a box in the plane; 0 inside."""
    dx, dy = F.greatest(xmin - x, F.lit(0.0), x - xmax), F.greatest(ymin - y, F.lit(0.0), y - ymax)
    return F.sqrt(dx * dx + dy * dy)
