"""Geometry kernels on coordinate lists, and the Arrow functions that run them over WKB columns.

General polygon overlay is not here: intersections are with boxes or convex windows, unions are of polygons that don't overlap.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wkb

Point = tuple[float, float]


def bounds(kind: str, c) -> tuple[float, float, float, float] | None:
    ps = np.array(wkb.flat(kind, c), float).reshape(-1, 2)
    ps = ps[~np.isnan(ps).any(1)]
    return (*ps.min(0).tolist(), *ps.max(0).tolist()) if len(ps) else None


def signed_area(ring: list[Point]) -> float:
    a = np.asarray(ring, float)
    return float((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum() / 2) if len(a) > 2 else 0.0


def polygons(kind: str, c) -> list[list[list[Point]]]:
    return [c] if kind == "Polygon" else list(c) if kind == "MultiPolygon" else [p for g in c for p in polygons(*g)] if kind == "GeometryCollection" else []


def lines(kind: str, c) -> list[list[Point]]:
    return [c] if kind == "LineString" else list(c) if kind == "MultiLineString" else [p for g in c for p in lines(*g)] if kind == "GeometryCollection" else []


def area(kind: str, c) -> float:
    """Shells less holes, whatever way they turn."""
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in polygons(kind, c) if p)


def length(kind: str, c) -> float:
    """Of all lines."""
    return sum(float(np.hypot(*np.diff(np.asarray(p, float), axis=0).T).sum()) for p in lines(kind, c))


def side(kind: str, c, x: float, y: float) -> int:
    """1 inside a polygon (even-odd rule), 0 on a boundary, -1 outside."""
    inside = False
    for polygon in polygons(kind, c):
        odd = False
        for ring in polygon:
            a = np.asarray(ring, float)
            x1, y1, x2, y2 = a[:-1, 0], a[:-1, 1], a[1:, 0], a[1:, 1]
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if ((cross == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))).any():
                return 0
            over = (y1 > y) != (y2 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= bool(np.count_nonzero(over & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)) % 2)
        inside |= odd
    return 1 if inside else -1


def contains(kind: str, c, x: float, y: float) -> bool:
    """Even-odd rule; a point on a boundary is not contained."""
    return side(kind, c, x, y) > 0


def anchors(kind: str, c) -> list[Point]:
    """A point of every part."""
    if kind == "GeometryCollection":
        return [p for g in c for p in anchors(*g)]
    parts = {"Point": lambda: [c], "MultiPoint": lambda: c, "LineString": lambda: c[:1], "MultiLineString": lambda: [p[0] for p in c if p]}
    return list(parts[kind]()) if kind in parts else [p[0][0] for p in polygons(kind, c) if p and p[0]]


def points(kind: str, c) -> list[Point]:
    """What is a point by itself: neither of a line nor of a ring; an empty point isn't one."""
    found = [c] if kind == "Point" else c if kind == "MultiPoint" else [p for g in c for p in points(*g)] if kind == "GeometryCollection" else []
    return [p for p in found if not math.isnan(p[0])]


def _segments(kind: str, c) -> np.ndarray:
    paths = lines(kind, c) + [r for p in polygons(kind, c) for r in p]
    parts = [np.hstack([np.asarray(p, float)[:-1], np.asarray(p, float)[1:]]) for p in paths if len(p) > 1]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


#: Pairs of edges that are held against each other at once.
EDGE_PAIRS = 1 << 20


def intersects(a: tuple[str, list], b: tuple[str, list]) -> bool:
    """Whether two geometries share a point (closed): segments that meet, a part of one in the other, points of both that are the same.

    Edges are compared in blocks, so memory is bounded whatever their numbers.
    """
    s, t = (np.concatenate([_segments(*g), np.array([(*p, *p) for p in points(*g)], float).reshape(-1, 4)]) for g in (a, b))
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    if len(s) and len(t):
        step = max(1, EDGE_PAIRS // len(t))
        for i in range(0, len(s), step):
            u = s[i : i + step]
            p1, p2, q1, q2 = u[:, None, :2], u[:, None, 2:], t[None, :, :2], t[None, :, 2:]
            apart = (np.maximum(p1, p2) < np.minimum(q1, q2)).any(2) | (np.maximum(q1, q2) < np.minimum(p1, p2)).any(2)
            if (~apart & (turn(p1, p2, q1) * turn(p1, p2, q2) <= 0) & (turn(q1, q2, p1) * turn(q1, q2, p2) <= 0)).any():
                return True
    return any(side(*x, *p) >= 0 for x, y in ((a, b), (b, a)) if polygons(*x) for p in anchors(*y))


def is_empty(kind: str, c) -> bool:
    """No points at all; an empty point has NaNs."""
    return bounds(kind, c) is None


def separation(a: tuple[str, list], b: tuple[str, list]) -> float:
    """Least distance of two geometries in the plane: 0 if they meet, or else from a point of one to the other."""
    if intersects(a, b):
        return 0.0
    return min((distance(*y, *p) for x, y in ((a, b), (b, a)) for p in wkb.flat(*x)), default=math.inf)


def distance(kind: str, c, x: float, y: float) -> float:
    """From a point, in the plane; 0 inside a polygon."""
    if polygons(kind, c) and contains(kind, c, x, y):
        return 0.0
    s = _segments(kind, c)
    if not len(s):
        ps = np.asarray(wkb.flat(kind, c), float).reshape(-1, 2)
        return float(np.hypot(ps[:, 0] - x, ps[:, 1] - y).min()) if len(ps) else math.inf
    d = s[:, 2:] - s[:, :2]
    square = (d**2).sum(1)
    t = np.clip(((x - s[:, 0]) * d[:, 0] + (y - s[:, 1]) * d[:, 1]) / np.where(square > 0, square, 1), 0, 1)
    return float(np.hypot(s[:, 0] + t * d[:, 0] - x, s[:, 1] + t * d[:, 1] - y).min())


def simplify(path: list[Point], tolerance: float) -> list[Point]:
    """Keeps the ends and every point that lies further than the tolerance from the line between kept ones (Douglas-Peucker)."""
    a = np.asarray(path, float)
    keep = np.zeros(len(a), bool)
    keep[[0, -1]] = True
    todo = [(0, len(a) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        p, d = a[lo], a[hi] - a[lo]
        between = a[lo + 1 : hi] - p
        square = float(d @ d)
        t = np.clip(between @ d / square, 0, 1) if square else np.zeros(len(between))
        off = np.hypot(*(between - t[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[lo + 1 + k] = True
            todo += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return [tuple(p) for p in a[keep].tolist()]


def merge_lines(paths: list[list[Point]]) -> list[list[Point]]:
    """Join lines at ends where exactly two of them meet; junctions of three or more stay ends. Order doesn't matter."""
    paths = sorted([tuple(map(tuple, p)) for p in paths if len(p) > 1])
    ends: dict[Point, list[int]] = defaultdict(list)
    for i, p in enumerate(paths):
        ends[p[0]].append(i)
        ends[p[-1]].append(i)
    used = [False] * len(paths)

    def walk(i: int, at: Point) -> list[Point]:
        out = [at]
        while True:
            used[i] = True
            p = paths[i] if paths[i][0] == out[-1] else paths[i][::-1]
            out += p[1:]
            near = ends[out[-1]]
            following = [j for j in near if not used[j]]
            if len(near) != 2 or not following:
                return out
            i = following[0]

    merged = []
    for i, p in enumerate(paths):
        for at in (p[0], p[-1]):
            if not used[i] and len(ends[at]) != 2:
                merged.append(walk(i, at))
    for i, p in enumerate(paths):  # what is left are closed loops
        if not used[i]:
            merged.append(walk(i, p[0]))
    return merged


def clip_path(path: list[Point], box: tuple[float, float, float, float]) -> list[list[Point]]:
    """The parts of a line inside a box."""
    xmin, ymin, xmax, ymax = box
    out: list[list[Point]] = []
    for (x1, y1), (x2, y2) in zip(path, path[1:]):
        t0, t1, dx, dy = 0.0, 1.0, x2 - x1, y2 - y1
        for p, q in ((-dx, x1 - xmin), (dx, xmax - x1), (-dy, y1 - ymin), (dy, ymax - y1)):
            if p == 0:
                t1 = -1.0 if q < 0 else t1
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 > t1:
            continue
        a = (x1, y1) if t0 == 0 else (x1 + t0 * dx, y1 + t0 * dy)
        b = (x2, y2) if t1 == 1 else (x1 + t1 * dx, y1 + t1 * dy)
        if out and out[-1][-1] == a:
            out[-1].append(b)
        else:
            out.append([a, b])
    return out


def clip_convex(ring: list[Point], window: list[Point]) -> list[Point]:
    """A ring cut to a convex counter-clockwise window (Sutherland-Hodgman); empty if nothing is left."""
    for a, b in zip(window, window[1:] + window[:1]):
        if a != b:
            ring = _half_plane(ring, a, b)
    return ring


def difference_convex(rings: list[list[Point]], window: list[Point], sliver: float = 1e-12) -> list[list[Point]]:
    """Rings less a convex counter-clockwise window, as parts along its edges; parts of a smaller area than the sliver go.

    Part i lies outside edge i and inside the edges before it, so parts don't overlap.
    """
    edges = [(a, b) for a, b in zip(window, window[1:] + window[:1]) if a != b]
    out = []
    for rest in rings:
        for a, b in edges:
            out.append(_half_plane(rest, b, a))
            rest = _half_plane(rest, a, b)
    return [r for r in out if abs(signed_area(r)) > sliver]


def _half_plane(ring: list[Point], a: Point, b: Point) -> list[Point]:
    """What lies left of the line from a to b."""
    points = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in points]
    cut: list[Point] = []
    for k, (p, s) in enumerate(zip(points, side)):
        q, t = points[(k + 1) % len(points)], side[(k + 1) % len(points)]
        if s >= 0:
            cut.append(p)
        if s * t < 0:
            w = s / (s - t)
            cut.append((p[0] + w * (q[0] - p[0]), p[1] + w * (q[1] - p[1])))
    return [*cut, cut[0]] if len(cut) > 2 else []


def circle(x: float, y: float, metres: float, corners: int = 64) -> list[Point]:
    """The zone around a place as a closed ring."""
    west, south, _, _ = around(x, y, metres)
    turn = [2 * math.pi * k / corners for k in range(corners)]
    ring = [(x + (x - west) * math.cos(t), y + (y - south) * math.sin(t)) for t in turn]
    return [*ring, ring[0]]


def around(x: float, y: float, metres: float) -> tuple[float, float, float, float]:
    """Box of a half-width in metres around a place."""
    dy, dx = metres / 110_540, metres / (111_320 * math.cos(math.radians(y)))
    return x - dx, y - dy, x + dx, y + dy


def clip_geometry(kind: str, c, box: tuple[float, float, float, float]) -> tuple[str, list] | None:
    """Lines are cut to the box and fall into parts, None if nothing is left; other kinds stay as they are."""
    paths = lines(kind, c)
    if not paths:
        return kind, c
    parts = [p for path in paths for p in clip_path(path, box)]
    return None if not parts else ("LineString", parts[0]) if len(parts) == 1 else ("MultiLineString", parts)


def collect_polygons(parts: list[tuple[str, list]]) -> tuple[str, list]:
    """Polygons that don't overlap, such as islands and exclaves, as one geometry."""
    found = [p for g in parts for p in polygons(*g)]
    return ("Polygon", found[0]) if len(found) == 1 else ("MultiPolygon", found)


_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])


def _scalar(f: Callable, kind):
    """An Arrow function of a WKB column; null stays null."""

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else f(*wkb.loads(g)) for g in column], dtype=object if isinstance(kind, (T.StringType, T.BinaryType)) else None)

    return run


@F.pandas_udf(T.DoubleType())
def geo_area(column: pd.Series) -> pd.Series:
    """area() of a WKB column; null stays null."""
    from .arrange import areas  # which needs this module

    return pd.Series(areas(pa.array(column, pa.binary())), dtype=float)


geo_is_empty = _scalar(lambda kind, c: is_empty(kind, c), T.BooleanType())


@F.pandas_udf(T.DoubleType())
def geo_length(column: pd.Series) -> pd.Series:
    """length() of a WKB column; null stays null."""
    from .arrange import lengths  # which needs this module

    return pd.Series(lengths(pa.array(column, pa.binary())), dtype=float)


def geo_type(geometry: str) -> Column:
    """The kind of a WKB column, from its type word alone: no Python."""
    byte = lambda k: F.conv(F.hex(F.substring(geometry, k, 1)), 16, 10).cast("int")
    code = F.when(byte(1) == 1, byte(2) + byte(3) * 256).otherwise(byte(5) + byte(4) * 256) % 1000
    return F.get(F.array(*map(F.lit, wkb.KINDS)), code - 1)


@F.pandas_udf(T.BinaryType())
def geo_envelope(xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    """Boxes as polygons."""
    return pd.Series(wkb.envelopes(*(c.to_numpy(float) for c in (xmin, ymin, xmax, ymax))).to_pylist(), dtype=object)


@F.pandas_udf(_BOX)
def geo_bounds(column: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if g is None else bounds(*wkb.loads(g)) or (None,) * 4 for g in column]
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"], dtype=float)


@F.pandas_udf(T.BooleanType())
def geo_contains(column: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([g is not None and contains(*wkb.loads(g), a, b) for g, a, b in zip(column, x, y)])


@F.pandas_udf(T.DoubleType())
def geo_distance(column: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([math.nan if g is None else distance(*wkb.loads(g), a, b) for g, a, b in zip(column, x, y)])


@F.pandas_udf(T.BooleanType())
def geo_intersects(a: pd.Series, b: pd.Series) -> pd.Series:
    """Pairs of few geometries; large areas are better joined through their pieces. A geometry that a batch repeats is read once."""
    read = {g: wkb.loads(g) for c in (a, b) for g in c.dropna().unique()}
    return pd.Series([x is not None and y is not None and intersects(read[x], read[y]) for x, y in zip(a, b)])


def geo_within(origin: tuple[str, list], lon0: float, lat0: float, metres: float):
    """Whether a WKB column lies within so many metres of an origin of any kind (a line, an area), in the plane around a place."""
    east, north = 111_320 * math.cos(math.radians(lat0)), 110_540

    def flat(kind: str, c):
        if kind == "GeometryCollection":
            return kind, [flat(*g) for g in c]
        down = lambda p: ((p[0] - lon0) * east, (p[1] - lat0) * north) if isinstance(p, tuple) else [down(x) for x in p]
        return kind, down(c)

    start = flat(*origin)
    return _scalar(lambda kind, c: separation(start, flat(kind, c)) <= metres, T.BooleanType())


def geo_simplify(tolerance: float):
    """Lines simplified; other kinds stay."""

    def one(kind: str, c) -> bytes:
        paths = [simplify(p, tolerance) for p in lines(kind, c)]
        return wkb.dumps(kind, c) if not paths else wkb.dumps("LineString", paths[0]) if kind == "LineString" else wkb.dumps("MultiLineString", paths)

    return _scalar(one, T.BinaryType())


@F.pandas_udf(T.BinaryType())
def geo_from_geojson(column: pd.Series) -> pd.Series:
    """Texts of GeoJSON geometries as WKB; an unknown type is an error."""
    return pd.Series([None if text is None else wkb.dumps(*wkb.from_geojson(json.loads(text))) for text in column], dtype=object)


@F.pandas_udf(T.BinaryType())
def geo_merge_lines(column: pd.Series) -> pd.Series:
    """A column of lists of WKB lines: each list merged."""

    def one(parts) -> bytes:
        merged = merge_lines([p for g in parts for p in lines(*wkb.loads(g))])
        return wkb.dumps("LineString", merged[0]) if len(merged) == 1 else wkb.dumps("MultiLineString", merged)

    return pd.Series([None if parts is None else one(parts) for parts in column], dtype=object)


def register(spark) -> None:
    """The functions by name for SQL."""
    for name, f in (("geo_area", geo_area), ("geo_is_empty", geo_is_empty), ("geo_length", geo_length), ("geo_bounds", geo_bounds), ("geo_contains", geo_contains), ("geo_distance", geo_distance), ("geo_from_geojson", geo_from_geojson)):
        spark.udf.register(name, f)
