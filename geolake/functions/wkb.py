"""Well-known binary: reader and writer of plain coordinate lists.

A geometry is (kind, coordinates): Point (x, y); LineString [points]; Polygon [rings]; the Multi kinds lists of these;
GeometryCollection a list of geometries. Coordinates beyond x and y are dropped, an empty point has NaNs, an unknown kind is an error.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = memoryview(data), at

    def geometry(self) -> tuple[str, list]:
        order = "<" if self.data[self.at] else ">"
        (word,) = struct.unpack_from(order + "I", self.data, self.at + 1)
        self.at += 5
        wide = 2
        if word & 0x20000000:  # a reference system's number follows
            self.at += 4
        wide += bool(word & 0x80000000) + bool(word & 0x40000000)
        code = word & 0x0FFFFFFF
        if code >= 1000:
            wide = 2 + (1 if code < 3000 else 2)
            code %= 1000
        if not 1 <= code <= 7:
            raise ValueError(f"unknown geometry type {code}")

        def count() -> int:
            (n,) = struct.unpack_from(order + "I", self.data, self.at)
            self.at += 4
            return n

        def points(n: int) -> list:
            flat = np.frombuffer(self.data, order + "f8", n * wide, self.at).reshape(n, wide)[:, :2]
            self.at += 8 * n * wide
            return [tuple(p) for p in flat.tolist()]

        kind = KINDS[code - 1]
        if code == 1:
            return kind, points(1)[0]
        if code == 2:
            return kind, points(count())
        if code == 3:
            return kind, [points(count()) for _ in range(count())]
        parts = [self.geometry() for _ in range(count())]
        return kind, parts if code == 7 else [c for _, c in parts]


def loads(data: bytes, at: int = 0) -> tuple[str, list]:
    return _Reader(bytes(data), at).geometry()


def dumps(kind: str, coordinates) -> bytes:
    """Little-endian."""
    code = KINDS.index(kind) + 1
    head = struct.pack("<BI", 1, code)
    line = lambda ps: struct.pack("<I", len(ps)) + np.asarray(ps, "<f8").tobytes()
    if code == 1:
        return head + struct.pack("<2d", *coordinates)
    if code == 2:
        return head + line(coordinates)
    if code == 3:
        return head + struct.pack("<I", len(coordinates)) + b"".join(map(line, coordinates))
    parts = [dumps(*p) for p in coordinates] if code == 7 else [dumps(kind[5:], p) for p in coordinates]
    return head + struct.pack("<I", len(parts)) + b"".join(parts)


def flat(kind: str, coordinates) -> list[tuple[float, float]]:
    """All points in order."""
    if kind == "Point":
        return [coordinates]
    if kind in ("LineString", "MultiPoint"):
        return list(coordinates)
    if kind in ("Polygon", "MultiLineString"):
        return [p for part in coordinates for p in part]
    if kind == "MultiPolygon":
        return [p for polygon in coordinates for ring in polygon for p in ring]
    return [p for g in coordinates for p in flat(*g)]


def envelope(xmin: float, ymin: float, xmax: float, ymax: float) -> bytes:
    """A box as a closed polygon of five points."""
    return dumps("Polygon", [[(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]])


def fixed(kind: str, coordinates: np.ndarray) -> pa.Array:
    """Geometries of one kind and one number of points from an array (rows, points, 2): a LineString each, or a Polygon of one closed ring."""
    rows, points, _ = coordinates.shape
    head = struct.pack("<BII", 1, 2, points) if kind == "LineString" else struct.pack("<BIII", 1, 3, 1, points)
    out = np.zeros((rows, len(head) + 16 * points), np.uint8)
    out[:, : len(head)] = np.frombuffer(head, np.uint8)
    out[:, len(head) :] = np.ascontiguousarray(coordinates, "<f8").view(np.uint8).reshape(rows, 16 * points)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, out.size + 1, max(1, out.shape[1]), dtype=np.int32)[: rows + 1]), pa.py_buffer(out)])


def envelopes(xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray) -> pa.Array:
    """Boxes as closed polygons of five points."""
    xy = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return fixed("Polygon", np.stack([np.stack(p, 1) for p in xy], 1))


def from_geojson(g: dict) -> tuple[str, list]:
    if g["type"] == "GeometryCollection":
        return g["type"], [from_geojson(x) for x in g["geometries"]]
    if g["type"] not in KINDS:
        raise ValueError(f"unknown geometry type {g['type']}")
    return g["type"], _cut(g["coordinates"])


def _cut(c: list) -> list | tuple[float, ...]:
    """Positions of a GeoJSON geometry without what lies beyond x and y."""
    return tuple(map(float, c[:2])) if c and not isinstance(c[0], list) else [_cut(x) for x in c]


def to_geojson(kind: str, coordinates) -> dict:
    if kind == "GeometryCollection":
        return {"type": kind, "geometries": [to_geojson(*g) for g in coordinates]}
    up = lambda c: list(c) if isinstance(c, tuple) else [up(x) for x in c]
    return {"type": kind, "coordinates": up(coordinates)}
