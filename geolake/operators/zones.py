"""Zones around geometries of any kind: what lies within a distance, with round joins and ends.

The zone of a segment is the hull of the same many-cornered disc at both of its ends, the zone of a geometry the union of
those of its segments and of the geometry's own areas. Discs at a joint have the very same corners, so that the union, a join
over edges (see overlay), meets no arcs that nearly coincide. Segments are rows: a long line is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolake.functions import kernels, wkb
from geolake.functions.geometry import METRES_LAT, METRES_LON

from geolake.sources.shared import stored

from . import overlay

CORNERS = 64


def capsule(ax: float, ay: float, bx: float, by: float, disc: np.ndarray) -> list[tuple[float, float]]:
    """The hull of a disc (corners counter-clockwise, as many on either side of any line through its middle) at both ends of a segment, as a closed ring."""
    a, b = (ax, ay), (bx, by)
    if a == b:
        ring = [(ax + x, ay + y) for x, y in disc.tolist()]
    else:
        n, left = len(disc), np.array([ay - by, bx - ax])
        i, j = int((disc @ left).argmax()), int((disc @ -left).argmax())
        around = lambda p, lo, hi: [(p[0] + x, p[1] + y) for x, y in disc[[(lo + k) % n for k in range((hi - lo) % n + 1)]].tolist()]
        ring = around(b, j, i) + around(a, i, j)
    out = [p for k, p in enumerate(ring) if p != ring[k - 1]]
    return [*out, out[0]]


def zones(shapes: DataFrame, key: str = "id", geometry: str = "geometry", metres: float | None = None, degrees: float | None = None, corners: int = CORNERS) -> DataFrame:
    """(key, geometry): everything within so many metres (or degrees) of each WKB geometry, as a polygon or polygons.

    Corners lie on the distance, so a zone is a little smaller than a true one: by at most 1 - cos(pi / corners) of the distance.
    Metres are taken at the latitude in the middle of a geometry. Keys are distinct; rows with a null key, or a null or empty geometry, have no
    zone. corners is even and at least 4.
    """
    if (metres is None) == (degrees is None) or corners < 4 or corners % 2:
        raise ValueError("one of metres and degrees, and an even number of corners from 4 on")
    schema = shapes.schema[key].dataType.simpleString()
    turn = 2 * math.pi * np.arange(corners) / corners
    # corners of a diamond are on whole numbers
    unit = np.round(np.stack([np.cos(turn), np.sin(turn)], 1), 15)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rings = [], []
            for i, g in enumerate(b.column(1).to_pylist()):
                shape = wkb.loads(g)
                box = kernels.bounds(*shape)
                if box is None:
                    continue
                r = np.array([degrees, degrees]) if metres is None else np.array([metres / (METRES_LON * math.cos(math.radians((box[1] + box[3]) / 2))), metres / METRES_LAT])
                disc = unit * r
                paths = [*kernels.lines(*shape), *(ring for p in kernels.polygons(*shape) for ring in p), *([p, p] for p in kernels.points(*shape))]
                found = dict.fromkeys((min(p, q), max(p, q)) for path in paths for p, q in zip(path, path[1:]))
                own = [[capsule(*p, *q, disc)] for p, q in found] + [p for p in kernels.polygons(*shape) if p]
                at += [i] * len(own)
                rings += [wkb.dumps("Polygon", p) for p in own]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(rings, pa.binary())], [key, "geometry"])

    d = shapes.where(F.col(key).isNotNull() & F.col(geometry).isNotNull()).select(key, geometry)
    parts = stored(d.mapInArrow(draw, f"`{key}` {schema}, geometry binary").withColumn("part", F.monotonically_increasing_id()), "capsules")
    return overlay.union(parts, key, key="part").select(key, "geometry")
