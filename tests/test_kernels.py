import math

import numpy as np
import pytest

from geolake.functions import kernels as k
from geolake.functions import wkb


def test_wkb_goldens():
    at = np.array([137.5, 36.25], "<f8").tobytes()
    little, srid = b"\x01" + (1).to_bytes(4, "little") + at, b"\x01" + (0x20000001).to_bytes(4, "little") + (4326).to_bytes(4, "little") + at
    assert wkb.loads(little) == wkb.loads(srid) == ("Point", (137.5, 36.25))
    part = lambda x, y: b"\x01" + (1).to_bytes(4, "little") + np.array([x, y], "<f8").tobytes()
    assert wkb.loads(b"\x01" + (4).to_bytes(4, "little") + (2).to_bytes(4, "little") + part(5, -6) + part(7, 8)) == ("MultiPoint", [(5, -6), (7, 8)])
    assert wkb.loads(b"xx" + little, 2)[0] == "Point"
    z = b"\x01" + (1003).to_bytes(4, "little") + (1).to_bytes(4, "little") + (3).to_bytes(4, "little") + np.array([[0, 0, 9], [1, 0, 9], [0, 0, 9]], "<f8").tobytes()
    assert wkb.loads(z) == ("Polygon", [[(0, 0), (1, 0), (0, 0)]])
    with pytest.raises(ValueError):
        wkb.loads(b"\x01\x09\x00\x00\x00")


@pytest.mark.parametrize("kind, c", [
    ("Point", (1.0, 2.0)), ("LineString", [(0.0, 0.0), (1.0, 1.0)]), ("Polygon", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]),
    ("MultiLineString", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]), ("MultiPolygon", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]),
    ("GeometryCollection", [("Point", (1.0, 2.0)), ("LineString", [(0.0, 0.0), (1.0, 1.0)])]),
])
def test_round_trip(kind, c):
    assert wkb.loads(wkb.dumps(kind, c)) == (kind, c)
    assert wkb.from_geojson(wkb.to_geojson(kind, c)) == (kind, c)


SQUARE = ("Polygon", [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]])


def test_polygons():
    assert k.area(*SQUARE) == 96
    assert k.contains(*SQUARE, 1, 1) and not k.contains(*SQUARE, 5, 5) and not k.contains(*SQUARE, 0, 5) and not k.contains(*SQUARE, 11, 5)
    assert k.distance(*SQUARE, 13, 14) == 5 and k.distance(*SQUARE, 1, 1) == 0 and k.distance(*SQUARE, 5, 5) == 1
    assert k.intersects(SQUARE, ("LineString", [(-5, 5), (2, 5)])) and not k.intersects(SQUARE, ("LineString", [(4.5, 5), (5.5, 5)]))
    assert k.intersects(SQUARE, ("Polygon", [[(1, 1), (2, 1), (2, 2), (1, 1)]]))
    assert k.bounds(*SQUARE) == (0, 0, 10, 10) and k.bounds("Point", (math.nan, math.nan)) is None
    cut = k.clip_convex(SQUARE[1][0], [(5, -5), (20, -5), (20, 20), (5, 20)])
    assert abs(k.signed_area(cut)) == 50


def test_clip():
    box = (0, 0, 10, 10)
    assert k.clip_path([(1, 1), (2, 2)], box) == [[(1, 1), (2, 2)]]
    assert k.clip_path([(-10, 5), (20, 5)], box) == [[(0, 5), (10, 5)]]
    assert k.clip_path([(2, 5), (2, 20), (8, 20), (8, 5)], box) == [[(2, 5), (2, 10)], [(8, 10), (8, 5)]]
    assert k.clip_geometry("LineString", [(20, 20), (30, 30)], box) is None and k.clip_geometry("Point", (50, 50), box) == ("Point", (50, 50))
    w, s, e, n = k.around(139.77, 35.68, 1500)
    assert abs((n - s) * 110_540 - 3000) < 1 and e - w > n - s


def test_lines():
    assert k.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 0.1) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    merged = k.merge_lines([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(2, 0), (3, 0)], [(2, 0), (2, 1)]])
    assert sorted(map(len, merged)) == [2, 2, 3]
    assert k.merge_lines([[(0, 0), (1, 0)], [(1, 0), (1, 1)], [(1, 1), (0, 0)]])[0][0] == k.merge_lines([[(0, 0), (1, 0)], [(1, 0), (1, 1)], [(1, 1), (0, 0)]])[0][-1]


def test_fixed_layouts():
    got = wkb.envelopes(np.array([0.0, 5]), np.array([1.0, 6]), np.array([2.0, 7]), np.array([3.0, 8])).to_pylist()
    assert got == [wkb.envelope(0, 1, 2, 3), wkb.envelope(5, 6, 7, 8)] and wkb.envelopes(*[np.zeros(0)] * 4).to_pylist() == []
    assert wkb.fixed("LineString", np.array([[[0.0, 1], [2, 3]]])).to_pylist() == [wkb.dumps("LineString", [(0, 1), (2, 3)])]


def test_separation():
    line = ("LineString", [(0.0, 0.0), (10.0, 0.0)])
    assert k.separation(line, ("LineString", [(5.0, 3.0), (5.0, 9.0)])) == 3 and k.separation(line, ("LineString", [(5.0, -1.0), (5.0, 1.0)])) == 0
    assert k.separation(SQUARE, ("Point", (13.0, 14.0))) == 5 and k.separation(("Point", (5.0, 5.0)), SQUARE) == 1 and k.separation(line, SQUARE) == 0
    assert k.is_empty("MultiLineString", []) and k.is_empty("Point", (math.nan, math.nan)) and not k.is_empty(*line)


def test_native_predicates(spark):
    from pyspark.sql import functions as F

    from geolake.functions import geometry as g
    from geolake.operators import aggregates as agg

    rng = np.random.default_rng(3)
    ring = [(0.0, 0.0), (4.0, 1.0), (5.0, 5.0), (2.0, 3.0), (-1.0, 4.0), (0.0, 0.0)]  # not convex
    rows = [(i, tuple(map(float, (x, y, x + w, y + h)))) for i, (x, y, w, h) in enumerate(zip(rng.uniform(-3, 6, 300), rng.uniform(-3, 6, 300), rng.uniform(0, 2, 300), rng.uniform(0, 2, 300)))]
    d = spark.createDataFrame(rows, "i long, b struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    shape = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    got = d.select("i", g.ring_meets_box(shape, "b").alias("box"), g.ring_meets_segment(shape, *[F.col(f"b.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).alias("line")).collect()
    for r, (_, (x1, y1, x2, y2)) in zip(sorted(got, key=lambda r: r.i), rows):
        assert r.box == k.intersects(("Polygon", [ring]), wkb.loads(wkb.envelope(x1, y1, x2, y2))) and r.line == k.intersects(("Polygon", [ring]), ("LineString", [(x1, y1), (x2, y2)]))
    # squares that share edges: the boundary of a ring of eight of them around a hole, and of one apart
    squares = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(9, 9)]
    ringed = spark.createDataFrame([("a", [(x + a, y + b) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]) for x, y in squares], "key string, ring array<struct<x:double,y:double>>")
    edges = agg.boundary(ringed, "key", "ring")
    assert edges.count() == 12 + 4 + 4 and abs(edges.agg(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).first()[0] - 9) < 1e-9
    numbered = agg.places(spark.range(50).withColumn("v", (F.col("id") * 7 % 10).cast("double")), "v", "id", F.floor(F.col("v") / 3)).collect()
    assert [r.id for r in sorted(numbered, key=lambda r: r.place)] == [r.id for r in sorted(numbered, key=lambda r: (r.v, r.id))] and sorted(r.place for r in numbered) == list(range(50))
    near = spark.createDataFrame([(wkb.dumps("Point", (139.01, 35.0)),), (wkb.dumps("Point", (139.2, 35.0)),), (None,)], "g binary")
    assert [r[0] for r in near.select(k.geo_within(("LineString", [(139.0, 34.9), (139.0, 35.1)]), 139.0, 35.0, 2000)("g")).collect()] == [True, False, None]
    with pytest.raises(Exception, match="totals"):
        agg.check_totals([near.select(F.lit(3).alias("population"))], near.select(F.lit(4).alias("population"))).collect()
