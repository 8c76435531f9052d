"""Polygon pieces and exact joins against brute force: concave areas with holes and several parts, points on boundaries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.functions import kernels as k
from geolake.functions import wkb
from geolake.operators import pieces, spatial_join

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def star(rng, x, y, r, corners, lattice):
    """A ring around a place, concave as a rule, with corners on a lattice."""
    turn = [2 * math.pi * (i + 0.5 * rng.random()) / corners for i in range(corners)]
    ring = []
    for t in turn:
        s = r * rng.uniform(0.4, 1)
        p = (round((x + s * math.cos(t)) * lattice) / lattice, round((y + s * math.sin(t)) * lattice) / lattice)
        if p not in ring:
            ring.append(p)
    return [*ring, ring[0]]


def block(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def areas(rng, n):
    out = [("MultiPolygon", [[block(0, 0, 4, 4), block(1, 1, 2, 2)], [block(1.5, 1.5, 1, 1)], [[(5, 0), (9, 0), (9, 4), (8, 4), (8, 1), (6, 1), (6, 4), (5, 4), (5, 0)]]])]
    for _ in range(n):
        x, y = rng.uniform(-6, 6), rng.uniform(-6, 6)
        out.append(("Polygon", [star(rng, x, y, *rng.choice([(0.3, 6), (2, 24), (5, 40)]), 16)]))
    return out


def shapes(rng, n):
    spot = lambda: (round(rng.uniform(-7, 10) * 4) / 4, round(rng.uniform(-7, 7) * 4) / 4)
    near = lambda p: (p[0] + rng.randint(-3, 3) / 4, p[1] + rng.randint(-3, 3) / 4)
    line = lambda: [p := spot(), q := near(p), near(q)]  # noqa: E731, F841
    out = [("Point", spot()) for _ in range(n)] + [("LineString", line()) for _ in range(n)] + [("MultiLineString", [line(), line()]) for _ in range(n)] + [("MultiPoint", [spot(), spot()]) for _ in range(n)]
    out += [("Polygon", [block(*spot(), rng.randint(1, 8) / 4, rng.randint(1, 8) / 4)]) for _ in range(n)] + [("MultiPolygon", [[block(*spot(), 0.25, 0.25)], [block(*spot(), 0.25, 0.5)]]) for _ in range(n)]
    return out + [("Polygon", [block(-20, -20, 60, 60)]), ("Polygon", [block(-20, -20, 60, 60), block(-19, -19, 58, 58)]), ("GeometryCollection", [("Point", (2.0, 2.0)), ("LineString", [(50.0, 50.0), (51.0, 50.0)])]), ("Point", (4.0, 2.0)), ("LineString", [(1.0, 1.0), (3.0, 1.0)])]


def test_kernel_intersects_parts_and_boundaries():
    square = ("Polygon", [block(0, 0, 4, 4)])
    for g in (("MultiPolygon", [[block(9, 9, 1, 1)], [block(1, 1, 1, 1)]]), ("MultiPoint", [(9, 9), (1, 1)]), ("MultiLineString", [[(9, 9), (8, 8)], [(1, 1), (2, 2)]]), ("Point", (0, 2)), ("Point", (4, 4)), ("MultiPoint", [(9, 9), (4, 1)])):
        assert k.intersects(square, g) and k.intersects(g, square) and k.separation(square, g) == 0
    assert not k.intersects(square, ("MultiPoint", [(9, 9), (5, 5)])) and k.intersects(("Point", (1, 1)), ("MultiPoint", [(2, 2), (1, 1)])) and not k.intersects(("Point", (1, 1)), ("Point", (1, 2)))
    ring = ("Polygon", [block(0, 0, 4, 4), block(1, 1, 2, 2)])
    assert not k.intersects(ring, ("MultiPoint", [(2, 2)])) and k.intersects(ring, ("Point", (1, 2))) and not k.intersects(ring, ("LineString", [(1.5, 1.5), (2.5, 2.5)])) and k.intersects(ring, ("LineString", [(2, 2), (3, 3)]))


@pytest.mark.parametrize("most", [1, 4, 12])
def test_pieces_tile_the_area(most):
    rng = random.Random(most)
    for g in areas(rng, 12):
        rings = [r for p in k.polygons(*g) for r in p]
        found = list(pieces.pieces_of(rings, most))
        assert all(len(near) <= most or x1 - x0 < 2 * pieces.SMALLEST for x0, _, x1, _, _, _, near in found)
        whole = sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1, inside, *_ in found if inside)
        edge = sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1, inside, *_ in found if not inside)
        assert whole <= k.area(*g) * (1 + 1e-9) and k.area(*g) <= (whole + edge) * (1 + 1e-9)
        for x0, y0, x1, y1, _, corner, _ in found:
            assert corner == k.contains(*g, float(np.nextafter(x1, 99)), float(np.nextafter(y1, 99)))


def test_pieces_of_many_areas_are_those_of_each(monkeypatch):
    rng = random.Random(7)
    odd = [("Polygon", []), ("Polygon", [[(1.0, 1.0)]]), ("Polygon", [[(1.0, 1.0), (1.0, 1.0)]]), ("Polygon", [[(1.0, 1.0), (math.nan, 2.0), (3.0, 1.0), (4.0, 4.0), (1.0, 1.0)]])]
    found = [*areas(rng, 20), *odd]
    found += found[:3]  # repeated ones
    rings = [[r for p in k.polygons(*g) for r in p] for g in found]
    calls = []
    touching = pieces._touching
    monkeypatch.setattr(pieces, "_touching", lambda *a: calls.append(1) or touching(*a))
    plain = lambda ps: sorted((*p[:6], p[6].tolist()) for p in ps)
    every = {i: [] for i in range(len(found))}
    for i, *p in pieces.pieces_of([r for a in rings for r in a], 4, [i for i, a in enumerate(rings) for _ in a]):
        every[i].append(p)
    together = len(calls)
    assert [plain(every[i]) for i in every] == [plain(pieces.pieces_of(a, 4)) for a in rings]
    assert not every[21] and not every[22] and together * 5 < len(calls) - together


def test_subdivide_keeps_odd_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(pieces, "EDGE_PAIRS", 64)
    square, line = wkb.dumps("Polygon", [block(0.0, 0.0, 1.0, 1.0)]), wkb.dumps("LineString", [(0.0, 0.0), (1.0, 1.0)])
    d = spark.createDataFrame([(1, square), (1, square), (None, square), (2, None), (3, line), (4, wkb.dumps("Polygon", []))], "id int, geometry binary")
    got = [(r.id, len(r.edges)) for r in pieces.subdivide(d).collect()]
    own = [len(p[-1]) for p in pieces.pieces_of([block(0.0, 0.0, 1.0, 1.0)])]
    assert sorted(got, key=str) == sorted([(i, n) for i in (1, 1, None) for n in own], key=str)


def test_points_in_pieces(spark):
    rng = random.Random(2)
    found = areas(rng, 25)
    spots = [(i, round(rng.uniform(-8, 10) * f) / f, round(rng.uniform(-8, 8) * f) / f) for i, f in enumerate([16] * 400 + [7.3] * 300)]
    spots += [(1000 + i, *map(float, p)) for i, p in enumerate(q for g in found for q in wkb.flat(*g))]
    cut = pieces.subdivide(spark.createDataFrame([(j, wkb.dumps(*g)) for j, g in enumerate(found)] + [(99, None), (98, wkb.dumps("Point", (0, 0)))], "area int, geometry binary"), "area", most=4)
    points = spark.createDataFrame(spots, "p int, x double, y double")
    for boundary, least in ((True, 0), (False, 1)):
        want = sorted((i, j) for i, x, y in spots for j, g in enumerate(found) if k.side(*g, x, y) >= least)
        assert sorted((r.p, r.area) for r in pieces.points_in(points, cut, "x", "y", boundary).collect()) == want
    assert len(want) > 300


def test_meeting_is_brute_force(spark):
    rng = random.Random(4)
    home, every = areas(rng, 6), shapes(rng, 60)
    rows = [(f"s{i}", wkb.dumps(*g), tuple(map(float, k.bounds(*g)))) for i, g in enumerate(every)]
    left = spark.createDataFrame([*rows, ("null", None, (0.0, 0.0, 1.0, 1.0))], f"id string, geometry binary, bbox {BOX}")
    right = spark.createDataFrame([(wkb.dumps(*g), tuple(map(float, k.bounds(*g)))) for g in home], f"geometry binary, bbox {BOX}")
    want = {f"s{i}" for i, g in enumerate(every) if any(k.intersects(g, h) for h in home)}
    got = [r.id for r in pieces.meeting(left, right).collect()]
    assert sorted(got) == sorted(want) and 50 < len(want) < len(rows)
    assert pieces.meeting(left, right.limit(0)).count() == 0 == pieces.meeting(left.limit(0), right).count()


def test_boxes_of_all_sizes_have_few_entries(spark):
    rng = random.Random(5)
    rows = [(i, (x := rng.uniform(-170, 170), y := rng.uniform(-80, 80), x + s, y + s * rng.random())) for i, s in enumerate([0.0, 1e-6, 0.0003, 0.02, 1, 20, 90] * 30)]
    d = spark.createDataFrame(rows, f"id int, bbox {BOX}")
    entered = spatial_join._entered(d, "bbox", F.array(spatial_join.box_level("bbox")), "__l").groupBy("id").count()
    assert entered.count() == len(rows) and entered.agg(F.max("count")).first()[0] <= 4
    joined = spatial_join.overlap_join(d, d.select(F.col("id").alias("other"), F.col("bbox").alias("obox")), "bbox", "obox")
    want = sorted((i, j) for i, p in rows for j, q in rows if p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1])
    assert sorted((r.id, r.other) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pieces_join_carries_no_polygon(spark):
    cut = spark.createDataFrame([], "area int, cell struct<xmin:double,ymin:double,xmax:double,ymax:double>, inside boolean, corner boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    points = spark.range(3).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    plan = pieces.points_in(points, cut, "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "geometry" not in plan
