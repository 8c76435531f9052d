"""Overlay and union against counting on a lattice: concave areas with holes and parts, shared borders, areas in areas."""

import random

import numpy as np
import pyarrow as pa
import pytest

from geolake.functions import kernels as k
from geolake.functions import wkb
from geolake.operators import overlay
from tests.test_pieces import BOX, block

#: A concave area with a hole and an island; all edges run along the lattice or its diagonals.
SHAPE = [[[(0, 0), (20, 0), (20, 6), (12, 6), (12, 10), (16, 14), (4, 14), (0, 10), (0, 0)], [(4, 2), (8, 2), (8, 4), (4, 4), (4, 2)]], [[(17, 8), (21, 8), (19, 10), (17, 8)]]]


def placed(x, y, mirrored=False, unit=0.25):
    c = [[[(float((x + (22 - a if mirrored else a)) * unit), float((y + b) * unit)) for a, b in ring] for ring in polygon] for polygon in SHAPE]
    return "MultiPolygon", c


def quarters(g, unit=0.25):
    """The quarter cells of the lattice that an area holds, by their middles."""
    x0, y0, x1, y1 = k.bounds(*g)
    found = set()
    for i in range(int(x0 / unit) - 1, int(x1 / unit) + 2):
        for j in range(int(y0 / unit) - 1, int(y1 / unit) + 2):
            for q, (dx, dy) in enumerate(((0.5, 1 / 6), (5 / 6, 0.5), (0.5, 5 / 6), (1 / 6, 0.5))):
                if k.contains(*g, (i + dx) * unit, (j + dy) * unit):
                    found.add((i, j, q))
    return found


def frame(spark, rows, key):
    return spark.createDataFrame([(i, wkb.dumps(*g), tuple(map(float, k.bounds(*g)))) for i, g in rows], f"{key} int, geometry binary, bbox {BOX}")


def checked(row):
    """A result's quarters; its rings are closed and turn as they should, its area is that of the quarters."""
    g = wkb.loads(row.geometry)
    assert row.open == 0
    for polygon in k.polygons(*g):
        assert all(r[0] == r[-1] and len(set(r)) == len(r) - 1 for r in polygon)
        assert k.signed_area(polygon[0]) > 0 and all(k.signed_area(h) < 0 for h in polygon[1:])
    found = quarters(g)
    assert abs(k.area(*g) - len(found) / 64) < 1e-9
    return found


@pytest.fixture(scope="module")
def layers():
    rng = random.Random(1)
    a = [(i, placed(rng.randrange(0, 60), rng.randrange(0, 40), rng.random() < 0.5)) for i in range(8)]
    b = [(i, placed(rng.randrange(0, 60), rng.randrange(0, 40), rng.random() < 0.5)) for i in range(10)]
    b += [(20, a[0][1]), (21, ("Polygon", [block(0.0, 0.0, 2.0, 2.0)])), (22, ("Polygon", [block(2.0, 0.0, 2.0, 1.0)])), (23, ("Polygon", [block(-50.0, -50.0, 200.0, 200.0), block(1.0, 1.0, 3.0, 3.0)]))]
    return a, b


def test_intersection_and_difference(spark, layers):
    a, b = layers
    left, right = frame(spark, a, "id"), frame(spark, b, "other")
    qa, qb = {i: quarters(g) for i, g in a}, {j: quarters(g) if j != 23 else None for j, g in b}
    hole = quarters(b[-1][1][0:1] and ("Polygon", [block(1.0, 1.0, 3.0, 3.0)]))
    shared = lambda i, j: qa[i] - hole if j == 23 else qa[i] & qb[j]
    got = {(r.id, r.other): checked(r) for r in overlay.intersection(left, right).collect()}
    assert got == {(i, j): shared(i, j) for i in qa for j in qb if shared(i, j)} and len(got) > 20
    some = right.where("other != 23")
    got = {r.id: checked(r) for r in overlay.difference(left, some).collect()}
    want = {i: qa[i] - set().union(*(qb[j] for j in qb if j != 23)) for i in qa}
    assert got == {i: q for i, q in want.items() if q}
    got = {r.id: checked(r) for r in overlay.difference(left, right).collect()}
    assert got == {i: q & hole for i, q in want.items() if q & hole}
    assert overlay.difference(left.limit(0), right).count() == 0 == overlay.intersection(left, right.limit(0)).count()
    assert {r.id: checked(r) for r in overlay.difference(left, right.limit(0)).collect()} == qa


def test_union(spark, layers):
    a, b = layers
    rows = [(i, g, i % 2) for i, g in a] + [(100 + j, g, 2) for j, g in b if j != 23]
    # borders shared in part, areas that meet in a corner, a ring closed by two areas, an area in another's hole
    blocks = [block(0.0, 0.0, 4.0, 1.0), block(0.0, 1.0, 1.0, 3.0), block(3.0, 0.5, 1.0, 3.5), block(1.0, 3.0, 2.0, 1.0), block(4.0, 4.0, 1.0, 1.0), block(1.5, 1.5, 0.5, 0.5)]
    rows += [(200 + n, ("Polygon", [r if n % 2 else r[::-1]]), 3) for n, r in enumerate(blocks)]
    d = spark.createDataFrame([(i, wkb.dumps(*g), p) for i, g, p in rows] + [(999, None, 3), (998, wkb.dumps("Polygon", [block(0.0, 0.0, 1.0, 1.0)]), None)], "id int, geometry binary, part int")
    found = {r.part: r for r in overlay.union(d, "part").collect()}
    assert {p: checked(r) for p, r in found.items()} == {p: set().union(*(quarters(g) for _, g, q in rows if q == p)) for p in range(4)}
    shells = k.polygons(*wkb.loads(found[3].geometry))
    assert sorted(len(s) for s in shells) == [1, 1, 2]  # the ring with its hole, the block in the hole, the one at the corner


def test_overlay_of_any_coordinates(spark):
    """Areas of turned squares: parts add up to the whole."""
    rng = np.random.default_rng(4)
    t = lambda x, y, r, s: ("Polygon", [[(x + r * np.cos(s + n * np.pi / 2), y + r * np.sin(s + n * np.pi / 2)) for n in (0, 1, 2, 3, 0)]])
    fix = lambda g: (g[0], [[*map(lambda p: tuple(map(float, p)), g[1][0][:-1]), tuple(map(float, g[1][0][0]))]])
    a = [(i, fix(t(*rng.uniform(0, 10, 2), rng.uniform(0.5, 2), rng.uniform(0, 6)))) for i in range(20)]
    b = [(i, fix(t(*rng.uniform(0, 10, 2), rng.uniform(0.5, 2), rng.uniform(0, 6)))) for i in range(20)]
    left, right = frame(spark, a, "id"), frame(spark, b, "other")
    both = overlay.union(right.withColumn("all", right.other * 0), "all", key="other").collect()
    assert len(both) == 1 and both[0].open == 0
    one = frame(spark, [(0, wkb.loads(both[0].geometry))], "other")
    wet = {r.id: k.area(*wkb.loads(r.geometry)) for r in overlay.intersection(left, one).collect()}
    dry = {r.id: k.area(*wkb.loads(r.geometry)) for r in overlay.difference(left, right).collect()}
    for i, g in a:
        assert abs(wet.get(i, 0) + dry.get(i, 0) - k.area(*g)) < 1e-9
    assert len(wet) > 10


def test_trace_of_touching_rings():
    square = lambda x, y: [(x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)]
    kind, c, lost = overlay.trace(np.array(square(0, 0) + square(1, 1), float))
    assert kind == "MultiPolygon" and len(c) == 2 and lost == 0
    shell = [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)]
    hole = [(0, 0, 1, 2), (1, 2, 2, 1), (2, 1, 0, 0)]  # touches the shell in a corner
    kind, c, lost = overlay.trace(np.array(shell + hole, float))
    assert kind == "Polygon" and len(c) == 2 and lost == 0 and abs(k.area(kind, c) - 14.5) < 1e-12
    assert overlay.trace(np.array(shell[:3], float))[1:] == ([], 3)


def test_edges_of_alike_areas_are_read_at_once(spark, monkeypatch):
    shell, hole = block(0.0, 0.0, 4.0, 4.0), block(1.0, 1.0, 2.0, 2.0)
    found = [("Polygon", [shell, hole]), ("Polygon", [shell[::-1], hole[::-1]]), placed(3, 5), placed(3, 5, True), ("Polygon", [[(0.0, 0.0), (0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]])]
    odd = [("Point", (1.0, 2.0)), ("Polygon", []), ("MultiPolygon", []), ("GeometryCollection", [("Polygon", [shell]), ("Point", (1.0, 2.0))])]
    d = spark.createDataFrame([(i, wkb.dumps(*g)) for i, g in enumerate([*found, *odd])] + [(0, None), (None, wkb.dumps(*found[0]))], "id int, geometry binary")
    want = []
    for i, g in [*enumerate([*found, *odd]), (None, found[0])]:
        for polygon in k.polygons(*g):
            for n, r in enumerate(polygon):
                r = r[::-1] if (k.signed_area(r) < 0) != (n > 0) else r
                want += [(i, *a, *b) for a, b in zip(r, r[1:]) if a != b]
    assert sorted(map(tuple, overlay.edges_of(d, "id").collect()), key=str) == sorted(want, key=str)

    class Areas:
        schema = d.schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(wkb, "loads", None)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int32()), pa.array([wkb.dumps(*g) for g in found], pa.binary())], ["id", "geometry"])
    assert sum(b.num_rows for b in overlay.edges_of(Areas(), "id")(iter([batch]))) == sum(w[0] is not None and w[0] < 5 for w in want)
