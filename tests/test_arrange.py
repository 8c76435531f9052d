"""Areas of many groups united and overlaid at once: every way gives the same, against counting on a lattice."""

import random

import numpy as np
import pyarrow as pa
import pytest

from geolake.functions import arrange, wkb
from geolake.functions import kernels as k
from geolake.operators import overlay, zones
from tests.test_overlay import checked, placed, quarters
from tests.test_pieces import block


@pytest.mark.parametrize("way", ["together", "tiles", "rows"])
def test_union_in_each_way(spark, monkeypatch, way):
    rng = random.Random(21)
    rows = [(i, placed(rng.randrange(0, 40), rng.randrange(0, 30), rng.random() < 0.5), i % 2) for i in range(24)]
    rows += [(100 + i, g, p) for i, (_, g, p) in enumerate(rows[:4])]  # copies
    rows += [(200, ("Polygon", [block(1.0, 1.0, 1.0, 1.0)]), 7), (201, ("Polygon", [block(2.0, 1.0, 1.0, 1.0)[::-1]]), 7)]
    monkeypatch.setattr(overlay, "GROUP_EDGES", 10_000 if way == "together" else 0)
    monkeypatch.setattr(overlay, "WIDEST", -1.0 if way == "rows" else 100.0)
    if way != "rows":
        monkeypatch.setattr(overlay, "_union", None)
    d = spark.createDataFrame([(i, wkb.dumps(*g), p) for i, g, p in rows] + [(998, wkb.dumps("MultiPolygon", []), 8), (999, None, 9)], "id int, geometry binary, part int")
    got = {r.part: checked(r) for r in overlay.union(d, "part").collect()}
    assert got == {p: set().union(*(quarters(g) for _, g, q in rows if q == p)) for p in (0, 1, 7)}


def test_tiles_of_a_union_are_the_whole():
    rng = np.random.default_rng(22)
    turned = lambda x, y, r, s: [(x + r * np.cos(s + n * np.pi / 2), y + r * np.sin(s + n * np.pi / 2)) for n in (0, 1, 2, 3, 0)]
    found = [("Polygon", [[*q[:-1], q[0]]]) for q in (turned(*rng.uniform(0, 12, 2), rng.uniform(0.2, 2.5), rng.uniform(0, 6)) for _ in range(120))]
    s = arrange.Shapes.read(pa.array([wkb.dumps(*g) for g in found]))
    m, zero = np.arange(len(found)), np.zeros(len(found), np.int64)
    whole, _ = arrange.bounding(s, m, zero, zero, np.arange(len(s.e)), np.repeat(m, s.n), lambda a, _: a > 0)
    parts = [arrange.union_part(s, (x, y, x + 4.0, y + 4.0)) for x in np.arange(-3.99, 16, 4) for y in np.arange(-3.98, 16, 4)]
    assert sorted(map(tuple, np.concatenate(parts).tolist())) == sorted(map(tuple, whole.tolist())) and len(whole) > 50
    full = arrange.covered(s, (0.0, 0.0, 12.0, 12.0), 48)
    for j, i in np.argwhere(full):  # a covered cell lies in one area
        c = [((i + a) / 4, (j + b) / 4) for a in (0, 0.5, 1) for b in (0, 0.5, 1)]
        assert any(all(k.contains(*g, *p) for p in c) for g in found)
    assert full.sum() > 200


def test_many_holes_find_their_shells_in_one_scan(monkeypatch):
    """Holes were held against one shell after the other."""
    monkeypatch.setattr(k, "side", None)
    squares = lambda x, y, r: np.array([(x - r, y - r, x + r, y - r), (x + r, y - r, x + r, y + r), (x + r, y + r, x - r, y + r), (x - r, y + r, x - r, y - r)], float)
    rings = [squares(0, 0, 100), squares(300, 0, 50)] + [squares(-90 + 6 * i, -90 + 6 * j, 2)[:, [2, 3, 0, 1]] for i in range(30) for j in range(30)] + [squares(-90, -90, 1), squares(300, 0, 1)[:, [2, 3, 0, 1]]]
    kind, c, lost = overlay.trace(np.concatenate(rings))
    assert kind == "MultiPolygon" and lost == 0 and [len(p) for p in c] == [901, 2, 1]
    assert k.area(kind, c) == 200**2 - 900 * 16 + 100**2 - 4 + 4


def test_areas_and_edges_of_any_layout():
    rng = random.Random(23)
    found = [placed(rng.randrange(9), rng.randrange(9), i % 2 == 1) for i in range(5)] + [("Polygon", [block(0.0, 0.0, 2.0, 2.0)[::-1], block(0.5, 0.5, 1.0, 1.0)])]
    found += [("GeometryCollection", found[:2]), ("Point", (1.0, 2.0)), ("LineString", [(0.0, 0.0), (1.0, 1.0)]), ("MultiPolygon", []), ("Polygon", [])]
    texts = [wkb.dumps(*g) for g in found] + [None]
    for column in (pa.array(texts, pa.binary()), pa.array([None, *texts, b""], pa.binary())[1:-1]):
        got = arrange.areas(column)
        assert got[:-1].tolist() == [k.area(*g) for g in found] and np.isnan(got[-1])
        s = arrange.Shapes.read(column)
        assert s.n.tolist() == [sum(len(r) - 1 for p in k.polygons(*g) for r in p) for g in found] + [0]
        turn = np.bincount(np.repeat(np.arange(len(s.n)), s.n), s.e[:, 0] * s.e[:, 3] - s.e[:, 2] * s.e[:, 1], len(s.n)) / 2
        assert np.allclose(turn[:-1], got[:-1])
    assert arrange.areas(pa.array([], pa.binary())).tolist() == []


def test_pairs_are_no_rows_before_their_result(spark, monkeypatch):
    """Pairs were stored with both geometries, and overlaid one after the other."""
    rng = random.Random(24)
    shapes = lambda n: [placed(rng.randrange(0, 40), rng.randrange(0, 30), rng.random() < 0.5) for _ in range(n)]
    a, b = shapes(6), shapes(8)
    b += b[:2]  # copies
    names, stored = [], overlay.stored
    monkeypatch.setattr(overlay, "stored", lambda d, name="t", **o: names.append(name) or stored(d, name, **o))
    rows = lambda found, key: spark.createDataFrame([(i, wkb.dumps(*g), tuple(map(float, k.bounds(*g)))) for i, g in enumerate(found)] + [(99, None, None)], f"{key} int, geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    found = overlay.intersection(rows(a, "id"), rows(b, "other"))
    assert names == ["areas", "areas"] and "CoGroup" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    got = {(r.id, r.other): checked(r) for r in found.collect()}
    qa, qb = list(map(quarters, a)), list(map(quarters, b))
    assert got == {(i, j): q & r for i, q in enumerate(qa) for j, r in enumerate(qb) if q & r} and len(got) > 20


def test_rings_of_many_groups_at_once():
    square = lambda x, y, r: [(x, y, x + r, y), (x + r, y, x + r, y + r), (x + r, y + r, x, y + r), (x, y + r, x, y)]
    back = lambda e: [(c, d, a, b) for a, b, c, d in e]
    groups = [
        square(0, 0, 9), square(0, 0, 1) + square(1, 1, 1), square(0, 0, 9) + back(square(1, 1, 3)) + back(square(5, 5, 1)) + square(2, 2, 1), square(0, 0, 9) + back(square(1, 1, 3)) + back(square(4, 4, 2)),
        [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0), (0, 0, 1, 2), (1, 2, 2, 1), (2, 1, 0, 0)], square(0, 0, 9)[:3], square(0, 0, 1e-8), square(20, 0, 2) + square(0, 0, 9) + back(square(1, 1, 7)) + square(2, 2, 5) + back(square(3, 3, 1)),
    ]
    e, g = np.array(sum(groups, []), float), np.repeat(np.arange(len(groups)), [len(x) for x in groups]) * 3
    mixed = np.random.default_rng(25).permutation(len(e))
    at, texts, lost = arrange.polygons(e[mixed], g[mixed], overlay.trace, overlay.SLIVER)
    same = lambda kind, c: (kind, {(frozenset(p[0]), frozenset(map(frozenset, p[1:]))) for p in k.polygons(kind, c)})
    want = {3 * n: overlay.trace(np.array(x, float)) for n, x in enumerate(groups)}
    assert {int(n): (*same(*wkb.loads(t.as_py())), int(m)) for n, t, m in zip(at, texts, lost)} == {n: (*same(kind, c), m) for n, (kind, c, m) in want.items() if c}
    assert sorted(at.tolist()) == [0, 3, 6, 9, 12, 21] and arrange.polygons(np.zeros((0, 4)), np.zeros(0, np.int64), overlay.trace, 0.0)[1].to_pylist() == []


def test_zones_of_many_small_lines_are_one_shuffle(spark):
    """Every zone was united by joins over the edges of all zones, whose jobs and small tables came through the driver."""
    lines = [(i, wkb.dumps("LineString", [(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 1.0 + i % 3)])) for i, x in enumerate(np.arange(300) * 0.5)]
    found = zones.zones(spark.createDataFrame(lines, "id int, geometry binary"), degrees=0.25, corners=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2
    got = {r.id: k.area(*wkb.loads(r.geometry)) for r in found.collect()}
    capsule = lambda n: 2 * 0.25**2 + 2 * 0.25 * n
    assert set(got) == set(range(300))
    for i, area in got.items():
        assert abs(area - (capsule(2) + capsule(1 + i % 3) - 2.5 * 0.25**2)) < 1e-9  # both share three quarters of the disc and a square


def test_lengths_and_boxes_are_those_of_each_geometry(monkeypatch):
    rng = random.Random(31)
    line = lambda n: [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(n)]
    found = [("LineString", line(rng.choice([1, 2, 3, 40]))) for _ in range(60)] + [("MultiLineString", [line(2), line(rng.choice([2, 5]))]) for _ in range(20)]
    found += [("Polygon", [block(0.0, 0.0, 4.0, 4.0), block(1.0, 1.0, 2.0, 2.0)]), ("Point", (1.0, 2.0)), ("MultiPoint", line(3)), ("GeometryCollection", [("LineString", line(4)), ("Point", (20.0, 20.0))])]
    found += [("LineString", [(float("nan"), 1.0), (2.0, 3.0)]), ("MultiLineString", []), ("MultiPolygon", []), ("Polygon", [[]])]
    column = pa.array([None, *(wkb.dumps(*g) for g in found), None], pa.binary())
    want = [(k.length(*g), k.bounds(*g) or (np.nan,) * 4) for g in found]
    length, box = arrange.lengths(column), arrange.boxes(column)
    assert np.array_equal(length[1:-1], [n for n, _ in want], equal_nan=True) and np.isnan(length[[0, -1]]).all()
    assert np.array_equal(box[1:-1], [b for _, b in want], equal_nan=True) and np.isnan(box[[0, -1]]).all()
    empty = pa.array([wkb.dumps("LineString", [])], pa.binary())
    assert np.isnan(arrange.boxes(empty)).all()
    with pytest.raises(TypeError):  # as by itself
        arrange.lengths(empty)
    # lines of one layout are measured together
    monkeypatch.setattr(wkb, "loads", None)
    alike = pa.array([wkb.dumps(*g) for g in found[:80]], pa.binary())
    assert np.array_equal(arrange.lengths(alike), length[1:81]) and np.array_equal(arrange.boxes(alike), box[1:81])
