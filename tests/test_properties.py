"""Invariants: covers without overlap, preserved totals, cell joins equal to brute force, packing as a permutation."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geolake.functions import kernels, wkb
from geolake.operators import aggregates as agg
from geolake.operators import spatial_join as sj
from geolake.sources import geoparquet as gp

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


@pytest.mark.parametrize("counts, least, most, rows, want", [
    ({"1300": 50, "1301": 50, "1302": 50, "1310": 5, "2000": 1}, 2, 4, 100, ["1300", "1301", "1302", "131", "20"]),
    ({"123": 1000}, 1, 3, 10, ["123"]),
])
def test_tiles_goldens(spark, counts, least, most, rows, want):
    keys = spark.createDataFrame(list(counts.items()), "key string, n long")
    assert sorted(r.quadkey for r in agg.choose_tiles(keys, least, most, rows).collect()) == sorted(want)


def test_tiles_cover_without_overlap(spark):
    rng = random.Random(4)
    counts = {}
    for _ in range(400):
        k = "".join(rng.choices("0123", [8, 4, 2, 1], k=6))
        counts[k] = counts.get(k, 0) + rng.randint(1, 30)
    keys = spark.createDataFrame(list(counts.items()), "key string, n long")
    tiles = agg.choose_tiles(keys, 2, 6, 100)
    got = {r.quadkey: r.rows for r in tiles.collect()}
    assert sum(got.values()) == sum(counts.values()) and all(sum(k.startswith(t) for t in got) == 1 for k in counts)
    assert all(n <= 100 or len(t) == 6 for t, n in got.items())
    placed = {r.key: r.quadkey for r in agg.tile_of_keys(keys, tiles, 2, 6).collect()}
    assert placed.keys() == counts.keys() and all(k.startswith(t) for k, t in placed.items())


def boxes(spark, rng, n, key, box, hot=False, sizes=(0, 0.3, 2.5)):
    rows = []
    for i in range(n):
        x, y = (0.5, 0.5) if hot and i % 3 == 0 else (rng.uniform(-5, 5), rng.uniform(-5, 5))
        w, h = rng.choice(sizes), rng.choice(sizes)
        rows.append((i, (x, y, x + w, y + h)))
    return rows, spark.createDataFrame([*rows, (None, None)], f"{key} long, {box} {BOX}")


@pytest.mark.parametrize("sizes", [(0, 0.3, 2.5), (0.001, 0.02, 40)])
def test_overlap_join_is_brute_force(spark, sizes):
    rng = random.Random(6)
    a, left = boxes(spark, rng, 120, "a", "abox", True, sizes)
    b, right = boxes(spark, rng, 90, "b", "bbox", True, sizes[::2])
    want = sorted((i, j) for i, p in a for j, q in b if p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1])
    assert sorted((r.a, r.b) for r in sj.overlap_join(left, right, "abox", "bbox").collect()) == want
    assert sorted(r.a for r in sj.semi_overlap(left, right, "a", "abox", "bbox").collect()) == sorted({i for i, _ in want})


def test_point_and_distance_joins_are_brute_force(spark):
    rng = random.Random(7)
    b, areas = boxes(spark, rng, 60, "b", "bbox")
    p = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(200)]
    points = spark.createDataFrame(p, "p long, x double, y double")
    want = sorted((i, j) for i, x, y in p for j, q in b if q[0] <= x <= q[2] and q[1] <= y <= q[3])
    assert sorted((r.p, r.b) for r in sj.point_join(points, areas, "x", "y", "bbox").collect()) == want
    q = points.select(F.col("p").alias("q"), F.col("x").alias("u"), F.col("y").alias("v"))
    near = sorted((i, j) for i, x, y in p for j, u, v in p if (x - u) ** 2 + (y - v) ** 2 <= 0.49)
    assert sorted((r.p, r.q) for r in sj.distance_join(points, q, 0.7, "x", "y", "u", "v").collect()) == near


def test_rollups_keep_totals(spark):
    rows = [("53394611111", 100, 40, 5.0), ("53394611444", 300, 120, 9.0), ("53394621111", None, None, None), ("5339", 7, 7, 7.0)]
    cells = spark.createDataFrame(rows, "mesh_code string, population long, households long, density double")
    got = {r.mesh_code: tuple(r)[1:] for r in agg.accumulate([cells, cells]).collect()}
    assert got == {"53394611": (800, 320, 9.0), "53394621": (None, None, None)}
    assert [tuple(r) for r in agg.mesh_rollup(cells, 4).collect()] == [("5339", 407, 9.0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(-50, 50)), min_size=0, max_size=80), st.integers(1, 20))
def test_packing_permutes(centres, size):
    box = np.array([[x, y, x + 1, y + 1] for x, y in centres], float).reshape(-1, 4)
    assert sorted(gp.pack(box, size).tolist()) == list(range(len(centres)))
    levels = np.arange(len(centres)) % 3
    for cells_first in (False, True):
        order, groups = gp.layout(box, levels, size, cells_first)
        assert sorted(order.tolist()) == list(range(len(centres))) and sum(groups) == len(centres) and all(g <= size for g in groups)
        at = 0
        for g in groups:
            assert len(set(levels[order[at : at + g]])) == 1
            at += g


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-10, 10), st.floats(-10, 10)), min_size=2, max_size=40), st.floats(0, 3))
def test_lines_stay_close(path, tolerance):
    short = kernels.simplify(path, tolerance)
    assert short[0] == path[0] and short[-1] == path[-1] and set(short) <= set(path)
    assert all(kernels.distance("LineString", short, *p) <= tolerance + 1e-9 for p in path)
    assert wkb.loads(wkb.dumps("LineString", path)) == ("LineString", [tuple(p) for p in path])
    for part in kernels.clip_path(path, (-5, -5, 5, 5)):
        assert all(-5 - 1e-9 <= v <= 5 + 1e-9 for p in part for v in p)


def test_spatial_sort_narrows_partitions(spark):
    d = spark.range(4000).select((F.lit(139.0) + F.col("id") * 7919 % 1000 / 1000).alias("x"), (F.lit(35.0) + F.col("id") * 104729 % 997 / 997).alias("y"))
    sorted_ = gp.spatially_sorted(d, "x", "y", 16).withColumn("part", F.spark_partition_id())
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).collect()
    assert sum(r.n for r in sizes) == 4000 and np.median([r.w * r.h for r in sizes]) < 0.3
