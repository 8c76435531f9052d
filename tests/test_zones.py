"""Zones against closed forms, datum shifts there and back, tiles chosen by the catalogue, exports, streams in two runs."""

import math
import os

import pytest
from pyspark.sql import functions as F

from geolake.functions import datum
from geolake.functions import kernels as k
from geolake.functions import wkb
from geolake.operators import filters, zones
from geolake.plans import overlay_queries
from geolake.sources import geoparquet
from geolake.streaming import coverage as stream


def test_zone_areas(spark):
    r, n = 0.5, 64
    disc = n / 2 * r * r * math.sin(2 * math.pi / n)
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    shapes = {
        "point": ("Point", (1.0, 1.0)), "line": ("LineString", [(0.0, 0.0), (3.0, 0.0)]), "bent": ("LineString", [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)]), "square": ("Polygon", [square]),
        "court": ("Polygon", [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)], [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0), (2.0, 2.0)]]), "two": ("MultiPoint", [(0.0, 0.0), (9.0, 9.0)]),
        "slanted": ("LineString", [(0.0, 0.0), (3.0, 4.0)]), "turn": ("LineString", [(0.0, 0.0), (4.0, 0.0), (0.0, 0.1)]),
    }
    d = spark.createDataFrame([(i, wkb.dumps(*g)) for i, g in shapes.items()] + [("null", None), (None, wkb.dumps("Point", (0, 0)))], "id string, geometry binary")
    got = {x.id: wkb.loads(x.geometry) for x in zones.zones(d, degrees=r).collect()}
    area = {i: k.area(*g) for i, g in got.items()}
    want = {"point": disc, "line": disc + 6 * r, "square": 4 + 8 * r + disc, "two": 2 * disc, "court": 64 - 16 + 32 * r + disc + 16 - (4 - 2 * r) ** 2}
    want["bent"] = (disc + 6 * r) + (disc + 8 * r) - disc / 4 * 3 - r * r  # both capsules less what they share: three quarters of the disc and a square
    for i, a in want.items():
        assert abs(area[i] - a) < 1e-9, i
    assert abs(area["slanted"] - (disc + 10 * r)) < 0.01 and set(got) == set(shapes)
    assert len(k.polygons(*got["two"])) == 2 and len(k.polygons(*got["court"])[0]) == 2 and k.contains(*got["turn"], 4.4, 0.0)
    metres = wkb.loads(zones.zones(d.where("id = 'line'"), metres=1000.0).first().geometry)
    assert abs(k.bounds(*metres)[3] * 110_540 - 1000) < 1 and abs(-k.bounds(*metres)[0] * 111_320 - 1000) < 1
    with pytest.raises(ValueError):
        zones.zones(d, degrees=1.0, corners=5)


def test_datum_shift_there_and_back(spark):
    corners = spark.range(144).select(F.floor(F.col("id") / 12).alias("i"), (F.col("id") % 12).alias("j"))
    corners = corners.select("i", "j", (F.sin("i") / 8000).alias("dlon"), (F.cos("j") * F.sin(F.col("i") + F.col("j")) / 7000).alias("dlat"))
    cells = datum.grid_cells(corners)
    assert cells.count() == 121
    points = spark.range(500).select("id", (1.2 + F.col("id") % 37 * 0.21).alias("x"), (1.1 + F.col("id") % 41 * 0.19).alias("y"), F.lit(1).alias("i"))
    moved = datum.shift(points.withColumn("x0", F.col("x")).withColumn("y0", F.col("y")), cells, "x", "y", 1.0, 1.0)
    back = datum.shift(moved.withColumn("mx", F.col("x")).withColumn("my", F.col("y")), cells, "mx", "my", 1.0, 1.0, back=True)
    rows = back.collect()
    assert len(rows) == 500
    for r in rows:
        assert abs(r.mx - r.x0) < 1e-9 and abs(r.my - r.y0) < 1e-9  # under a tenth of a millimetre
        i, j, u, v = int(r.x0), int(r.y0), r.x0 % 1, r.y0 % 1
        f = lambda a, b: math.cos(b) * math.sin(a + b) / 7000
        assert abs(r.y - r.y0 - ((f(i, j) * (1 - u) + f(i + 1, j) * u) * (1 - v) + (f(i, j + 1) * (1 - u) + f(i + 1, j + 1) * u) * v)) < 1e-12
    assert datum.shift(spark.createDataFrame([(99.0, 1.0)], "x double, y double"), cells, "x", "y", 1.0, 1.0).first().x is None
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


def test_catalogue_chooses_tiles(spark, tmp_path):
    rows = [(i, 139 + i % 40 / 40, 35 + i // 40 / 40) for i in range(1600)]
    d = spark.createDataFrame(rows, "id int, lon double, lat double").withColumn("bbox", F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax")))
    d = d.withColumn("geometry", F.lit(wkb.dumps("Point", (0, 0))))
    items = geoparquet.write_tiles(d, str(tmp_path / "t"), 6, 12, 100, ["Point"], folders=True)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)
    found = geoparquet.read_tiles(spark, str(tmp_path / "t"), items, kinds, (139.51, 35.51, 139.54, 35.54))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in found.collect()] == [i for i, x, y in rows if 139.51 <= x <= 139.54 and 35.51 <= y <= 35.54]
    assert found.select("quadkey").distinct().count() == 1 and items.count() > 10
    assert all(os.path.isdir(tmp_path / "t" / p) for p in os.listdir(tmp_path / "t"))


def test_export_writes_once(spark, tmp_path):
    d = spark.range(100)
    assert filters.export(d, str(tmp_path / "a"), 100) == 100 and spark.read.parquet(str(tmp_path / "a")).count() == 100
    with pytest.raises(ValueError, match="more than 99"):
        filters.export(d, str(tmp_path / "b"), 99)
    assert not os.path.exists(tmp_path / "b")
    with pytest.raises(Exception, match="exists"):
        filters.export(d, str(tmp_path / "a"), 99)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 100


def test_stream_takes_only_what_is_new(spark, tmp_path):
    events = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 1200).alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    events.where("event_id < 350").coalesce(1).write.parquet(source)
    stream.run_coverage(spark, source, folder)
    first = {(r.start, r.mesh_code): (r.n, r.value) for r in stream.coverage(spark, folder).collect()}
    want = lambda d: {(r.start, r.mesh_code): (r.n, r.value) for r in stream.windowed(d).collect()}
    assert first == want(events.where("event_id < 350"))
    events.where("event_id >= 350").coalesce(1).write.mode("append").parquet(source)
    stream.run_coverage(spark, source, folder)
    assert {(r.start, r.mesh_code): (r.n, r.value) for r in stream.coverage(spark, folder).collect()} == want(events)
    batches = spark.read.parquet(f"{folder}/windows").groupBy("batch").agg(F.sum("n")).count()
    stream.run_coverage(spark, source, folder)  # nothing new
    assert spark.read.parquet(f"{folder}/windows").select("batch").distinct().count() == batches == 2


def test_lots_are_what_the_oracles_take(spark):
    """The convex parts and the rings are the same area."""
    shell = ("Polygon", [[*map(lambda p: tuple(map(float, p)), [*overlay_queries.SHELL, overlay_queries.SHELL[0]])], [*overlay_queries.HOLE, overlay_queries.HOLE[0]]])
    parts = sum(abs(k.signed_area([*p, p[0]])) for p in overlay_queries.CONVEX)
    assert k.area(*shell) + abs(k.signed_area([*overlay_queries.ISLAND, overlay_queries.ISLAND[0]])) == parts
