import math

import pytest
from pyspark.sql import functions as F

from geolake.functions import grid


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_tokyo_station(spark):
    lon, lat = F.lit(139.7671), F.lit(35.6812)
    r = one(spark, *[grid.mesh_code(lon, lat, d) for d in (4, 6, 8, 9, 10, 11)])
    assert r[0] == "5339" and r[1] == "533946" and r[2] == "53394611" and r[3] == "533946113"
    assert r[4].startswith(r[3]) and r[5].startswith(r[4])


def test_bounds_and_neighbours(spark):
    b = lambda c: grid.mesh_bounds(F.lit(c))
    r = one(spark, b("5339"), b("53394611"), b("53394612"), b("53394621"), b("533946113"))
    assert [round(v, 4) for v in r[0]] == [139.0, 35.3333, 140.0, 36.0]
    assert math.isclose(r[1].xmax, r[2].xmin, abs_tol=1e-9) and math.isclose(r[1].ymax, r[3].ymin, abs_tol=1e-9)
    assert math.isclose(r[4].xmin, r[1].xmin, abs_tol=1e-12) and math.isclose(r[4].ymax, r[1].ymax, abs_tol=1e-12)


def test_area(spark):
    r = one(spark, grid.mesh_area_km2(F.lit("53394611")), grid.mesh_bounds(F.lit("53394611")), grid.mesh_area_km2(F.lit("533946111")), grid.mesh_area_km2(F.lit("39272000")), grid.mesh_area_km2(F.lit("68412000")))
    sphere = math.radians(r[1].xmax - r[1].xmin) * (math.sin(math.radians(r[1].ymax)) - math.sin(math.radians(r[1].ymin))) * 6371.0088**2
    assert 0.9 < r[0] < 1.1 and math.isclose(r[0], sphere, rel_tol=1e-9) and abs(r[0] / r[2] - 4) < 0.01 and r[3] / r[4] > 1.1


def test_cover(spark):
    cover = lambda w, s, e, n: one(spark, grid.mesh_cover(*map(F.lit, (w, s, e, n))))[0]
    assert cover(139.7001, 35.6501, 139.7002, 35.6502) == ["53393586"] and len(cover(139.70, 35.65, 139.76, 35.70)) <= 60
    rough = cover(139.5, 35.5, 139.8, 35.7)
    assert all(len(c) == 6 for c in rough) and len(rough) <= 15 and cover(139.0, 35.0, 141.0, 37.0) is None


def test_road_classes():
    assert grid.road_classes(["motorway", "trunk", "primary", "x"], 5) == ["motorway", "x"] and grid.road_classes(["trunk", "primary"], 8) == ["trunk"]
    assert grid.road_classes(["trunk", "primary"], 8, 2) == ["trunk", "primary"] and grid.road_classes(["trunk"], 0, 99) == ["trunk"]


@pytest.mark.parametrize("code", ["5339461", "533946115", "533984", "533949", "5339461a", None, ""])
def test_bad_codes(spark, code):
    value = F.lit(code).cast("string")
    if code == "533949":  # digits 5 and 6 go to 7
        code = "533984"
    assert one(spark, grid.mesh_is_valid(value))[0] is False
    with pytest.raises(Exception, match="bad mesh code"):
        one(spark, grid.mesh_bounds(value))


def test_quadkeys(spark):
    r = one(spark, grid.quadkey(F.lit(139.7671), F.lit(35.6812), 8), grid.tile_x(F.lit(139.7671), 8), grid.tile_y(F.lit(35.6812), 8), grid.quadkey_of_tile(F.lit(3), F.lit(5), 3), grid.tile_x(F.lit(180.0), 2), grid.tile_y(F.lit(90.0), 2), grid.tile_y(F.lit(-90.0), 2))
    assert list(r) == ["13300211", 227, 100, "213", 3, 0, 3]
    box = one(spark, grid.quadkey_bounds(F.lit("13300211")))[0]
    assert box.xmin <= 139.7671 < box.xmax and box.ymin < 35.6812 <= box.ymax
    with pytest.raises(Exception, match="bad quadkey"):
        one(spark, grid.quadkey_bounds(F.lit("1234")))


def test_policies():
    assert [grid.mesh_digits(z) for z in (5, 6, 9, 12, 14, 15)] == [4, 6, 8, 9, 10, 11]
    assert [grid.mesh_capacity(d) for d in (4, 6, 8, 11)] == [6400, 100, 1, 1]
    assert grid.coarse_until(100) == 11 and [grid.level_for_zoom(t, z) for t, z in ((100, 11), (100, 11.5), (None, 3))] == [0, 1, None]
    assert grid.tier_depth(14, 14, 3) == 2 and grid.tier_depth(12.5, 14, 3) == 0


def test_igrc(spark):
    r = one(spark, *[grid.igrc(F.lit(d).cast("double"), 2) for d in (0, 5, 49999, 50000, None)])
    assert list(r) == [4, 5, 8, None, None]
