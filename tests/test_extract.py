import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geolake.functions import kernels as k
from geolake.functions import wkb
from geolake.operators import extract, pieces
from geolake.sources import readers as r
from tests.test_sources import zipped

SCHEMA = """id string, names struct<primary:string>, class string, subtype string, region string, height double, num_floors int, routes array<struct<name:string,network:string>>,
geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"""


def row(id_, x, y, cls=None, name=None, subtype=None, region=None, routes=None, kind="LineString"):
    c = [(x, y), (x + 0.1, y + 0.1)] if kind == "LineString" else (x, y)
    return (id_, (name,), cls, subtype, region, 3.0, 1, routes, wkb.dumps(kind, c), (float(x), float(y), x + 0.1, y + 0.1))


def test_extracts(spark):
    d = spark.createDataFrame([
        row("a", 139, 35, "motorway", "M", routes=[("R1", "JP:x"), (None, "JP:y"), ("U", "US:z")]), row("b", 139.2, 35, "trunk"), row("c", 150, 45, "trunk"), row("d", 150, 45, "primary", routes=[("R2", "JP:x")]),
        row("e", 139, 35, "residential"), row("f", 139, 35, "river", "W"), row("g", 139, 35, "river", kind="Point"), row("h", 10, 10, "motorway"),
    ], SCHEMA)
    home = spark.createDataFrame([((138.9, 34.9, 139.5, 35.5),)], "bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    got = {x.id: x.route_names for x in extract.roads(d, home).collect()}
    assert got == {"a": ["R1"], "b": [], "d": ["R2"]}
    assert [x.name for x in extract.lines(d, home, extract.WATER_CLASSES).collect()] == ["W"]
    assert extract.buildings(d).count() == 7
    # an area whose box holds the road but whose polygon doesn't
    corner = spark.createDataFrame([((138.9, 34.9, 139.5, 35.5), wkb.dumps("Polygon", [[(138.9, 34.9), (138.95, 34.9), (138.9, 35.5), (138.9, 34.9)]]))], "bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, geometry binary")
    assert {x.id for x in extract.roads(d, corner).collect()} == {"a", "d"} and extract.lines(d, corner, extract.WATER_CLASSES).count() == 0
    big = d.where("id = 'f'").withColumn("geometry", F.lit(bytes.fromhex("0000000002") + (2).to_bytes(4, "big") + np.array([139, 35, 139.1, 35.1], ">f8").tobytes()))
    assert extract.lines(big, home, extract.WATER_CLASSES).count() == 1
    div = spark.createDataFrame([row("1", 139, 35, name="横浜市", subtype="locality", region="JP-14"), row("2", 139, 35, name="神奈川県", subtype="region", region="JP-14"), row("3", 139, 35, name="どこか村", subtype="locality", region="JP-99"), row("4", 139, 35, name="Somewhere", subtype="locality", region="JP-14")], SCHEMA)
    assert {x.city_name: x.pref_name for x in extract.admin(div).collect()} == {"横浜市": "神奈川県", "どこか村": None}


def test_difference():
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    window = [(4, 4), (6, 4), (6, 6), (4, 6)]
    parts = k.difference_convex([square], window)
    assert abs(sum(abs(k.signed_area(p)) for p in parts) - 96) < 1e-9 and not any(k.contains("Polygon", [p], 5, 5) for p in parts)
    assert k.difference_convex([square], square[:-1]) == [] and abs(k.signed_area(k.difference_convex([square], [(20, 20), (30, 20), (30, 30)])[0])) == 100
    assert k.contains("Polygon", [k.circle(139, 35, 1000)], 139.005, 35) and not k.contains("Polygon", [k.circle(139, 35, 1000)], 139.02, 35)


def test_blocks_and_railways(spark, tmp_path):
    head, line = ",".join(r.BLOCK_COLUMNS), '長野県,松本市,中央三丁目,"",12,36.231,137.969,1,1'
    zipped(tmp_path / "b.zip", blocks_DOT_csv=f"{head}\r\n{line}\r\n".encode("cp932"))
    got = r.address_points(spark, str(tmp_path / "b.zip"), r.BLOCK_COLUMNS).first()
    assert got.koaza_name == "" and got.block_number == "12"
    station = {"properties": {"N02_001": "11", "N02_002": "2", "N02_003": "大糸線", "N02_004": "東日本旅客鉄道", "N02_005": "信濃松川", "N02_005c": "004321", "N02_005g": "004321"}, "geometry": {"type": "LineString", "coordinates": [[130.63035, 31.25405], [130.62985, 31.25459]]}}
    doc = {"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::6668"}}, "features": [station]}
    (tmp_path / "s.geojson").write_text(json.dumps(doc))
    row_ = r.railways(spark, str(tmp_path / "s.geojson"), stations=True).first()
    assert (row_.railway_class, row_.institution_type, row_.station_name) == ("普通鉄道JR", "JR在来線", "信濃松川")
    station["properties"]["N02_001"] = "99"
    (tmp_path / "t.geojson").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="unknown code"):
        r.railways(spark, str(tmp_path / "t.geojson")).select("railway_class").collect()


def test_register(spark):
    k.register(spark)
    g = wkb.envelope(0, 0, 2, 1).hex()
    got = spark.sql(f"select geo_area(unhex('{g}')) a, geo_contains(unhex('{g}'), 1D, 0.5D) c, geo_distance(unhex('{g}'), 3D, 0.5D) d, geo_bounds(unhex('{g}')) b").first()
    assert (got.a, got.c, got.d, got.b.xmax) == (2, True, 1, 2)
    assert spark.range(1).select(k.geo_type(F.lit(bytes.fromhex(g)))).first()[0] == "Polygon"


def test_roads_are_read_once_whatever_is_asked_of_them(spark):
    """Rows with null ids, shapes, boxes or routes, and rows that come twice, stay as they were; the source is drawn once."""
    rows = [row("a", 139, 35, "motorway", "M", routes=[("R1", "JP:x")]), *[row("b", 139.2, 35, "trunk")] * 2, row("c", 139.9, 35, "trunk", routes=[(None, None)]), row(None, 139.2, 35, "primary"), row(None, 150, 45, "primary", routes=[("R2", "JP:x")])]
    rows += [(*row("n", 139.2, 35, "trunk")[:-2], None, rows[1][-1]), (*row("o", 139.2, 35, "trunk")[:-1], None), row("p", 139.2, 35, None)]
    drawn = spark.sparkContext.accumulator(0)

    def draw(batches):
        for b in batches:
            drawn.add(b.num_rows)
            yield b

    d = spark.createDataFrame(rows, SCHEMA).mapInArrow(draw, spark.createDataFrame(rows, SCHEMA).schema)
    square = wkb.dumps("Polygon", [[(138.9, 34.9), (139.5, 34.9), (139.5, 35.5), (138.9, 35.5), (138.9, 34.9)]])
    home = spark.createDataFrame([((138.9, 34.9, 139.5, 35.5), square)], "bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, geometry binary")
    got = extract.roads(d, home)
    assert got.columns == ["id", "road_name", "class", "route_names", "geometry", "bbox"]
    assert sorted((str(x.id), x["class"], x.route_names) for x in got.collect()) == [("None", "primary", ["R2"]), ("a", "motorway", ["R1"]), ("b", "trunk", []), ("b", "trunk", [])]
    assert drawn.value == len(rows)


def test_segments_of_alike_shapes_are_made_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    line = lambda n: [tuple(p) for p in rng.uniform(0, 9, (n, 2)).tolist()]
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    found = [("LineString", line(2)), ("LineString", line(3)), ("LineString", line(1)), ("MultiLineString", [line(2), line(1), line(3)]), ("Polygon", [ring, ring[::-1]]), ("Point", (1.0, 2.0)), ("GeometryCollection", [("Point", (1.0, 2.0)), ("LineString", line(2))]), ("Polygon", [])]
    want = []
    for i, g in enumerate(found):
        paths = [*k.lines(*g), *(r for p in k.polygons(*g) for r in p), *([p, p] for p in k.points(*g))]
        want += [(i, n, *a, *b) for n, p in enumerate(p for p in paths if len(p) > 1) for a, b in zip(p, p[1:])]
    d = spark.createDataFrame([(i, wkb.dumps(*g)) for i, g in enumerate(found)] + [(99, None)], "id int, geometry binary")
    assert sorted(tuple(r)[:6] for r in pieces.segments(d).collect()) == sorted(want)
    monkeypatch.setattr(wkb, "loads", None)

    class Areas:
        schema = d.schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int32()), pa.array([wkb.dumps(*g) for g in found[:5]], pa.binary())], ["id", "geometry"])
    assert sum(b.num_rows for b in pieces.segments(Areas())(iter([batch]))) == sum(w[0] < 5 for w in want)
