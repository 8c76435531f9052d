import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geolake.functions import grid
from geolake.sources import catalog as c

ALL = [c.Collection("mesh", "mesh", "mesh_pop_", 11), c.Collection("mesh1", "mesh", "mesh_pop_1km", 8), c.Collection("cover", "coverage", "bldg_coverage", covers="bldg"), c.Collection("bldg", "building", "bldg_")]


def test_collections():
    assert c.collection_of("/x/mesh_pop_1km.parquet", ALL).id == "mesh1" and c.collection_of("mesh_pop_14.parquet", ALL).id == "mesh"
    assert c.collection_of("bldg_coverage.parquet", ALL).id == "cover" and c.covering(ALL) == {"bldg": "cover"}
    assert c.mesh_source(ALL, 6).id == "mesh1" and c.mesh_source(ALL, 9).id == "mesh" and c.mesh_source(ALL, 12) is None
    with pytest.raises(ValueError):
        c.collection_of("other.parquet", ALL)


def test_items(spark, tmp_path):
    rows = [("s1", "small", None, None, None, None), ("a1", "a", 0.0, 0.0, 1.0, 1.0), ("a2", "a", 2.0, -1.0, 3.0, 1.0)]
    items = spark.createDataFrame([(i, k, f"{i}.parquet", 5, *b) for i, k, *b in rows], "id string, collection string, file string, rows long, xmin double, ymin double, xmax double, ymax double")
    path = str(tmp_path / "items.parquet")
    assert c.write_items(items, path) == ["a", "small"]
    meta = pq.read_metadata(path)
    assert [meta.row_group(g).num_rows for g in range(2)] == [2, 1] and not meta.row_group(0).column(0).is_stats_set
    assert {r.id for r in c.read_items(spark, path, "a").collect()} == {"a1", "a2"}
    got = {r.collection: tuple(r)[1:] for r in c.extents(items).collect()}
    assert got["a"] == (2, 10, 0.0, -1.0, 3.0, 1.0) and got["small"] == (1, 5, None, None, None, None)
    with pytest.raises(ValueError):
        c.write_items(items.withColumn("odd", F.lit(1)), path)
    assert c.describe(path)["rows"] == 3


def test_city_catalog(spark, tmp_path):
    cities = [{"city_code": "13103", "city_name": "港区", "url": "u", "lods": [2, 1, 2, 3]}, {"city_code": "01100", "city_name": "札幌市", "url": "u", "lods": []}, {"city_code": "x", "city_name": "y", "url": ""}]
    (tmp_path / "cities.json").write_text(json.dumps(cities))
    assert {r.city_code: r.lods for r in c.city_catalog(spark, str(tmp_path / "cities.json")).collect()} == {"13103": "1,2,3", "01100": ""}


def test_features(spark):
    f = c.feature(c.box_geojson(grid.mesh_bounds(F.lit("5339"))), ratio=F.lit(0.5), name=F.lit(None).cast("string"))
    doc = json.loads(spark.range(1).select(f).first()[0])
    assert doc["geometry"]["type"] == "Polygon" and len(doc["geometry"]["coordinates"][0]) == 5 and doc["properties"] == {"ratio": 0.5, "name": None}


def test_values(spark):
    from geolake.functions import values as v

    r = spark.range(1).select(v.dem_height(F.lit(128), F.lit(0), F.lit(0)), v.dem_height(F.lit(0), F.lit(0), F.lit(100)), v.dem_height(F.lit(255), F.lit(255), F.lit(156)), v.terrarium(F.lit(0)), v.number_or_null(F.lit(" * ")), v.number_or_null(F.lit(" 7 "))).first()
    assert r[0] == 0 and r[1] == 1 and r[2] == -1 and tuple(r[3]) == (128, 0, 0) and r[4] is None and r[5] == 7
    with pytest.raises(Exception, match="unknown code"):
        spark.range(1).select(v.name_of(F.lit("9"), v.OPERATOR_TYPES)).collect()


def test_filters(spark):
    from geolake.operators import filters as f

    d = spark.createDataFrame([("a%b",), ("axb",), ("\\a",), (None,)], "s string")
    assert d.where(f.matches(F.col("s"), "A B")).count() == 2 and d.where(f.matches(F.col("s"), "\\")).count() == 1 and d.where(f.matches(F.col("s"), "")).count() == 4
    assert d.where(f.value_in(F.col("s"), None)).count() == 4 and d.where(f.value_in(F.col("s"), [])).count() == 0
    with pytest.raises(ValueError, match="more than 3"):
        f.export(d, "/nowhere", 3)
    rules = [("public", ["x"]), ("business", ["y"]), ("other", None)]
    f.check_rules(rules, ["usage", "name"], "usage", True)
    for bad in ([("a", ["x"]), ("b", ["x"]), ("c", None)], [("a", ["x"]), ("b", ["y"])]):
        with pytest.raises(ValueError):
            f.check_rules(bad, ["usage", "name"], "usage", False)
    with pytest.raises(ValueError):
        f.check_rules(rules, ["usage"], "usage", True)


def test_documents(spark):
    items = spark.createDataFrame([("a1", "a", "a1.parquet", 5, 0.0, 0.0, 1.0, 1.0), ("a2", "a", "a2.parquet", 7, 2.0, -1.0, 3.0, 1.0), ("b1", "b", "b1.parquet", 1, None, None, None, None)], "id string, collection string, file string, rows long, xmin double, ymin double, xmax double, ymax double")
    docs = {r.path: json.loads(r.json) for r in c.collection_documents(items, {"a": "Roads", "b": "Names", "z": "none"}).collect()}
    assert docs.keys() == {"catalog.json", "a/collection.json", "b/collection.json"} and docs["catalog.json"]["type"] == "Catalog"
    assert [x["href"] for x in docs["catalog.json"]["links"] if x["rel"] == "child"] == ["a/collection.json", "b/collection.json"]
    assert docs["a/collection.json"]["extent"]["spatial"]["bbox"] == [[0.0, -1.0, 3.0, 1.0]] and docs["a/collection.json"]["description"] == "Roads" and docs["a/collection.json"]["summaries"] == {"files": 2, "rows": 12}
    with pytest.raises(ValueError, match="description"):
        c.collection_documents(items, {"a": "Roads"})


def test_links():
    assert c.resolve("roads.parquet", "maps/roads.json") == "maps/roads.parquet" and c.resolve("../x.json", "maps/roads.json") == "x.json" and c.resolve("./a/b", "catalog.json") == "a/b"
    assert c.resolve("https://h/x", "maps/roads.json") == "https://h/x" and c.resolve("../y", "https://h/a/b/c.json") == "https://h/a/y"
    assert c.delivery_path("/data/out/maps/a.parquet", "/data/out") == "maps/a.parquet" and c.delivery_path("C:\\d\\x\\a.parquet", "C:\\d") == "x/a.parquet"


def test_document_tree(spark, tmp_path):
    """Every link of the written tree leads somewhere; dangling ones are errors."""
    import json
    import os

    from geolake.sources import catalog as c

    items = spark.createDataFrame([("a1", "roads", "f1", 10, 1.0, 2.0, 3.0, 4.0), ("a2", "roads", "f2", 5, 0.0, 2.0, 3.0, 9.0), ("b", "lines", "f3", 7, 5.0, 5.0, 6.0, 6.0), ("c", "towns", "f4", 1, None, None, None, None)],
                                  "id string, collection string, file string, rows long, xmin double, ymin double, xmax double, ymax double")
    said, groups = {"roads": "Roads", "lines": "Lines", "towns": "Towns", "traffic": "Traffic"}, {"roads": "traffic", "lines": "traffic", "towns": "places"}
    tree = c.document_tree(items, said, groups, {"lines": ["roads", "towns"]}, {"ja": {"roads": "道路", "traffic": "交通"}})
    c.write_documents(tree, str(tmp_path / "t"))
    (tmp_path / "t" / "items.parquet").write_bytes(b"")
    paths = [os.path.relpath(os.path.join(d, f), tmp_path / "t") for d, _, fs in os.walk(tmp_path / "t") for f in fs if f.endswith(".json")]
    assert sorted(paths) == sorted(tree) and len(paths) == 13
    for p in paths:
        for x in json.loads((tmp_path / "t" / p).read_text()).get("links", []):
            assert os.path.exists(tmp_path / "t" / os.path.dirname(p) / x["href"]), (p, x)
    roads = tree["traffic/roads/collection.json"]
    assert roads["extent"]["spatial"]["bbox"] == [[0.0, 2.0, 3.0, 9.0]] and roads["summaries"] == {"files": 2, "rows": 15} and tree["traffic/roads/collection.ja.json"]["description"] == "道路"
    assert tree["places/catalog.ja.json"]["description"] == "places" and tree["places/towns/collection.json"]["extent"]["spatial"]["bbox"] == [None]
    made = [x["href"] for x in tree["traffic/lines/collection.json"]["links"] if x["rel"] == "derived_from"]
    assert made == ["../roads/collection.json", "../../places/towns/collection.json"] and len(tree["bundle.json"]["documents"]) == 12
    with pytest.raises(ValueError, match="dangling"):
        c.document_tree(items, said, groups, {"lines": ["rivers"]})
    with pytest.raises(ValueError, match="towns"):
        c.document_tree(items, said, {"roads": "x", "lines": "x"})
