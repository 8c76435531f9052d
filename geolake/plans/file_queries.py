"""Queries that go through files: the tables are written by tasks in the formats that sources come in, and read with the readers.

A file holds a block of ids or a coarse cell, so it fits a task whatever the size of the tables.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.functions import grid, kernels, values
from geolake.operators import aggregates as agg
from geolake.operators import filters as f
from geolake.sources import archives, catalog, geoparquet, readers
from geolake.sources.shared import file_system, shared_dir, spread, stored

from . import build_queries
from . import geography as geo
from .mesh_queries import quadkey_sql
from .registry import registry

QUERIES, ORACLES, query = registry()


def write_files(df: DataFrame, by: str, suffix: str, render: Callable[[pd.DataFrame], bytes]) -> str:
    """The folder of one file for each value of `by`, of the bytes that render() makes of its rows; a file is moved to its name when complete."""
    folder = f"{shared_dir(df.sparkSession)}/files-{uuid.uuid4().hex}"

    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{key[0]}{suffix}"
        files, at = file_system(path)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        temporary = f"{at}.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(temporary) as out:
            out.write(render(rows))
        files.move(temporary, at)
        return pd.DataFrame({"file": [path]})

    stored(df.groupBy(by).applyInPandas(put, "file string"), "files")
    return folder


def zipped(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def table_text(rows: list[list]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue()


@query(f"""WITH {geo.SQL} SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS pref_code, '第' || CAST(c_nationkey AS VARCHAR) || '県' AS pref_name, count(*) AS points, count_if(c.c_custkey % 3 = 0) AS unnamed,
round(min(lon), 6) AS west, round(max(lat), 6) AS north FROM census c JOIN customer USING (c_custkey) GROUP BY 1, 2""")
def address_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address points from zips of Shift-JIS tables, two entries each."""
    k = F.col("c_custkey")
    d = geo.points(spark, sf_dir, "customer", "c_custkey").select("c_custkey", "c_nationkey", "c_mktsegment", "lon", "lat", F.expr("c_custkey div 5000").alias("block"))

    def render(rows: pd.DataFrame) -> bytes:
        entries = {}
        for odd, own in rows.groupby(rows["c_custkey"] % 2):
            body = [
                [f"{r.c_nationkey:02}", f"第{r.c_nationkey}県", f"{r.c_nationkey:02}{r.c_custkey % 1000:03}", r.c_mktsegment, str(r.c_custkey), "" if r.c_custkey % 3 == 0 else f"町{r.c_custkey % 40}", repr(r.lat), repr(r.lon), "0", "1"]
                for r in own.itertuples()
            ]
            entries[f"town{odd}.csv"] = table_text([list(readers.TOWN_COLUMNS), *body]).encode("cp932")
        return zipped(entries)

    found = readers.address_points(spark, write_files(d.where(k.isNotNull()), "block", ".zip", render))
    unnamed = F.count_if(F.col("oaza_name") == "").alias("unnamed")
    return found.groupBy("pref_code", "pref_name").agg(F.count("*").alias("points"), unnamed, F.round(F.min("bbox.xmin"), 6).alias("west"), F.round(F.max("bbox.ymax"), 6).alias("north"))


@query(f"WITH {geo.SQL} SELECT {geo.mesh_sql('lon', 'lat')} AS mesh_code, CASE WHEN sum(population) >= 0 THEN CAST(sum(population) AS BIGINT) END AS population, count(*) AS households FROM census GROUP BY 1")
def census_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census tables with two header rows, one a 4-digit cell; what must not be shown is a star there and null here."""
    cells = geo.census(spark, sf_dir).groupBy(grid.mesh_code(F.col("lon"), F.col("lat")).alias("mesh_code")).agg(F.sum("population").alias("population"), F.count("*").alias("households"))

    def render(rows: pd.DataFrame) -> bytes:
        body = [[r.mesh_code, r.population if r.population >= 0 else "*", r.households] for r in rows.itertuples()]
        return table_text([["KEY_CODE", "A", "B"], ["", "　人口", "世帯 "], *body]).encode("cp932")

    folder = write_files(cells.withColumn("cell", F.substring("mesh_code", 1, 4)), "cell", ".csv", render)
    return readers.census_mesh(spark, f"{folder}/*.csv", {"人口": "population", "世帯": "households"})


_CLASS, _TYPE = list(values.RAILWAY_CLASSES), list(values.OPERATOR_TYPES)
_NAMED = lambda key, names: f"CASE {key} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names.values())) + " END"


@query(f"""WITH {geo.SQL} SELECT {_NAMED(f'id % {len(_CLASS)}', values.RAILWAY_CLASSES)} AS railway_class, {_NAMED(f'id % {len(_TYPE)}', values.OPERATOR_TYPES)} AS institution_type, count(*) AS sections,
round(min(lon), 6) AS west, round(max(y2), 6) AS north, round(sum(sqrt((x2 - lon) * (x2 - lon) + (y2 - lat) * (y2 - lat))), 5) AS length FROM roads GROUP BY 1, 2""")
def railway_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Railway sections from GeoJSON, their codes named, their geometry as WKB with its box."""
    d = geo.roads(spark, sf_dir).select("id", "lon", "lat", "x2", "y2", F.expr("id div 20000").alias("block"))

    def render(rows: pd.DataFrame) -> bytes:
        head = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::6668"}},"features":[\n'
        line = [
            json.dumps({"type": "Feature", "properties": {"N02_001": _CLASS[r.id % len(_CLASS)], "N02_002": _TYPE[r.id % len(_TYPE)], "N02_003": f"line {r.id % 7}", "N02_004": "operator"}, "geometry": {"type": "LineString", "coordinates": [[r.lon, r.lat], [r.x2, r.y2]]}})
            for r in rows.itertuples()
        ]
        return (head + ",\n".join(line) + "\n]}\n").encode()

    found = readers.railways(spark, write_files(d, "block", ".geojson", render))
    return found.groupBy("railway_class", "institution_type").agg(F.count("*").alias("sections"), F.round(F.min("bbox.xmin"), 6).alias("west"), F.round(F.max("bbox.ymax"), 6).alias("north"), F.round(F.sum(kernels.geo_length("geometry")), 5).alias("length"))


@query(f"""WITH {geo.SQL} SELECT 'B' || CAST(id AS VARCHAR) AS building_id, CASE id % 3 WHEN 0 THEN '商業施設' WHEN 1 THEN '住宅' ELSE '499' END AS usage, CASE WHEN id % 13 <> 0 THEN CAST(id % 50 AS BIGINT) END AS storeys,
CAST(height AS DOUBLE) AS height, round(CAST(height * height AS DOUBLE) * CASE WHEN id % 2 = 0 THEN CAST(0.03 AS DOUBLE) ELSE CAST(0.04 AS DOUBLE) END, 4) AS area FROM buildings""")
def building_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings from zips of CityGML: outlines with courtyards, codes named by the zip's lists, sentinels null. area in millionths of a square degree."""
    d = geo.buildings(spark, sf_dir).select("id", "height", "lon", "lat", F.expr("id div 1000").alias("block"))
    names = {"10": "商業施設", "11": "住宅"}
    label = "".join(f"<gml:dictionaryEntry><gml:Definition><gml:description>{v}</gml:description><gml:name>{k}</gml:name></gml:Definition></gml:dictionaryEntry>" for k, v in names.items())
    lists = f'<gml:Dictionary xmlns:gml="g">{label}</gml:Dictionary>'

    def ring(r, half: float) -> str:
        x0, y0, x1, y1 = r.lon - half, r.lat - half, r.lon + half, r.lat + half
        return "<gml:LinearRing><gml:posList>" + " ".join(f"{y!r} {x!r} 0" for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))) + "</gml:posList></gml:LinearRing>"

    def building(r) -> str:
        hole = f"<gml:interior>{ring(r, r.height * 0.00005)}</gml:interior>" if r.id % 2 == 0 else ""
        outline = f"<bldg:lod0RoofEdge><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior>{ring(r, r.height * 0.0001)}</gml:exterior>{hole}</gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod0RoofEdge>"
        usage = f'<bldg:usage codeSpace="../../codelists/use.xml">{("10", "11", "499")[r.id % 3]}</bldg:usage>'
        return f'<core:cityObjectMember><bldg:Building gml:id="B{r.id}">{usage}<bldg:measuredHeight>{r.height}</bldg:measuredHeight><bldg:storeysAboveGround>{r.id % 50 if r.id % 13 else 9999}</bldg:storeysAboveGround>{outline}</bldg:Building></core:cityObjectMember>'

    def render(rows: pd.DataFrame) -> bytes:
        documents = {}
        for part, own in rows.groupby(rows["id"] % 4):
            text = '<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g">' + "".join(map(building, own.itertuples())) + "</core:CityModel>"
            documents[f"udx/bldg/{part}.gml"] = text.encode()
        return zipped(documents | {"codelists/use.xml": lists.encode()})

    found = readers.citygml_buildings(spark, write_files(d, "block", ".zip", render))
    return found.select("building_id", "usage", "storeys", "height", F.round(kernels.geo_area("geometry") * 1e6, 4).alias("area"))


@query("""WITH z AS (SELECT p_partkey // 200 AS block, count(DISTINCT p_size % 3) AS entries, CAST(sum(length(p_name) + 1) AS BIGINT) AS bytes FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY bytes, block) - 1 AS place, count(*) OVER () AS total FROM z)
SELECT block, entries, bytes FROM r WHERE place IN (SELECT CAST(floor(i * CAST(r.total - 1 AS DOUBLE) / 4 + 0.5) AS BIGINT) FROM range(5) t(i))""")
def survey_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey's sample of zips, from small to large, by the sizes in their directories; contents are not read."""
    d = geo.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.expr("p_partkey div 200").alias("block"))

    def render(rows: pd.DataFrame) -> bytes:
        return zipped({f"{k}.txt": "".join(f"{n}\n" for n in own["p_name"]).encode() for k, own in rows.groupby(rows["p_size"] % 3)})

    found = archives.zip_summary(spark, write_files(d, "block", ".zip", render))
    found = found.select(F.regexp_extract("file", r"([0-9]+)\.zip$", 1).cast("bigint").alias("block"), "entries", "bytes")
    return agg.spaced_sample(found, 5, "bytes", "block")


@query("""WITH p AS (SELECT p_brand AS city_code, p_partkey % 11 = 0 AS none, unnest([p_size % 5, p_partkey % 4]) AS lod FROM part WHERE p_partkey % 7 <> 0)
SELECT city_code, 'City ' || city_code AS city_name, coalesce(string_agg(DISTINCT CASE WHEN NOT none THEN CAST(lod AS VARCHAR) END, ',' ORDER BY CASE WHEN NOT none THEN CAST(lod AS VARCHAR) END), '') AS lods FROM p GROUP BY 1""")
def city_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities and their levels of detail from JSON catalogues."""
    d = geo.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", F.expr("p_partkey div 5000").alias("block"))

    def render(rows: pd.DataFrame) -> bytes:
        return json.dumps([
            {"city_code": r.p_brand, "city_name": f"City {r.p_brand}", "url": f"https://example.org/{r.p_partkey}" if r.p_partkey % 7 else "", "lods": [r.p_size % 5, r.p_partkey % 4] if r.p_partkey % 11 else None}
            for r in rows.itertuples()
        ]).encode()

    return catalog.city_catalog(spark, f"{write_files(d, 'block', '.json', render)}/*.json")


@query(f"WITH {geo.SQL}, bk AS (SELECT *, {quadkey_sql(12)} AS key FROM buildings), keys AS (SELECT key, count(*) AS n FROM bk GROUP BY 1), {build_queries._BNODES} SELECT quadkey, count(*) AS rows, CAST(ceil(count(*) / 100.0) AS BIGINT) AS groups, least(100, count(*)) AS largest FROM bk JOIN tiles ON starts_with(bk.key, tiles.quadkey) GROUP BY 1")
def repacked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as an engine left them, written anew as packed files of adaptive tiles; row groups from the new files' footers."""
    source, folder = (f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("plain", "packed"))
    build_queries._with_geometry(geo.buildings(spark, sf_dir).select("id", "usage", "bbox")).write.parquet(source)
    items = geoparquet.repack(spark, source, folder, 6, 12, build_queries.TILE_ROWS, ["Polygon"], size=100)
    per = geoparquet.footers(items).groupBy("file").agg(F.sum("rows").alias("rows"), F.count("*").alias("groups"), F.max("rows").alias("largest"))
    return per.join(items.select("file", "quadkey"), "file").select("quadkey", "rows", "groups", "largest")


@query(f"""WITH {geo.SQL}, bk AS (SELECT *, {quadkey_sql(12)} AS key FROM buildings), keys AS (SELECT key, count(*) AS n FROM bk GROUP BY 1), {build_queries._BNODES},
l AS (SELECT quadkey, id % 3 AS level, count(*) AS n FROM bk JOIN tiles ON starts_with(bk.key, tiles.quadkey) GROUP BY 1, 2)
SELECT cells_first, quadkey, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (level = 0), 0) AS BIGINT) AS coarse, CASE WHEN NOT cells_first THEN CAST(sum(ceil(n / 50.0)) AS BIGINT) END AS groups, true AS one_level FROM l, (VALUES (true), (false)) t(cells_first) GROUP BY 1, 2""")
def leveled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with levels, whole levels one after the other or cells with their levels inside: no row group holds two levels, so a reader
    of the coarse one skips the others by statistics."""
    d = build_queries._with_geometry(geo.buildings(spark, sf_dir).withColumn("level", F.col("id") % 3))
    out = None
    for first in (True, False):
        folder = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
        items = geoparquet.write_tiles(d, folder, 6, 12, build_queries.TILE_ROWS, ["Polygon"], size=50, level="level", cells_first=first, folders=True)
        own = geoparquet.read_tiles(spark, folder, items, "level long, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>", (-180.0, -90.0, 180.0, 90.0))
        coarse = own.groupBy("quadkey").agg(F.count("*").alias("found"), F.count_if(F.col("level") == 0).alias("coarse"))
        ranges = geoparquet.column_ranges(items, "level").groupBy("file").agg(F.bool_and(F.col("low") == F.col("high")).alias("one_level"))
        part = items.join(coarse.where("found > 0"), "quadkey").join(ranges, "file")
        part = part.select(F.lit(first).alias("cells_first"), "quadkey", F.col("found").alias("rows"), "coarse", F.when(~F.lit(first), F.col("groups")).alias("groups"), "one_level")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {geo.SQL} SELECT id, usage, 'Polygon' AS kind, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax, round((xmax - xmin) * (ymax - ymin) * 1000000, 4) AS area FROM buildings")
def feature_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as GeoJSON features, read again into geometries: kind, bounds and area are those of the boxes."""
    text = catalog.feature(catalog.box_geojson(F.col("bbox")), id=F.col("id"), usage=F.col("usage"))
    schema = "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<id:long,usage:string>"
    d = spread(geo.buildings(spark, sf_dir)).select(F.from_json(text, schema).alias("f")).select("f.properties.*", F.to_json("f.geometry").alias("geojson"))
    d = d.withColumn("geometry", kernels.geo_from_geojson("geojson")).withColumn("b", kernels.geo_bounds("geometry"))
    corner = [F.round(f"b.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return d.select("id", "usage", kernels.geo_type("geometry").alias("kind"), *corner, F.round(kernels.geo_area("geometry") * 1e6, 4).alias("area"))


_ZOOMS = (5, 7, 9, 11, 13, 15)
_ROADS = ["motorway", "trunk", "primary", "residential"]


@query(f"""WITH {geo.SQL}, z AS (SELECT * FROM (VALUES (5, 4, 0), (7, 6, 0), (9, 8, 0), (11, 8, 0), (13, 9, 1), (15, 11, 1)) t(zoom, digits, level)),
r AS (SELECT ['motorway', 'trunk', 'primary', 'residential'][CAST(id % 4 AS INT) + 1] AS name, count(*) AS n FROM roads GROUP BY 1),
b AS (SELECT CASE WHEN usage = 'PROMO' THEN 0 WHEN usage IN ('STANDARD', 'ECONOMY') THEN 1 ELSE 2 END AS rank, count(*) AS n FROM buildings GROUP BY 1)
SELECT zoom, digits, level, name, n FROM z JOIN r ON name IN ('motorway', 'residential') OR (name = 'trunk' AND zoom >= 8) OR (name = 'primary' AND zoom >= 10)
UNION ALL SELECT zoom, digits, level, 'buildings', CAST(sum(n) AS BIGINT) FROM z JOIN b ON (zoom = 13 AND rank <= 1) OR zoom = 15 GROUP BY 1, 2, 3""")
def zoom_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a map shows at a zoom: the mesh's digits, the level of lines simplified to 50 m, the road classes, and the tiers of buildings (all from
    zoom 14 on). One pass over each table counts by class and tier; the zooms are rows of a small table that meet the counts."""
    rows = [(z, grid.mesh_digits(z), grid.level_for_zoom(50, z), grid.road_classes(_ROADS, z), grid.tier_depth(z, 14, len(geo.TIERS))) for z in _ZOOMS]
    zooms = F.array(*[F.struct(F.lit(z).alias("zoom"), F.lit(d).alias("digits"), F.lit(v).alias("level"), F.array(*map(F.lit, c)).alias("classes"), F.lit(t).alias("depth")) for z, d, v, c, t in rows])
    name = F.get(F.array(*map(F.lit, _ROADS)), (F.col("id") % 4).cast("int"))
    roads = geo.roads(spark, sf_dir).groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    roads = roads.select("name", "n", F.inline(zooms)).where(F.array_contains("classes", F.col("name"))).select("zoom", "digits", "level", "name", "n")
    built = geo.buildings(spark, sf_dir).groupBy(f.tier_rank(F.col("usage"), None, geo.TIERS, False).alias("rank")).agg(F.count("*").alias("n"))
    built = built.select("rank", "n", F.inline(zooms)).where("rank <= depth").groupBy("zoom", "digits", "level").agg(F.sum("n").alias("n"))
    return roads.unionByName(built.withColumn("name", F.lit("buildings")))
