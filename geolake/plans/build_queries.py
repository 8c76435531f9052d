"""Builds with geometry kernels and files: coarse levels, dissolved areas, packed GeoParquet, catalogue items, a streaming roll-up.

Those without SQL are held against brute force by tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.functions import geometry, grid, kernels, wkb
from geolake.operators import aggregates as agg
from geolake.operators import extract
from geolake.operators import filters as f
from geolake.operators.spatial_join import overlap_join
from geolake.sources import geoparquet
from geolake.sources.shared import shared_dir
from geolake.streaming.coverage import stream_coverage

from . import geography as geo
from .mesh_queries import quadkey_sql
from .registry import registry

QUERIES, ORACLES, query = registry()


_STREETS = """streets AS (SELECT class, i, j, east, count(*) AS rows, CASE WHEN east = 1 THEN CAST(2 * i + 1 AS DOUBLE) ELSE CAST(2 * i AS DOUBLE) END / 100 AS mx, CASE WHEN east = 1 THEN CAST(2 * j AS DOUBLE) ELSE CAST(2 * j + 1 AS DOUBLE) END / 100 AS my
  FROM (SELECT class, CAST(floor(lon * 50) AS BIGINT) AS i, CAST(floor(lat * 50) AS BIGINT) AS j, id % 2 AS east FROM roads) GROUP BY 1, 2, 3, 4)"""


def road_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets on a square grid, one for each class, place and direction of the orders, so that ends meet; rows: the orders on it. mx, my: the middle."""
    cell = lambda c: F.floor(F.col(c) * 50)
    d = geo.roads(spark, sf_dir).groupBy("class", cell("lon").alias("i"), cell("lat").alias("j"), (F.col("id") % 2).alias("east")).agg(F.count("*").alias("rows"))
    middle = lambda v, along: (v * 2 + F.when(along, 1).otherwise(0)).cast("double") / 100
    d = d.withColumn("mx", middle(F.col("i"), F.col("east") == 1)).withColumn("my", middle(F.col("j"), F.col("east") != 1))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j, east = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("i", "j", "east"))
            ends = np.stack([np.stack([i / 50, j / 50], 1), np.stack([(i + east) / 50, (j + 1 - east) / 50], 1)], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, wkb.fixed("LineString", ends)], [*b.schema.names, "geometry"])

    return d.mapInArrow(drawn, "class string, i long, j long, east long, rows long, mx double, my double, geometry binary")


@query(f"WITH {geo.SQL}, {_STREETS} SELECT class, substr({geo.mesh_sql('mx', 'my')}, 1, 6) AS mesh_code, count(*) AS segments, CAST(sum(rows) AS BIGINT) AS rows, round(CAST(count(*) AS DOUBLE) / 50, 6) AS length, true AS merged FROM streets GROUP BY 1, 2")
def line_merge_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse level: all lines of a class in a 6-digit cell merged at their ends, then simplified to 100 m, with folds of what
    they stand for. A group is a cell, so it fits a task; merging keeps the length, and so does simplifying streets that are straight."""
    d = road_lines(spark, sf_dir).groupBy("class", grid.mesh_code(F.col("mx"), F.col("my"), 6).alias("mesh_code"))
    d = d.agg(F.array_sort(F.collect_list("geometry")).alias("parts"), F.count("*").alias("segments"), F.sum("rows").alias("rows"))
    d = d.withColumn("geometry", kernels.geo_simplify(100 / 111_320)(kernels.geo_merge_lines("parts")))
    merged = kernels.geo_type("geometry").isin("LineString", "MultiLineString")
    return d.select("class", "mesh_code", "segments", "rows", F.round(kernels.geo_length("geometry"), 6).alias("length"), merged.alias("merged"))


@query(f"WITH {geo.SQL} SELECT region, round(count(*) * CAST(0.34 AS DOUBLE) * CAST(0.26 AS DOUBLE), 6) AS area, round(min(xmin), 6) AS xmin, round(max(ymax), 6) AS ymax FROM admin GROUP BY 1")
def polygon_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as the union of their areas: edges that two areas share cancel out, the rest bounds the region."""
    b = lambda c: F.col(f"bbox.{c}")
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    ring = F.array(*[F.struct(b(x).alias("x"), b(y).alias("y")) for x, y in corners])
    edges = agg.boundary(geo.admin(spark, sf_dir).withColumn("ring", ring), "region", "ring")
    area = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    return edges.groupBy("region").agg(F.round(area, 6).alias("area"), F.round(F.min("ax"), 6).alias("xmin"), F.round(F.max("ay"), 6).alias("ymax"))


def _envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        box = b.column("bbox")
        yield pa.RecordBatch.from_arrays([*b.columns, wkb.envelopes(*(box.field(c).to_numpy(zero_copy_only=False) for c in ("xmin", "ymin", "xmax", "ymax")))], [*b.schema.names, "geometry"])


def _with_geometry(df: DataFrame) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_envelopes, f"{kinds}, geometry binary")


TILE_ROWS = 300


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Buildings as packed files of adaptive tiles: (items, folder)."""
    folder = f"{shared_dir(spark)}/buildings-{uuid.uuid4().hex}"
    return geoparquet.write_tiles(_with_geometry(geo.buildings(spark, sf_dir)), folder, 6, 12, TILE_ROWS, ["Polygon"], size=100), folder


@query(f"WITH {geo.SQL} SELECT id, usage FROM buildings WHERE xmin <= CAST(139.9 AS DOUBLE) AND xmax >= CAST(139.5 AS DOUBLE) AND ymin <= CAST(35.9 AS DOUBLE) AND ymax >= CAST(35.4 AS DOUBLE)")
def geoparquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed files written, read again: the view's box reaches the statistics of their row groups."""
    _, folder = _packed(spark, sf_dir)
    return spark.read.parquet(folder).where(geometry.intersects_view("bbox", 139.5, 35.4, 139.9, 35.9)).select("id", "usage")


_BNODES = f"""nodes AS (SELECT substr(key, 1, d) AS quadkey, CAST(sum(n) AS BIGINT) AS rows FROM keys, range(6, 13) t(d) GROUP BY 1),
tiles AS (SELECT a.quadkey FROM nodes a LEFT JOIN nodes p ON length(a.quadkey) > 6 AND p.quadkey = substr(a.quadkey, 1, length(a.quadkey) - 1) WHERE (p.quadkey IS NULL OR p.rows > {TILE_ROWS}) AND (a.rows <= {TILE_ROWS} OR length(a.quadkey) = 12))"""


@query(f"WITH {geo.SQL}, bk AS (SELECT *, {quadkey_sql(12)} AS key FROM buildings), keys AS (SELECT key, count(*) AS n FROM bk GROUP BY 1), {_BNODES} SELECT quadkey, count(*) AS rows, round(min(xmin), 6) AS xmin, round(max(ymax), 6) AS ymax FROM bk JOIN tiles ON starts_with(bk.key, tiles.quadkey) GROUP BY 1")
def items_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the packed files, added up from the footers of their row groups."""
    items, _ = _packed(spark, sf_dir)
    per = geoparquet.footers(items).groupBy("file").agg(F.sum("rows").alias("rows"), F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax"))
    return per.join(items.select("file", "quadkey"), "file").select("quadkey", "rows", F.round("xmin", 6).alias("xmin"), F.round("ymax", 6).alias("ymax"))


_OCEAN = """ocean AS (SELECT CAST(139 AS DOUBLE) + CAST(r_regionkey AS DOUBLE) * CAST(0.37 AS DOUBLE) AS oxmin, CAST(35 AS DOUBLE) + CAST(r_regionkey AS DOUBLE) * CAST(0.21 AS DOUBLE) AS oymin FROM region),
cut AS (SELECT a.admin_id, greatest(0, least(a.xmax, o.oxmin + CAST(0.2 AS DOUBLE)) - greatest(a.xmin, o.oxmin)) * greatest(0, least(a.ymax, o.oymin + CAST(0.15 AS DOUBLE)) - greatest(a.ymin, o.oymin)) AS wet FROM admin a, ocean o)"""


@query(f"WITH {geo.SQL}, {_OCEAN} SELECT a.admin_id, round(any_value((xmax - xmin) * (ymax - ymin)) - sum(wet), 7) AS land, round(sum(wet), 7) AS sea FROM admin a JOIN cut USING (admin_id) GROUP BY 1")
def ocean_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas less the sea: boxes meet by cells, the parts of the sea are cut to the area, gathered by area, and taken off; areas
    without sea stay whole. An area meets few pieces of sea, so its list is short."""
    k = F.col("r_regionkey").cast("double")
    x, y = F.lit(139.0) + k * 0.37, F.lit(35.0) + k * 0.21
    ocean = geo.table(spark, sf_dir, "region").select(F.struct(x.alias("xmin"), y.alias("ymin"), (x + 0.2).alias("xmax"), (y + 0.15).alias("ymax")).alias("sea"))
    areas = geo.admin(spark, sf_dir).select("admin_id", "bbox")
    wet = overlap_join(areas, ocean, "bbox", "sea").groupBy("admin_id").agg(F.collect_list("sea").alias("seas"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = lambda b: [(b["xmin"], b["ymin"]), (b["xmax"], b["ymin"]), (b["xmax"], b["ymax"]), (b["xmin"], b["ymax"]), (b["xmin"], b["ymin"])]
        size = lambda rings: sum(abs(kernels.signed_area(r)) for r in rings)
        for b in batches:
            land, sea = [], []
            for box, seas in zip(b.column("bbox").to_pylist(), b.column("seas").to_pylist()):
                dry = [ring(box)]
                for s in seas or []:
                    dry = kernels.difference_convex(dry, ring(s)[:-1])
                land.append(size(dry))
                sea.append(size([ring(box)]) - land[-1])  # seas that overlap count once
            yield pa.RecordBatch.from_arrays([b.column("admin_id"), pa.array(land), pa.array(sea, pa.float64())], ["admin_id", "land", "sea"])

    d = areas.join(wet, "admin_id", "left").mapInArrow(run, "admin_id int, land double, sea double")
    return d.select("admin_id", F.round("land", 7).alias("land"), F.round("sea", 7).alias("sea"))


_AT = geo.SEGMENT_IN_HOME


@query(f"""WITH {geo.SQL}, {geo.HOME_SQL}, s AS (SELECT *, ['motorway', 'trunk', 'primary', 'residential'][CAST(id % 4 AS INT) + 1] AS kind FROM roads)
SELECT CAST(id AS VARCHAR) AS id, kind AS class, CASE WHEN id % 6 = 0 THEN 'N' || CAST(id % 9 AS VARCHAR) ELSE '' END AS routes FROM s r WHERE kind <> 'residential' AND (id % 6 = 0 OR EXISTS (SELECT 1 FROM home a WHERE {_AT}))""")
def extract_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads as worldwide map data has them, extracted by class and by the country's polygons or networks."""
    k = F.col("id")
    d = geo.roads(spark, sf_dir).select(
        k.cast("string").alias("id"), F.struct(F.lit(None).cast("string").alias("primary")).alias("names"), F.get(F.array(*map(F.lit, ("motorway", "trunk", "primary", "residential"))), (k % 4).cast("int")).alias("class"),
        F.array(F.struct(F.concat(F.lit("N"), (k % 9).cast("string")).alias("name"), F.when(k % 6 == 0, "JP:national").otherwise("US:x").alias("network"))).alias("routes"), "bbox",
    )

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x1, y1, x2, y2 = (b.column("bbox").field(c).to_numpy(zero_copy_only=False) for c in ("xmin", "ymin", "xmax", "ymax"))
            yield pa.RecordBatch.from_arrays([*b.columns, wkb.fixed("LineString", np.stack([np.stack([x1, y1], 1), np.stack([x2, y2], 1)], 1))], [*b.schema.names, "geometry"])

    def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column("ring").flatten()
            xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
            yield pa.RecordBatch.from_arrays([b.column("bbox"), wkb.fixed("Polygon", xy.reshape(len(b), -1, 2) if len(b) else np.zeros((0, 6, 2)))], ["bbox", "geometry"])

    kinds = ", ".join(f"{f_.name} {f_.dataType.simpleString()}" for f_ in d.schema)
    home = geo.home_rings(spark, sf_dir).select("bbox", "ring")
    home = home.mapInArrow(ringed, f"bbox {home.schema['bbox'].dataType.simpleString()}, geometry binary")
    found = extract.roads(d.mapInArrow(drawn, f"{kinds}, geometry binary"), home)
    return found.select("id", "class", F.array_join("route_names", ",").alias("routes"))


@query(f"WITH {geo.SQL} SELECT DISTINCT {geo.mesh_sql('lon', 'lat')} AS mesh_code, round(CAST(1 AS DOUBLE) / 9600, 9) AS area, 'Polygon' AS kind FROM census")
def mesh_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as geometries."""
    d = geo.census(spark, sf_dir).select(grid.mesh_code(F.col("lon"), F.col("lat")).alias("mesh_code")).distinct()
    d = d.select("mesh_code", F.inline(F.array(grid.mesh_bounds(F.col("mesh_code")))))
    d = d.select("mesh_code", kernels.geo_envelope("xmin", "ymin", "xmax", "ymax").alias("geometry"))
    return d.select("mesh_code", F.round(kernels.geo_area("geometry"), 9).alias("area"), kernels.geo_type("geometry").alias("kind"))


@query(f"WITH {geo.SQL} SELECT class, count(*) AS n FROM roads WHERE class IN ('1-URGENT', '5-LOW') GROUP BY 1")
def partitioned_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by class, read back with the other classes' folders pruned."""
    path = f"{shared_dir(spark)}/roads-{uuid.uuid4().hex}"
    geo.roads(spark, sf_dir).select("id", "class", "bbox").write.partitionBy("class").parquet(path)
    return spark.read.parquet(path).where(F.col("class").isin("1-URGENT", "5-LOW")).groupBy("class").agg(F.count("*").alias("n"))


_Z = "least(14, 12 + CASE WHEN usage IN ('PROMO') THEN 0 WHEN usage IN ('STANDARD', 'ECONOMY') THEN 1 ELSE 2 END)"
_TXY = "least(greatest(CAST(floor((lon + 180) / 360 * pow(2, z)) AS BIGINT), 0), CAST(pow(2, z) AS BIGINT) - 1)"
_TYY = "least(greatest(CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS BIGINT), 0), CAST(pow(2, z) AS BIGINT) - 1)"


@query(f"WITH {geo.SQL}, b AS (SELECT *, {_Z} AS first FROM buildings), t AS (SELECT b.lon, b.lat, z FROM b, range(12, 15) r(z) WHERE z >= first) SELECT z, {_TXY} AS x, {_TYY} AS y, count(*) AS n FROM t GROUP BY 1, 2, 3")
def tile_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings in the vector tiles of zooms 12 to 14: the first tier from 12 on, the second from 13, the others at 14."""
    d = geo.buildings(spark, sf_dir).withColumn("rank", f.tier_rank(F.col("usage"), None, geo.TIERS, False))
    zooms = [F.struct(F.lit(z).alias("z"), grid.tile_x(F.col("lon"), z).alias("x"), grid.tile_y(F.col("lat"), z).alias("y")) for z in (12, 13, 14)]
    tiles = d.select("rank", F.explode(F.array(*zooms)).alias("t")).where("t.z - 12 >= rank")
    return tiles.groupBy(F.col("t.z").cast("long").alias("z"), "t.x", "t.y").agg(F.count("*").alias("n"))


_ELON, _ELAT = geo.lon("event_id"), geo.lat("event_id")


@query(f"SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS start, substr({geo.mesh_sql(_ELON, _ELAT)}, 1, 4) AS mesh_code, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_mesh_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_coverage(spark, f"{sf_dir}/events.parquet")
