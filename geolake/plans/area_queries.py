"""Queries on areas, buildings and roads: viewports, reverse geocoding, joins, nearness, layout."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolake.functions import geometry as g
from geolake.functions import grid, kernels, wkb
from geolake.operators import aggregates as agg
from geolake.operators import filters as f
from geolake.operators import spatial_join as sj
from geolake.sources.shared import shared_dir

from . import geography as geo
from .registry import registry

QUERIES, ORACLES, query = registry()
WITH = f"WITH {geo.SQL}"
W, S, E, N = 139.5, 35.4, 140.1, 35.9
_VIEW = f"xmin <= CAST({E} AS DOUBLE) AND xmax >= CAST({W} AS DOUBLE) AND ymin <= CAST({N} AS DOUBLE) AND ymax >= CAST({S} AS DOUBLE)"
_CENTRE = "pow(((xmin + xmax) / 2 - CAST(139.8 AS DOUBLE)) * cos(radians(CAST(35.65 AS DOUBLE))), 2) + pow((ymin + ymax) / 2 - CAST(35.65 AS DOUBLE), 2)"
_TIER = "CASE WHEN usage IN ('PROMO') THEN 'public' WHEN usage IN ('STANDARD', 'ECONOMY') THEN 'business' ELSE 'other' END"


def _tier():
    return f.tier_id(F.col("usage"), None, geo.TIERS, False)


@query(f"{WITH} SELECT id, name FROM buildings WHERE {_VIEW} ORDER BY round({_CENTRE}, 9), id LIMIT 50")
def viewport_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.buildings(spark, sf_dir).where(g.intersects_view("bbox", W, S, E, N))
    return f.top(d, 50, F.round(g.centre_distance("bbox", 139.8, 35.65), 9), F.col("id")).select("id", "name")


@query(f"{WITH} SELECT id, class, CAST(NULL AS VARCHAR) AS station_name FROM (SELECT *, lon AS xmin, lat AS ymin FROM roads) WHERE xmin BETWEEN CAST({W} AS DOUBLE) AND CAST({E} AS DOUBLE) AND ymin BETWEEN CAST({S} AS DOUBLE) AND CAST({N} AS DOUBLE) AND class IN ('1-URGENT', '2-HIGH')")
def viewport_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.roads(spark, sf_dir)
    return d.where(g.anchored_in("bbox", W, S, E, N) & f.value_in(F.col("class"), ["1-URGENT", "2-HIGH"])).select("id", "class", f.column_or_null(d, "station_name"))


@query(f"{WITH} SELECT id, {_TIER} AS tier FROM buildings WHERE {_VIEW} AND height >= 20 AND {_TIER} <> 'other'")
def viewport_height_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.buildings(spark, sf_dir).where(g.intersects_view("bbox", W, S, E, N))
    rank = f.tier_rank(F.col("usage"), None, geo.TIERS, False)
    return d.where(f.at_least(d, "height", 20) & (rank <= 1)).select("id", _tier().alias("tier"))


@query(f"{WITH} SELECT id FROM roads WHERE false")
def empty_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.roads(spark, sf_dir).where(f.value_in(F.col("class"), [])).select("id")


@query(f"{WITH} SELECT {_TIER} AS tier, CASE {_TIER} WHEN 'public' THEN 0 WHEN 'business' THEN 1 ELSE 2 END AS rank, CASE WHEN name <> '' THEN 'public' ELSE {_TIER} END AS named, count(*) AS n FROM buildings GROUP BY 1, 2, 3")
def rank_and_id_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.buildings(spark, sf_dir)
    f.check_rules(geo.TIERS, d.columns, "usage", True)
    return d.groupBy(_tier().alias("tier"), f.tier_rank(F.col("usage"), None, geo.TIERS, False).alias("rank"), f.tier_id(F.col("usage"), F.col("name"), geo.TIERS, True).alias("named")).agg(F.count("*").alias("n"))


_IN = "p.lon >= a.xmin AND p.lon <= a.xmax AND p.lat >= a.ymin AND p.lat <= a.ymax"


@query(f"{WITH}, p AS (SELECT l_orderkey, l_linenumber, {geo.lon('l_orderkey * 8 + l_linenumber')} AS lon, {geo.lat('l_orderkey * 8 + l_linenumber')} AS lat FROM lineitem) SELECT admin_id, count(*) AS n FROM p JOIN admin a ON {_IN} GROUP BY 1")
def reverse_geocode_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).select(F.expr(geo.lon("id")).alias("lon"), F.expr(geo.lat("id")).alias("lat"))
    return sj.point_join(d, geo.admin(spark, sf_dir), "lon", "lat", "bbox").groupBy("admin_id").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT admin_id, city_name FROM admin WHERE xmin <= CAST(139.7671 AS DOUBLE) AND xmax >= CAST(139.7671 AS DOUBLE) AND ymin <= CAST(35.6812 AS DOUBLE) AND ymax >= CAST(35.6812 AS DOUBLE) ORDER BY admin_id LIMIT 1")
def reverse_geocode_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.top(geo.admin(spark, sf_dir).where(g.contains_point("bbox", 139.7671, 35.6812)), 1, F.col("admin_id")).select("admin_id", "city_name")


_RING = "[[xmin, ymin], [xmax, ymin], [xmax, (ymin + ymax) / 2], [(xmin + xmax) / 2, ymax], [xmin, ymax], [xmin, ymin]]"


_rings = geo.rings


@query(f"{WITH}, r AS (SELECT admin_id, {_RING} AS r FROM admin) SELECT admin_id, round(list_sum(list_transform(range(1, 6), lambda i: r[i][1] * r[i + 1][2] - r[i + 1][1] * r[i][2])) / 2, 9) AS area FROM r")
def polygon_area_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("admin_id", F.round(g.ring_area(F.col("ring")), 9).alias("area"))


@query(f"""{WITH}, r AS (SELECT admin_id, xmin, ymin, xmax, ymax, {_RING} AS r FROM admin)
SELECT admin_id, count(*) AS n FROM census p JOIN r a ON {_IN} AND list_sum(list_transform(range(1, 6), lambda i: CASE WHEN (r[i][2] > lat) <> (r[i + 1][2] > lat) AND lon < (r[i + 1][1] - r[i][1]) * (lat - r[i][2]) / (r[i + 1][2] - r[i][2]) + r[i][1] THEN 1 ELSE 0 END)) % 2 = 1 GROUP BY 1""")
def pip_raycast(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sj.point_join(geo.census(spark, sf_dir).select("c_custkey", "lon", "lat"), _rings(spark, sf_dir), "lon", "lat", "bbox", g.ring_contains(F.col("ring"), F.col("lon"), F.col("lat")))
    return d.groupBy("admin_id").agg(F.count("*").alias("n"))


_ZONES = "zones AS (SELECT id, xmin - CAST(0.01 AS DOUBLE) AS xmin, ymin - CAST(0.01 AS DOUBLE) AS ymin, xmax + CAST(0.01 AS DOUBLE) AS xmax, ymax + CAST(0.01 AS DOUBLE) AS ymax FROM buildings)"


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings' boxes with about a kilometre around."""
    b = lambda c, d: (F.col(f"bbox.{c}") + d).alias(c)
    return geo.buildings(spark, sf_dir).select("id", F.struct((F.col("bbox.xmin") - 0.01).alias("xmin"), (F.col("bbox.ymin") - 0.01).alias("ymin"), b("xmax", 0.01), b("ymax", 0.01)).alias("bbox"))


@query(f"{WITH}, {_ZONES} SELECT a.id, count(*) AS n FROM zones a JOIN zones b ON a.id < b.id AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin GROUP BY 1")
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = _zones(spark, sf_dir)
    return sj.overlap_counts(zones, "id", "bbox").select(F.col("id").cast(zones.schema["id"].dataType), "n")


_HOME, _CUT, _home = geo.HOME_SQL, geo.CUT, geo.home_rings


@query(f"""{WITH}, {_HOME} SELECT id FROM buildings b WHERE EXISTS (SELECT 1 FROM home a WHERE a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin
  AND {_CUT.format(x='greatest(a.xmin, b.xmin)', y='greatest(a.ymin, b.ymin)')})""")
def in_country_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings that meet an area's polygon: boxes by cells, then box against polygon."""
    return sj.semi_overlap(geo.buildings(spark, sf_dir), _home(spark, sf_dir), "id", "bbox", "bbox", g.ring_meets_box(F.col("ring"), "bbox"), "ring").select("id")


@query(f"""{WITH}, {_HOME} SELECT id FROM roads r WHERE len(list_filter(route_names, lambda x: starts_with(x, 'Q1'))) > 0
  OR EXISTS (SELECT 1 FROM home a WHERE {geo.SEGMENT_IN_HOME})""")
def semi_or_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disjunction is split into two exclusive parts, so that the spatial part stays an equi-join; segments are held against polygons."""
    roads, home = geo.roads(spark, sf_dir), _home(spark, sf_dir)
    named = F.exists("route_names", lambda x: x.startswith("Q1"))
    exact = g.ring_meets_segment(F.col("ring"), *map(F.col, ("lon", "lat", "x2", "y2")))
    return roads.where(named).select("id").unionByName(sj.semi_overlap(roads.where(~named), home, "id", "bbox", "bbox", exact, "ring", ("lon", "lat", "x2", "y2")).select("id"))


_TX, _TY = "CAST(floor((lon + 180) / 360 * 2048) AS BIGINT)", "CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2048) AS BIGINT)"
_NORTH = "degrees(atan((exp(pi() * (1 - CAST({y} AS DOUBLE) * 2 / 2048)) - exp(-pi() * (1 - CAST({y} AS DOUBLE) * 2 / 2048))) / 2))"


@query(f"""{WITH}, {_HOME}, t AS (SELECT {_TX} AS x, {_TY} AS y, count(*) AS n FROM census GROUP BY 1, 2),
b AS (SELECT x, y, n, CAST(x AS DOUBLE) / 2048 * 360 - 180 AS xmin, CAST(x + 1 AS DOUBLE) / 2048 * 360 - 180 AS xmax, {_NORTH.format(y='y + 1')} AS ymin, {_NORTH.format(y='y')} AS ymax FROM t)
SELECT x, y, n FROM b WHERE EXISTS (SELECT 1 FROM home a WHERE a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin AND {_CUT.format(x='greatest(a.xmin, b.xmin)', y='greatest(a.ymin, b.ymin)')})""")
def tile_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semi-join at the grain of tiles: points are counted by tile first, and tiles, far fewer, meet the polygons."""
    tiles = geo.census(spark, sf_dir).groupBy(grid.tile_x(F.col("lon"), 11).alias("x"), grid.tile_y(F.col("lat"), 11).alias("y")).agg(F.count("*").alias("n"))
    tiles = tiles.withColumn("quadkey", grid.quadkey_of_tile(F.col("x"), F.col("y"), 11))
    tiles = tiles.select("*", F.inline(F.array(grid.quadkey_bounds(F.col("quadkey"))))).withColumn("bbox", g.box(*map(F.col, ("xmin", "ymin", "xmax", "ymax"))))  # worked out once a tile
    return sj.semi_overlap(tiles, _home(spark, sf_dir), "quadkey", "bbox", "bbox", g.ring_meets_box(F.col("ring"), "bbox"), "ring").select("x", "y", "n")


@query(f"""{WITH}, sea AS (SELECT n_nationkey AS admin_id, n_nationkey % 3 AS share FROM nation WHERE n_nationkey % 4 = 0)
SELECT admin_id, round((xmax - xmin) * (ymax - ymin) * (1 - coalesce(CAST(share AS DOUBLE), 0) / 4), 9) AS land FROM admin LEFT JOIN sea USING (admin_id)""")
def sea_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas less their share of sea; areas without sea stay whole."""
    sea = geo.table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("admin_id"), (F.col("n_nationkey") % 3).alias("share"))
    d = geo.admin(spark, sf_dir).join(sea, "admin_id", "left")
    whole = (F.col("bbox.xmax") - F.col("bbox.xmin")) * (F.col("bbox.ymax") - F.col("bbox.ymin"))
    return d.select("admin_id", F.round(whole * (F.lit(1.0) - F.coalesce(F.col("share").cast("double"), F.lit(0.0)) / 4), 9).alias("land"))


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON n_regionkey = r_regionkey")
def region_name_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geo.table(spark, sf_dir, "region").where("r_regionkey <> 3")
    return geo.table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


@query(f"{WITH} SELECT DISTINCT admin_id, coalesce(r_name, '') AS pref_name, '' AS county_name, city_name FROM admin LEFT JOIN region ON region = r_regionkey")
def admin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geo.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    d = geo.admin(spark, sf_dir).join(r, "region", "left")
    return d.select("admin_id", F.coalesce("r_name", F.lit("")).alias("pref_name"), F.lit("").alias("county_name"), "city_name").distinct()


_MX = "((lon - CAST(139.8 AS DOUBLE)) * CAST(111320 AS DOUBLE) * cos(radians(CAST(35.65 AS DOUBLE))))"
_MY = "((lat - CAST(35.65 AS DOUBLE)) * CAST(110540 AS DOUBLE))"


@query(f"{WITH} SELECT c_custkey, round(sqrt({_MX} * {_MX} + {_MY} * {_MY}), 3) AS metres FROM census")
def affine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.metres(F.col("lon"), F.col("lat"), 139.8, 35.65)
    return geo.census(spark, sf_dir).select("c_custkey", F.round(F.sqrt(x * x + y * y), 3).alias("metres"))


_NEAR = f"near AS (SELECT * FROM buildings WHERE {_MX} * {_MX} + {_MY} * {_MY} <= CAST(20000 AS DOUBLE) * 20000)"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings within 20 km: the box of the zone first, then the distance."""
    x, y = g.metres(F.col("lon"), F.col("lat"), 139.8, 35.65)
    return geo.buildings(spark, sf_dir).where(g.intersects_view("bbox", 139.57, 35.46, 140.03, 35.84) & (x * x + y * y <= 20000.0 * 20000.0))


@query(f"""{WITH}, {_NEAR} SELECT t.tier, count(near.id) AS n, array_to_string(coalesce(list_sort(list_distinct(list(near.name) FILTER (near.name IS NOT NULL))), []), ',') AS names
FROM (VALUES ('public'), ('business'), ('other')) t(tier) LEFT JOIN near ON {_TIER} = t.tier GROUP BY 1""")
def nearby_buildings_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(geo.TIERS)], "place int, tier string")  # a list of the rules
    d = _near(spark, sf_dir).groupBy(_tier().alias("tier")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
    return tiers.join(d, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("names"))


@query(f"{WITH}, {_NEAR}, d AS (SELECT DISTINCT name FROM near WHERE name IS NOT NULL) SELECT name, (SELECT count(*) FROM d) AS total FROM d ORDER BY name LIMIT 30")
def nearby_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _near(spark, sf_dir).where("name is not null").select("name").distinct()
    return f.top(d, 30, F.col("name")).withColumn("total", d.agg(F.count("*")).scalar())


@query(f"{WITH} SELECT CAST(coalesce(sum(population), 0) AS BIGINT) AS population, count(*) AS cells FROM census WHERE {_MX} * {_MX} + {_MY} * {_MY} <= CAST(20000 AS DOUBLE) * 20000")
def nearby_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.metres(F.col("lon"), F.col("lat"), 139.8, 35.65)
    return geo.census(spark, sf_dir).where(x * x + y * y <= 20000.0 * 20000.0).agg(F.coalesce(F.sum("population"), F.lit(0)).alias("population"), F.count("*").alias("cells"))


_PX = "(({x} - CAST(139.8 AS DOUBLE)) * CAST(111320 AS DOUBLE) * cos(radians(CAST(35.65 AS DOUBLE))))"
_PY = "(({y} - CAST(35.65 AS DOUBLE)) * CAST(110540 AS DOUBLE))"
_LINE = [(139.6, 35.5), (139.8, 35.65), (140.1, 35.7)]
_TO = "sqrt(pow(px - (ax + t * (ex - ax)), 2) + pow(py - (ay + t * (ey - ay)), 2))"


@query(f"""{WITH}, s(x1, y1, x2, y2) AS (VALUES {", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))" for (a, b), (c, d) in zip(_LINE, _LINE[1:]))}),
m AS (SELECT c_custkey, population, {_MX} AS px, {_MY} AS py, {_PX.format(x='x1')} AS ax, {_PY.format(y='y1')} AS ay, {_PX.format(x='x2')} AS ex, {_PY.format(y='y2')} AS ey FROM census, s),
d AS (SELECT *, least(greatest(((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0), 1) AS t FROM m)
SELECT c_custkey, round(min({_TO}), 3) AS metres FROM d GROUP BY 1 HAVING min({_TO}) <= 3000""")
def nearby_line_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within 3 km of a line: the box of the zone first, then the least distance to the line's segments."""
    x, y = g.metres(F.col("lon"), F.col("lat"), 139.8, 35.65)
    flat = [tuple(v for p in (a, b) for v in ((p[0] - 139.8) * g.METRES_LON * math.cos(math.radians(35.65)), (p[1] - 35.65) * g.METRES_LAT)) for a, b in zip(_LINE, _LINE[1:])]
    d = geo.census(spark, sf_dir).where("lon between 139.55 and 140.15 and lat between 35.45 and 35.75").select("c_custkey", x.alias("x"), y.alias("y"))
    metres = F.least(*[g.segment_distance(F.col("x"), F.col("y"), *map(F.lit, s)) for s in flat])
    return d.select("c_custkey", metres.alias("metres")).where("metres <= 3000").withColumn("metres", F.round("metres", 3))


def _cell_sql(digits: int, radius: int) -> str:
    ny, nx = grid.MESH_PARTS[digits]
    box = [_PX.format(x=f"(cx / CAST({nx} AS DOUBLE) + 100)"), _PX.format(x=f"((cx + 1) / CAST({nx} AS DOUBLE) + 100)"), _PY.format(y=f"(cy / CAST({ny} AS DOUBLE))"), _PY.format(y=f"((cy + 1) / CAST({ny} AS DOUBLE))")]
    return f"""SELECT {digits} AS digits, CAST(coalesce(sum(population), 0) AS BIGINT) AS population, count(*) AS cells FROM (SELECT floor((lon - 100) * {nx}) AS cx, floor(lat * {ny}) AS cy, sum(population) AS population FROM census GROUP BY 1, 2)
  WHERE pow(greatest({box[0]}, 0, -{box[1]}), 2) + pow(greatest({box[2]}, 0, -{box[3]}), 2) <= pow(CAST({radius} AS DOUBLE), 2)"""


@query(f"{WITH} " + " UNION ALL ".join(f"SELECT * FROM (SELECT {r} AS radius, * FROM ({_cell_sql(8, r)} UNION ALL {_cell_sql(6, r)}) WHERE cells > 0 ORDER BY digits DESC LIMIT 1)" for r in (300, 9000)))
def nearby_population_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cells that a radius touches, of the finest mesh that has any: 8 digits, or else 6."""
    d = geo.census(spark, sf_dir)
    levels = {}
    for digits in (8, 6):
        cells = d.groupBy(grid.mesh_code(F.col("lon"), F.col("lat"), digits).alias("m")).agg(F.sum("population").alias("population"))
        cells = cells.select("population", F.inline(F.array(grid.mesh_bounds(F.col("m")))))  # worked out once a cell
        (x1, y1), (x2, y2) = g.metres(F.col("xmin"), F.col("ymin"), 139.8, 35.65), g.metres(F.col("xmax"), F.col("ymax"), 139.8, 35.65)
        levels[digits] = cells.select(g.box(x1, y1, x2, y2).alias("b"), "population")
    return reduce(DataFrame.unionByName, [agg.nearby_cells(levels, F.lit(0.0), F.lit(0.0), float(r)).withColumn("radius", F.lit(r)) for r in (300, 9000)])


@query(f"""{WITH}, a AS (SELECT s_suppkey, {_MX} AS x, {_MY} AS y FROM stations), b AS (SELECT c_custkey, {_MX} AS u, {_MY} AS v FROM census)
SELECT s_suppkey, count(*) AS n, round(min(sqrt((x - u) * (x - u) + (y - v) * (y - v))), 3) AS nearest FROM a JOIN b ON (x - u) * (x - u) + (y - v) * (y - v) <= CAST(5000 AS DOUBLE) * 5000 GROUP BY 1""")
def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.metres(F.col("lon"), F.col("lat"), 139.8, 35.65)
    a = geo.stations(spark, sf_dir).select("s_suppkey", x.alias("x"), y.alias("y"))
    b = geo.census(spark, sf_dir).select("c_custkey", x.alias("u"), y.alias("v"))
    return sj.nearby_counts(a, b, "s_suppkey", 5000.0, "x", "y", "u", "v").select("s_suppkey", "n", F.round("nearest", 3).alias("nearest"))


_T = ["CASE WHEN dx <> 0 THEN (CAST({w} AS DOUBLE) - lon) / dx WHEN lon < {w} THEN 2 ELSE 0 END", "CASE WHEN dx <> 0 THEN (CAST({e} AS DOUBLE) - lon) / dx WHEN lon > {e} THEN -1 ELSE 1 END",
      "CASE WHEN dy <> 0 THEN (CAST({s} AS DOUBLE) - lat) / dy WHEN lat < {s} THEN 2 ELSE 0 END", "CASE WHEN dy <> 0 THEN (CAST({n} AS DOUBLE) - lat) / dy WHEN lat > {n} THEN -1 ELSE 1 END"]
_TW, _TE, _TS, _TN = (t.format(w=W, e=E, s=S, n=N) for t in _T)


@query(f"""{WITH}, q AS (SELECT *, x2 - lon AS dx, y2 - lat AS dy FROM roads), t AS (SELECT *, greatest(0, {_TW}, {_TS}) AS t0, least(1, {_TE}, {_TN}) AS t1 FROM q)
SELECT id, round(lon + t0 * dx, 6) AS x1, round(lat + t0 * dy, 6) AS y1, round(lon + t1 * dx, 6) AS x2, round(lat + t1 * dy, 6) AS y2 FROM t WHERE t0 <= t1""")
def segment_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.roads(spark, sf_dir)
    t0, t1 = g.clip_segment(F.col("lon"), F.col("lat"), F.col("x2"), F.col("y2"), W, S, E, N)
    d = d.withColumn("t0", t0).withColumn("t1", t1).where("t0 <= t1")
    at = lambda a, b, t: F.round(F.col(a) + F.col(t) * (F.col(b) - F.col(a)), 6)
    return d.select("id", at("lon", "x2", "t0").alias("x1"), at("lat", "y2", "t0").alias("y1"), at("lon", "x2", "t1").alias("x2"), at("lat", "y2", "t1").alias("y2"))


@query(f"""{WITH} SELECT count(*) AS n, round(min(xmin), 9) AS xmin, round(min(ymin), 9) AS ymin, round(max(xmax), 9) AS xmax, round(max(ymax), 9) AS ymax,
  string_agg(DISTINCT CASE WHEN id % 3 = 0 THEN 'LineString' ELSE 'Polygon' END, ',' ORDER BY CASE WHEN id % 3 = 0 THEN 'LineString' ELSE 'Polygon' END) AS kinds FROM buildings""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, extent and the kinds of geometries, as their WKB has them; every third building is drawn as a line."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            box = b.column("bbox")
            xmin, ymin, xmax, ymax = (box.field(c).to_numpy(zero_copy_only=False) for c in ("xmin", "ymin", "xmax", "ymax"))
            line = wkb.fixed("LineString", np.stack([np.stack([xmin, ymin], 1), np.stack([xmax, ymax], 1)], 1))
            third = pc.equal(pc.subtract(b.column("id"), pc.multiply(pc.divide(b.column("id"), 3), 3)), 0)
            yield pa.RecordBatch.from_arrays([box, pc.if_else(third, line, wkb.envelopes(xmin, ymin, xmax, ymax))], ["bbox", "geometry"])

    d = geo.buildings(spark, sf_dir).select(F.col("id").cast("long").alias("id"), "bbox")
    d = d.mapInArrow(drawn, f"bbox {d.schema['bbox'].dataType.simpleString()}, geometry binary").withColumn("kind", kernels.geo_type("geometry"))
    e = ("xmin", "ymin", "xmax", "ymax")
    per = d.groupBy("kind").agg(F.count("*").alias("n"), *[(F.min if c.endswith("min") else F.max)(f"bbox.{c}").alias(c) for c in e])
    return per.agg(F.sum("n").alias("n"), *[F.round((F.min if c.endswith("min") else F.max)(c), 9).alias(c) for c in e], F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query(f"{WITH} SELECT city, count(*) AS n, round(min(xmin), 9) AS xmin, round(max(ymax), 9) AS ymax FROM buildings GROUP BY 1")
def extent_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.buildings(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n"), F.round(F.min("bbox.xmin"), 9).alias("xmin"), F.round(F.max("bbox.ymax"), 9).alias("ymax"))


@query(f"""{WITH}, r AS (SELECT class, list_sort(route_names)[1] AS route, lon FROM roads), m AS (SELECT class, route, count(*) AS n, round(min(lon), 6) AS lon FROM r GROUP BY 1, 2)
SELECT 0 AS lod, class, route, n, lon FROM m UNION ALL SELECT 1 AS lod, class, route, 1 AS n, round(lon, 6) AS lon FROM r""")
def coarse_plus_exact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse rows (merged by class and route, null keys together) beside the exact ones."""
    r = geo.roads(spark, sf_dir).select("class", F.get(F.array_sort("route_names"), F.lit(0)).alias("route"), "lon")
    coarse = r.groupBy("class", "route").agg(F.count("*").alias("n"), F.round(F.min("lon"), 6).alias("lon")).withColumn("lod", F.lit(0))
    return coarse.unionByName(r.select("class", "route", F.lit(1).cast("long").alias("n"), F.round("lon", 6).alias("lon"), F.lit(1).alias("lod")))


@query(f"{WITH} SELECT id, usage, city FROM buildings WHERE {_VIEW} AND height <= 10")
def export_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a view shows of a level, written with a limit and read back."""
    d = geo.buildings(spark, sf_dir).withColumn("lod", F.when(F.col("height") <= 10, 1).otherwise(0))
    d = d.where(g.intersects_view("bbox", W, S, E, N) & f.level(d, 1)).drop("lod").select("id", "usage", "city")
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    f.export(d, path, 100_000_000)
    return spark.read.schema(d.schema).parquet(path)


@query(f"{WITH}, o AS (SELECT id, xmin + xmax AS cx, ymin + ymax AS cy, row_number() OVER (ORDER BY xmin + xmax, id) - 1 AS i FROM buildings), s AS (SELECT *, i // 500 AS strip FROM o), p AS (SELECT *, row_number() OVER (PARTITION BY strip ORDER BY cy, id) - 1 AS j FROM s) SELECT strip, j // 100 AS cell, count(*) AS n, round(max(cx) - min(cx), 6) AS width, round(max(cy) - min(cy), 6) AS height FROM p GROUP BY 1, 2")
def str_pack_rowgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips along x, cells along y inside a strip: the extents of the row groups of a packed file (one file's rows)."""
    d = geo.buildings(spark, sf_dir).select("id", (F.col("bbox.xmin") + F.col("bbox.xmax")).alias("cx"), (F.col("bbox.ymin") + F.col("bbox.ymax")).alias("cy"))
    d = agg.places(d, "cx", "id", F.floor(F.col("cx") * 500)).withColumn("strip", F.floor(F.col("place") / 500))
    d = d.withColumn("cell", F.floor((F.row_number().over(Window.partitionBy("strip").orderBy("cy", "id")) - 1) / 100))
    return d.groupBy("strip", "cell").agg(F.count("*").alias("n"), F.round(F.max("cx") - F.min("cx"), 6).alias("width"), F.round(F.max("cy") - F.min("cy"), 6).alias("height"))
