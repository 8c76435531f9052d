"""Queries on mesh cells, quadkeys and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.functions import grid
from geolake.operators import aggregates as agg

from . import geography as geo
from .registry import registry

QUERIES, ORACLES, query = registry()
M8 = geo.mesh_sql("lon", "lat")
WITH = f"WITH {geo.SQL}"
XY = ("lon", "lat")
# DuckDB text of an 8-digit cell's corner and of any cell's area, for the oracles
_Y0 = "(CAST(substr(m, 1, 2) AS DOUBLE) * 80 + CAST(substr(m, 5, 1) AS DOUBLE) * 10 + CAST(substr(m, 7, 1) AS DOUBLE))"
_X0 = "(CAST(substr(m, 3, 2) AS DOUBLE) * 80 + CAST(substr(m, 6, 1) AS DOUBLE) * 10 + CAST(substr(m, 8, 1) AS DOUBLE))"
_AREA = f"(radians(CAST(1 AS DOUBLE) / 80) * (sin(radians(({_Y0} + 1) / 120)) - sin(radians({_Y0} / 120))) * (CAST(6371.0088 AS DOUBLE) * CAST(6371.0088 AS DOUBLE)))"
CELLS = f"cells AS (SELECT m AS mesh_code, population, households, CAST(population AS DOUBLE) / {_AREA} AS density FROM (SELECT {M8} AS m, population, c_custkey % 4 AS households FROM census))"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.census(spark, sf_dir).select(grid.mesh_code(*map(F.col, XY)).alias("mesh_code"), "population", (F.col("c_custkey") % 4).alias("households"))
    return d.withColumn("density", F.col("population").cast("double") / grid.mesh_area_km2(F.col("mesh_code")))


@query(f"{WITH} SELECT c_custkey, {M8} AS mesh_code FROM census")
def mesh_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.census(spark, sf_dir).select("c_custkey", grid.mesh_code(*map(F.col, XY)).alias("mesh_code"))


@query(f"""{WITH} SELECT m || CAST((floor(lat * 240) % 2) * 2 + floor((lon - 100) * 160) % 2 + 1 AS INT)
  || CAST((floor(lat * 480) % 2) * 2 + floor((lon - 100) * 320) % 2 + 1 AS INT) || CAST((floor(lat * 960) % 2) * 2 + floor((lon - 100) * 640) % 2 + 1 AS INT) AS mesh_code,
  count(*) AS n FROM (SELECT *, {M8} AS m FROM census) GROUP BY 1""")
def mesh_code_finest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.census(spark, sf_dir).groupBy(grid.mesh_code(*map(F.col, XY), 11).alias("mesh_code")).agg(F.count("*").alias("n"))


@query(f"""{WITH} SELECT m AS mesh_code, round({_X0} / 80 + 100, 9) AS xmin, round({_Y0} / 120, 9) AS ymin, round(({_X0} + 1) / 80 + 100, 9) AS xmax, round(({_Y0} + 1) / 120, 9) AS ymax,
  round({_AREA}, 6) AS km2 FROM (SELECT DISTINCT {M8} AS m FROM census)""")
def mesh_bounds_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.census(spark, sf_dir).select(grid.mesh_code(*map(F.col, XY)).alias("mesh_code")).distinct().withColumn("b", grid.mesh_bounds(F.col("mesh_code")))
    return d.select("mesh_code", *[F.round(F.col("b")[x], 9).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")], F.round(grid.mesh_area_km2(F.col("mesh_code")), 6).alias("km2"))


def _rollup(digits: int):
    @query(f"{WITH}, {CELLS} SELECT substr(mesh_code, 1, {digits}) AS mesh_code, CAST(sum(population) AS BIGINT) AS population, round(max(density), 3) AS density FROM cells WHERE density IS NOT NULL GROUP BY 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return agg.mesh_rollup(_cells(spark, sf_dir), digits).withColumn("density", F.round("density", 3))

    QUERIES[f"mesh_rollup_{digits}"], ORACLES[f"mesh_rollup_{digits}"] = QUERIES.pop("run"), ORACLES.pop("run")


for _digits in (8, 6, 4):
    _rollup(_digits)


@query(f"""{WITH}, {CELLS} SELECT mesh_code, CAST(sum(population) AS BIGINT) AS population, CAST(sum(households) AS BIGINT) AS households, round(max(density), 3) AS density
  FROM (SELECT * FROM cells WHERE mesh_code < '5340' UNION ALL SELECT mesh_code, population, households, density FROM cells WHERE mesh_code >= '5239') GROUP BY 1""")
def mesh_two_file_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that overlap, added up by cell, with the totals compared."""
    tables = [_cells(spark, sf_dir).where("mesh_code < '5340'"), _cells(spark, sf_dir).where("mesh_code >= '5239'")]
    return agg.check_totals(tables, agg.accumulate(tables)).withColumn("density", F.round("density", 3))


COVERAGE = f"coverage AS (SELECT {M8} AS mesh_code, count(*) AS buildings, list_sort(list_distinct(list(city))) AS cities FROM buildings GROUP BY 1)"


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.coverage(geo.buildings(spark, sf_dir), *map(F.col, XY), F.col("city"))


@query(f"{WITH}, {COVERAGE} SELECT mesh_code, buildings, array_to_string(cities, '・') AS cities FROM coverage")
def coverage_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).withColumn("cities", F.array_join("cities", "・"))


@query(f"""{WITH}, {COVERAGE} SELECT substr(mesh_code, 1, 6) AS mesh_code, CAST(sum(buildings) AS BIGINT) AS buildings, count(*) AS filled,
  array_to_string(list_sort(list_distinct(flatten(list(cities)))), '・') AS cities, CAST(count(*) AS DOUBLE) / 100 AS ratio FROM coverage GROUP BY 1""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.coverage_rollup(_coverage(spark, sf_dir), 6).withColumn("cities", F.array_join("cities", "・"))


@query(f"""{WITH}, {COVERAGE} SELECT count(*) > 0 AS present FROM (SELECT 1 FROM coverage WHERE mesh_code LIKE '5339%' LIMIT 1)""")
def coverage_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked of the points: the first one in the area ends the search, no coverage is built."""
    d = geo.buildings(spark, sf_dir).where(grid.mesh_code(*map(F.col, XY), 8).startswith("5339"))
    return d.select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("present"))


_BANDS = "CASE WHEN density IS NULL THEN NULL WHEN density < 5 THEN {0} WHEN density < 50 THEN {1} WHEN density < 500 THEN {2} WHEN density < 5000 THEN {3} WHEN density < 50000 THEN {4} ELSE {5} END"
_ROWS = ((2, 3, 4, 5, 6, 7), (3, 4, 5, 6, 7, 8), (4, 5, 6, 7, 8, "NULL"), (5, 6, 7, 8, 9, "NULL"), (6, 7, 8, 9, 10, "NULL"))


@query(f"{WITH}, {CELLS} SELECT " + ", ".join(f"{_BANDS.format(*r)} AS class_{k}" for k, r in enumerate(_ROWS)) + ", count(*) AS n FROM cells GROUP BY 1, 2, 3, 4, 5")
def igrc_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy(*[grid.igrc(F.col("density"), k).alias(f"class_{k}") for k in range(5)]).agg(F.count("*").alias("n"))


_QX = "least(greatest(CAST(floor((lon + 180) / 360 * {n}) AS BIGINT), 0), {n} - 1)"
_QY = "least(greatest(CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {n}) AS BIGINT), 0), {n} - 1)"


def quadkey_sql(z: int) -> str:
    """SQL text of the quadkey of a place (lon, lat)."""
    x, y = _QX.format(n=1 << z), _QY.format(n=1 << z)
    return f"list_aggregate(list_transform(range({z} - 1, -1, -1), lambda k: CAST((({x} >> k) & 1) + (({y} >> k) & 1) * 2 AS VARCHAR)), 'string_agg', '')"


_L = f"l AS (SELECT l_orderkey * 8 + l_linenumber AS id, {geo.lon('l_orderkey * 8 + l_linenumber')} AS lon, {geo.lat('l_orderkey * 8 + l_linenumber')} AS lat FROM lineitem)"
_KEYS = f"keys AS (SELECT key, count(*) AS n FROM (SELECT {quadkey_sql(12)} AS key FROM l) GROUP BY 1)"


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).withColumn("lon", F.expr(geo.lon("id"))).withColumn("lat", F.expr(geo.lat("id")))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many(spark, sf_dir).groupBy(grid.quadkey(*map(F.col, XY), 12).alias("key")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT c_custkey, {quadkey_sql(12)} AS quadkey FROM census")
def quadkey_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.census(spark, sf_dir).select("c_custkey", grid.quadkey(*map(F.col, XY), 12).alias("quadkey"))


@query(f"WITH {_L}, {_KEYS} SELECT key, n FROM keys")
def quadkey_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


_TX = "list_reduce(list_transform(range(1, 9), lambda i: CAST(substr(key, i, 1) AS BIGINT) & 1), lambda a, b: a * 2 + b)"
_TY = "list_reduce(list_transform(range(1, 9), lambda i: CAST(substr(key, i, 1) AS BIGINT) >> 1), lambda a, b: a * 2 + b)"
_LATOF = "round(degrees(atan((exp(v) - exp(-v)) / 2)), 8)"


@query(f"""WITH {_L}, k AS (SELECT DISTINCT {quadkey_sql(8)} AS key FROM l), t AS (SELECT key, {_TX} AS x, {_TY} AS y FROM k)
SELECT key AS quadkey, round(CAST(x AS DOUBLE) / 256 * 360 - 180, 8) AS xmin, round(CAST(x + 1 AS DOUBLE) / 256 * 360 - 180, 8) AS xmax,
  round(degrees(atan((exp(pi() * (1 - CAST(y + 1 AS DOUBLE) * 2 / 256)) - exp(-pi() * (1 - CAST(y + 1 AS DOUBLE) * 2 / 256))) / 2)), 8) AS ymin,
  round(degrees(atan((exp(pi() * (1 - CAST(y AS DOUBLE) * 2 / 256)) - exp(-pi() * (1 - CAST(y AS DOUBLE) * 2 / 256))) / 2)), 8) AS ymax FROM t""")
def quadkey_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _many(spark, sf_dir).select(grid.quadkey(*map(F.col, XY), 8).alias("quadkey")).distinct().withColumn("b", grid.quadkey_bounds(F.col("quadkey")))
    return d.select("quadkey", *[F.round(F.col("b")[x], 8).alias(x) for x in ("xmin", "xmax", "ymin", "ymax")])


_TILES = f"""nodes AS (SELECT substr(key, 1, d) AS quadkey, CAST(sum(n) AS BIGINT) AS "rows" FROM keys, range(7, 13) t(d) GROUP BY 1),
tiles AS (SELECT a.quadkey, a."rows" FROM nodes a LEFT JOIN nodes p ON length(a.quadkey) > 7 AND p.quadkey = substr(a.quadkey, 1, length(a.quadkey) - 1)
  WHERE (p.quadkey IS NULL OR p."rows" > 400) AND (a."rows" <= 400 OR length(a.quadkey) = 12))"""


@query(f'WITH {_L}, {_KEYS}, {_TILES} SELECT quadkey, "rows" FROM tiles')
def choose_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.choose_tiles(_counts(spark, sf_dir), 7, 12, 400)


@query(f"WITH {_L}, {_KEYS}, {_TILES} SELECT quadkey, count(*) AS n FROM (SELECT {quadkey_sql(12)} AS key FROM l) k JOIN tiles ON starts_with(k.key, tiles.quadkey) GROUP BY 1")
def tile_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by tile: the distinct fine keys find their tiles, so rows are aggregated once and never multiplied."""
    counts = _counts(spark, sf_dir)
    return agg.tile_of_keys(counts, agg.choose_tiles(counts, 7, 12, 400), 7, 12).groupBy("quadkey").agg(F.sum("n").alias("n"))


_VIEWS = """views AS (SELECT n_nationkey AS view, CAST(139.1 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * CAST(0.031 AS DOUBLE) AS west, CAST(35.1 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * CAST(0.017 AS DOUBLE) AS south,
  CAST(0.013 AS DOUBLE) * CAST(n_nationkey AS DOUBLE) AS size FROM nation),
steps AS (SELECT view, size, west + least(i * CAST(0.00625 AS DOUBLE), size) AS x, south + least(j * CAST(0.00625 AS DOUBLE) * 2 / 3, size) AS y FROM views, range(0, 90) a(i), range(0, 130) b(j) WHERE (i - 1) * CAST(0.00625 AS DOUBLE) < size AND (j - 1) * CAST(0.00625 AS DOUBLE) * 2 / 3 < size)"""
_CODE = geo.mesh_sql("x", "y")


@query(f"""{WITH}, {_VIEWS}, c AS (SELECT view, list_sort(list_distinct(list({_CODE}))) AS fine, list_sort(list_distinct(list(substr({_CODE}, 1, 6)))) AS rough FROM steps GROUP BY 1)
SELECT view, CASE WHEN len(fine) <= 60 THEN array_to_string(fine, ',') WHEN len(rough) <= 15 THEN array_to_string(rough, ',') END AS codes FROM c""")
def mesh_cover_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of views of growing size: 8 digits, then 6, then none. The SQL walks the view by half cells instead."""
    k = F.col("n_nationkey").cast("double")
    west, south, size = F.lit(139.1) + k * 0.031, F.lit(35.1) + k * 0.017, F.lit(0.013) * k
    return geo.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("view"), F.array_join(grid.mesh_cover(west, south, west + size, south + size), ",").alias("codes"))
