"""Exact joins, overlays and unions of concave areas with holes and parts, and lines merged across any distance.

Lots (of suppliers) and zones (of customers) are copies of one shape on a lattice of 1/64 degree, every other one mirrored. All
coordinates are exact in binary, and edges run along the lattice or its diagonals, so that the oracles can count quarters
of the lattice's cells, or hold segments against convex parts, without rounding.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.functions import arrange, datum, kernels, wkb
from geolake.operators import chains, overlay, pieces
from geolake.operators import zones as zoning
from geolake.operators.extract import in_country
from geolake.sources import geoparquet
from geolake.sources.shared import shared_dir, spread, stored

from . import geography as geo
from .build_queries import _STREETS, TILE_ROWS, _with_geometry, road_lines
from .registry import registry

QUERIES, ORACLES, query = registry()

# The shape in units of the lattice (a concave shell with a hole, and an island), and the same as convex parts.
WIDTH = 22
SHELL, HOLE, ISLAND = [(0, 0), (20, 0), (20, 6), (12, 6), (12, 10), (16, 14), (4, 14), (0, 10)], [(4, 2), (8, 2), (8, 4), (4, 4)], [(17, 8), (21, 8), (19, 10)]
CONVEX = [
    [(0, 0), (4, 0), (4, 6), (0, 6)], [(8, 0), (20, 0), (20, 6), (8, 6)], [(4, 0), (8, 0), (8, 2), (4, 2)], [(4, 4), (8, 4), (8, 6), (4, 6)],
    [(0, 6), (12, 6), (12, 10), (0, 10)], [(0, 10), (12, 10), (16, 14), (4, 14)], ISLAND,
]


def _x(key: str) -> str:
    return f"(CAST({key} AS BIGINT) * {6007 if key.startswith('c_') else 7919} % 1066)"


def _y(key: str) -> str:
    return f"(CAST({key} AS BIGINT) * {90001 if key.startswith('c_') else 104729} % 818)"


def _shapes(df: DataFrame, key: str) -> DataFrame:
    """A table's rows as areas: (id, geometry, bbox, more columns)."""
    d = df.select(F.col(key).cast("long").alias("id"), F.expr(_x(key)).alias("ox"), F.expr(_y(key)).alias("oy"), *([F.col("c_nationkey").alias("nation")] if "c_nationkey" in df.columns else []))
    more = [c for c in d.columns if c not in ("id", "ox", "oy")]

    sample = ("MultiPolygon", [[[*SHELL, SHELL[0]], [*HOLE, HOLE[0]]], [[*ISLAND, ISLAND[0]]]])
    corners = np.array(wkb.flat(*sample), float)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, ox, oy = (b.column(c).to_numpy() for c in ("id", "ox", "oy"))
            x = np.where((i % 2 == 1)[:, None], WIDTH - corners[:, 0], corners[:, 0])
            points = np.stack([139 + (ox[:, None] + x) / 64, 35 + (oy[:, None] + corners[:, 1]) / 64], 2)
            e = np.hstack([points.min(1), points.max(1)])
            box = pa.StructArray.from_arrays([pa.array(e[:, k]) for k in range(4)], ["xmin", "ymin", "xmax", "ymax"])
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in more), arrange.like(sample, points), box], ["id", *more, "geometry", "bbox"])

    kinds = "".join(f"{c} {d.schema[c].dataType.simpleString()}, " for c in more)
    return spread(d, 2500).mapInArrow(draw, f"id long, {kinds}geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(geo.table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(geo.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")


#: Lines of two parts, in sixteenths of the lattice's units.
_PART = {"ax": "CAST({k} AS BIGINT) * 7919 % 17408", "ay": "CAST({k} AS BIGINT) * 104729 % 13312", "dx": "CAST({k} AS BIGINT) * 31 % 97 - 48", "dy": "CAST({k} AS BIGINT) * 17 % 89 - 44"}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of two parts: (id, geometry, bbox)."""
    d = geo.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), *(F.expr(e.format(k="o_orderkey")).alias(c) for c, e in _PART.items()))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ax, ay, dx, dy = (b.column(c).to_numpy().astype(float) for c in _PART)
            xy = np.stack([ax, ay, ax + dx, ay + dy, ax + 80, ay + 48, ax + 80 + dy, ay + 48 + dx], 1) / 1024 + np.array([139, 35] * 4)
            lines = [wkb.dumps("MultiLineString", [[(r[0], r[1]), (r[2], r[3])], [(r[4], r[5]), (r[6], r[7])]]) for r in xy.tolist()]
            box = pa.StructArray.from_arrays([pa.array(f(xy[:, k::2], axis=1)) for f, k in ((np.min, 0), (np.min, 1), (np.max, 0), (np.max, 1))] if len(xy) else [pa.array([], pa.float64())] * 4, ["xmin", "ymin", "xmax", "ymax"])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lines, pa.binary()), box], ["id", "geometry", "bbox"])

    return spread(d).mapInArrow(draw, "id long, geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")


_VALUES = ", ".join(f"({p}, {[list(v) for v in part]})" for p, part in enumerate(CONVEX))
#: Lots as convex parts and tracks as segments, in sixteenths; a segment and a part that share no point lie on two sides of a line along an edge or the segment.
_LOT_PARTS = f"""convex(p, vs) AS (VALUES {_VALUES}),
lots AS (SELECT s_suppkey AS id, p, CASE WHEN s_suppkey % 2 = 1 THEN -1 ELSE 1 END AS turn, list_transform(vs, lambda v: [16 * ({_x('s_suppkey')} + CASE WHEN s_suppkey % 2 = 1 THEN {WIDTH} - v[1] ELSE v[1] END), 16 * ({_y('s_suppkey')} + v[2])]) AS vs FROM supplier, convex),
parts AS (SELECT *, list_min(list_transform(vs, lambda v: v[1])) AS x0, list_max(list_transform(vs, lambda v: v[1])) AS x1, list_min(list_transform(vs, lambda v: v[2])) AS y0, list_max(list_transform(vs, lambda v: v[2])) AS y1 FROM lots),
base AS (SELECT o_orderkey AS id, {", ".join(f"{e.format(k='o_orderkey')} AS {c}" for c, e in _PART.items())} FROM orders),
segs AS (SELECT id, ax, ay, ax + dx AS bx, ay + dy AS b_y FROM base UNION ALL SELECT id, ax + 80, ay + 48, ax + 80 + dy, ay + 48 + dx FROM base),
near AS (SELECT s.id AS track, p.id AS lot, s.*, p.* FROM segs s JOIN parts p ON least(ax, bx) <= x1 AND greatest(ax, bx) >= x0 AND least(ay, b_y) <= y1 AND greatest(ay, b_y) >= y0),
met AS (SELECT DISTINCT track, lot FROM near WHERE
  len(list_filter(range(1, len(vs) + 1), lambda i: turn * ((vs[i % len(vs) + 1][1] - vs[i][1]) * (ay - vs[i][2]) - (vs[i % len(vs) + 1][2] - vs[i][2]) * (ax - vs[i][1])) < 0
    AND turn * ((vs[i % len(vs) + 1][1] - vs[i][1]) * (b_y - vs[i][2]) - (vs[i % len(vs) + 1][2] - vs[i][2]) * (bx - vs[i][1])) < 0)) = 0
  AND list_min(list_transform(vs, lambda v: (bx - ax) * (v[2] - ay) - (b_y - ay) * (v[1] - ax))) <= 0 AND list_max(list_transform(vs, lambda v: (bx - ax) * (v[2] - ay) - (b_y - ay) * (v[1] - ax))) >= 0)"""


@query(f"WITH {_LOT_PARTS} SELECT lot AS id, count(*) AS tracks FROM met GROUP BY 1")
def area_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several parts joined with the concave, holed areas that they touch, borders included: they meet in cells, and are
    tested and counted there."""
    return pieces.touch_counts(tracks(spark, sf_dir), lots(spark, sf_dir)).withColumnRenamed("n", "tracks")


@query(f"WITH {_LOT_PARTS} SELECT DISTINCT track AS id FROM met")
def lines_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a country of concave areas with holes and parts: boxes against pieces first, geometries near a border only."""
    return in_country(tracks(spark, sf_dir), lots(spark, sf_dir)).select("id")


#: Quarters of the lattice's cells by even-odd counting of the shape's edges right of their middles, in twelfths; q: south, east, north, west.
_EDGES = ", ".join(f"({12 * a[0]}, {12 * a[1]}, {12 * b[0]}, {12 * b[1]})" for ring in (SHELL, HOLE, ISLAND) for a, b in zip(ring, [*ring[1:], ring[0]]))
_QUARTERS = f"""edges(x1, y1, x2, y2) AS (VALUES {_EDGES}), offs(q, dx, dy) AS (VALUES (0, 6, 2), (1, 10, 6), (2, 6, 10), (3, 2, 6)),
mids AS (SELECT i, j, q, 12 * i + dx AS x, 12 * j + dy AS y FROM range(0, {WIDTH}) a(i), range(0, 14) b(j), offs),
shape AS (SELECT i, j, q FROM mids, edges WHERE (y1 > y) <> (y2 > y) AND ((x2 - x1) * (y - y1) > (x - x1) * (y2 - y1)) = (y2 > y1) GROUP BY i, j, q HAVING count(*) % 2 = 1),
both_ways AS (SELECT 0 AS odd, i, j, q FROM shape UNION ALL SELECT 1, {WIDTH - 1} - i, j, CASE q WHEN 1 THEN 3 WHEN 3 THEN 1 ELSE q END FROM shape),
lot AS (SELECT s_suppkey AS id, {_x('s_suppkey')} + i AS i, {_y('s_suppkey')} + j AS j, q FROM supplier JOIN both_ways ON odd = s_suppkey % 2),
zone AS (SELECT c_custkey AS other, c_nationkey AS nation, {_x('c_custkey')} + i AS i, {_y('c_custkey')} + j AS j, q FROM customer JOIN both_ways ON odd = c_custkey % 2)"""
_SQUARE = "CAST(16384 AS DOUBLE)"  # quarters in a square degree


@query(f"WITH {_QUARTERS} SELECT id, other, round(count(*) / {_SQUARE}, 9) AS area FROM lot JOIN zone USING (i, j, q) GROUP BY 1, 2")
def area_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every lot shares with every zone, as geometries; their areas."""
    found = overlay.intersection(lots(spark, sf_dir), zones(spark, sf_dir).withColumnRenamed("id", "other"))
    return found.select("id", "other", F.round(kernels.geo_area("geometry"), 9).alias("area"))


@query(f"WITH {_QUARTERS}, wet AS (SELECT DISTINCT i, j, q FROM zone) SELECT id, round(count(*) / {_SQUARE}, 9) AS area, round(CAST(139 AS DOUBLE) + min(i + CASE WHEN q = 1 THEN CAST(0.5 AS DOUBLE) ELSE 0 END) / 64, 9) AS xmin FROM lot ANTI JOIN wet USING (i, j, q) GROUP BY 1")
def area_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every lot without the zones, which overlap each other; nothing at all: no row."""
    dry = overlay.difference(lots(spark, sf_dir), zones(spark, sf_dir).withColumnRenamed("id", "other"))
    return dry.select("id", F.round(kernels.geo_area("geometry"), 9).alias("area"), F.round(kernels.geo_bounds("geometry")["xmin"], 9).alias("xmin"))


@query(f"WITH {_QUARTERS} SELECT nation, round(count(*) / {_SQUARE}, 9) AS area, round(CAST(35 AS DOUBLE) + min(j + CASE WHEN q = 2 THEN CAST(0.5 AS DOUBLE) ELSE 0 END) / 64, 9) AS ymin FROM (SELECT DISTINCT nation, i, j, q FROM zone) GROUP BY 1")
def area_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones of every nation as one area, with rings and holes."""
    found = overlay.union(zones(spark, sf_dir), "nation")
    return found.select("nation", F.round(kernels.geo_area("geometry"), 9).alias("area"), F.round(kernels.geo_bounds("geometry")["ymin"], 9).alias("ymin"))


@query(f"""WITH RECURSIVE {geo.SQL}, {_STREETS}, s AS (SELECT row_number() OVER (ORDER BY class, i, j, east) AS id, class, i, j, i + east AS i2, j + 1 - east AS j2 FROM streets),
e AS (SELECT id, class, i, j FROM s UNION ALL SELECT id, class, i2, j2 FROM s),
l AS (SELECT min(id) AS a, max(id) AS b FROM e GROUP BY class, i, j HAVING count(*) = 2),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT id, id AS c FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
c AS (SELECT id, min(c) AS chain FROM r GROUP BY 1),
k AS (SELECT class, chain, count(*) AS n FROM c JOIN s USING (id) GROUP BY 1, 2), m AS (SELECT chain, count(*) AS links FROM l JOIN c ON c.id = l.a GROUP BY 1)
SELECT class, count(*) AS lines, CAST(sum(n) AS BIGINT) AS segments, max(n) AS longest, count(*) FILTER (n = coalesce(links, 0)) AS closed, round(CAST(sum(n) AS DOUBLE) / 50, 6) AS length FROM k LEFT JOIN m USING (chain) GROUP BY 1""")
def road_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets merged across all cells and simplified as level 0, the streets themselves as level 1, in the same packed files; level 0 read back."""
    exact = road_lines(spark, sf_dir).select(F.xxhash64("class", "i", "j", "east").alias("id"), "class", F.lit(1).cast("long").alias("lines"), F.lit(False).alias("closed"), "geometry")
    coarse = chains.merged(exact, "class").select(F.col("chain").alias("id"), "class", "lines", "closed", kernels.geo_simplify(100 / 111_320)("geometry").alias("geometry"))
    rows = coarse.withColumn("level", F.lit(0)).unionByName(exact.withColumn("level", F.lit(1)))
    rows = stored(rows.withColumn("bbox", kernels.geo_bounds("geometry")), "levels")
    rows = rows.withColumn("lon", F.col("bbox.xmin")).withColumn("lat", F.col("bbox.ymin"))
    folder = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    geoparquet.write_tiles(rows, folder, 6, 12, 300, ["LineString"], size=100, level="level")
    back = spark.read.parquet(folder).where("level = 0")
    return back.groupBy("class").agg(
        F.count("*").alias("lines"), F.sum("lines").alias("segments"), F.max("lines").alias("longest"), F.count_if("closed").alias("closed"), F.round(F.sum(kernels.geo_length("geometry")), 6).alias("length")
    )


@query(f"""WITH offs(q, dx, dy) AS (VALUES (0, 6, 2), (1, 10, 6), (2, 6, 10), (3, 2, 6)), s AS (SELECT s_suppkey AS id, 12 * (s_suppkey % 7 + 1) AS w, 12 * (s_suppkey % 5 + 1) AS h FROM supplier),
m AS (SELECT id, w, h, 12 * i + dx AS x, 12 * j + dy AS y FROM s, range(-3, 12) a(i), range(-3, 10) b(j), offs)
SELECT id, round(count(*) / {_SQUARE}, 9) AS area FROM m WHERE least(greatest(0, -x, x - w) + abs(y), abs(x - w) + greatest(0, -y, y - h)) <= 24 GROUP BY 1""")
def line_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones around bent lines as polygons; discs of four corners keep the edges on the lattice's diagonals."""
    k = "CAST(s_suppkey AS BIGINT)"
    d = geo.table(spark, sf_dir, "supplier").selectExpr(f"{k} AS id", f"{_x('s_suppkey')} AS ox", f"{_y('s_suppkey')} AS oy", f"{k} % 7 + 1 AS w", f"{k} % 5 + 1 AS h")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ox, oy, w, h = (b.column(c).to_numpy().astype(float) for c in ("ox", "oy", "w", "h"))
            path = np.stack([np.stack([ox, oy], 1), np.stack([ox + w, oy], 1), np.stack([ox + w, oy + h], 1)], 1) / 64 + np.array([139.0, 35.0])
            yield pa.RecordBatch.from_arrays([b.column("id"), wkb.fixed("LineString", path)], ["id", "geometry"])

    found = zoning.zones(spread(d, 1000).mapInArrow(draw, "id long, geometry binary"), degrees=2 / 64, corners=4)
    return found.select("id", F.round(kernels.geo_area("geometry"), 9).alias("area"))


_STEP = 0.125
_DLON, _DLAT = "CAST(({i} * 7 + {j} * 3) % 11 AS DOUBLE) / 100000", "CAST(({i} * 5 + {j} * 2) % 13 AS DOUBLE) / 100000"
_MIX = "({a} + ({b} - {a}) * u + (({c} + ({d} - {c}) * u) - ({a} + ({b} - {a}) * u)) * v)"


def _mixed(e: str) -> str:
    at = lambda a, b: e.format(i=f"(i + {a})", j=f"(j + {b})")
    return _MIX.format(a=at(0, 0), b=at(1, 0), c=at(0, 1), d=at(1, 1))


@query(f"""WITH {geo.SQL}, p AS (SELECT c_custkey, lon, lat, CAST(floor(lon * 8) AS BIGINT) AS i, CAST(floor(lat * 8) AS BIGINT) AS j, lon * 8 - floor(lon * 8) AS u, lat * 8 - floor(lat * 8) AS v FROM census)
SELECT c_custkey, round(lon + {_mixed(_DLON)}, 9) AS lon, round(lat + {_mixed(_DLAT)}, 9) AS lat, true AS returns FROM p""")
def datum_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved by a grid of differences, and back again: under a tenth of a millimetre (1e-9 degrees) from where they were."""
    d = geo.census(spark, sf_dir).select("c_custkey", "lon", "lat")
    near = d.select(F.floor(F.col("lon") / _STEP).alias("a"), F.floor(F.col("lat") / _STEP).alias("b")).distinct()
    steps = F.array(*map(F.lit, (-1, 0, 1, 2)))
    corners = near.select(F.explode(F.transform(steps, lambda s: s + F.col("a"))).alias("i"), "b").select("i", F.explode(F.transform(steps, lambda s: s + F.col("b"))).alias("j")).distinct()
    corners = corners.select("i", "j", F.expr(_DLON.format(i="i", j="j")).alias("dlon"), F.expr(_DLAT.format(i="i", j="j")).alias("dlat"))
    cells = stored(datum.grid_cells(corners), "shift_grid")
    moved = datum.shift(d.withColumn("lon0", F.col("lon")).withColumn("lat0", F.col("lat")), cells, "lon", "lat", _STEP, _STEP)
    back = datum.shift(moved.withColumn("blon", F.col("lon")).withColumn("blat", F.col("lat")), cells, "blon", "blat", _STEP, _STEP, back=True)
    returns = (F.abs(F.col("blon") - F.col("lon0")) < 1e-9) & (F.abs(F.col("blat") - F.col("lat0")) < 1e-9)
    return back.select("c_custkey", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), returns.alias("returns"))


@query(f"WITH {geo.SQL} SELECT id, usage FROM buildings WHERE xmin <= CAST(139.82 AS DOUBLE) AND xmax >= CAST(139.78 AS DOUBLE) AND ymin <= CAST(35.67 AS DOUBLE) AND ymax >= CAST(35.63 AS DOUBLE)")
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around a place, from packed files: the catalogue's items choose the tiles that are opened."""
    folder = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    buildings = _with_geometry(geo.buildings(spark, sf_dir))
    items = geoparquet.write_tiles(buildings, folder, 6, 12, TILE_ROWS, ["Polygon"], size=100, folders=True)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in buildings.schema)
    return geoparquet.read_tiles(spark, folder, items, schema, (139.78, 35.63, 139.82, 35.67)).select("id", "usage")
