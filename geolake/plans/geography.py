"""Geographic tables over the star schema: every id gets a place by exact integer arithmetic, the same in any engine.

customer: census points, supplier: stations, part: buildings, orders: road segments, nation: admin areas on a 5 x 5 grid.
The grid's lines lie at odd multiples of 0.00005 degrees, so no place with four decimals is on a border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tiers of building uses, by the kinds of part.
TIERS = [("public", ["PROMO"]), ("business", ["STANDARD", "ECONOMY"]), ("other", None)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon(key: str) -> str:
    """SQL text that Spark and other engines read alike."""
    return f"(139 + CAST((CAST({key} AS BIGINT) * 7919) % 17000 AS DOUBLE) / CAST(10000 AS DOUBLE))"


def lat(key: str) -> str:
    return f"(35 + CAST((CAST({key} AS BIGINT) * 104729) % 13000 AS DOUBLE) / CAST(10000 AS DOUBLE))"


def points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).withColumn("lon", F.expr(lon(key))).withColumn("lat", F.expr(lat(key)))


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "customer", "c_custkey").withColumn("population", F.col("c_acctbal").cast("bigint"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = points(spark, sf_dir, "part", "p_partkey").withColumn("half", F.col("p_size").cast("double") * 0.0001)
    box = F.struct((F.col("lon") - F.col("half")).alias("xmin"), (F.col("lat") - F.col("half")).alias("ymin"), (F.col("lon") + F.col("half")).alias("xmax"), (F.col("lat") + F.col("half")).alias("ymax"))
    return d.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("usage"), F.col("p_size").alias("height"), F.col("p_brand").alias("city"), "lon", "lat", box.alias("bbox"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("operator"))
    d = points(spark, sf_dir, "supplier", "s_suppkey").join(F.broadcast(n), "s_nationkey")  # the nations of the world
    station, line = F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string")), F.concat(F.lit("L"), (F.col("s_suppkey") % 7).cast("string"))
    return d.select("s_suppkey", station.alias("station"), line.alias("line"), "operator", "lon", "lat")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = points(spark, sf_dir, "orders", "o_orderkey").withColumn("x2", F.col("lon") + (F.col("o_orderkey") * 31 % 200).cast("double") / 10000.0)
    d = d.withColumn("y2", F.col("lat") + (F.col("o_orderkey") * 17 % 200).cast("double") / 10000.0)
    box = F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    routes = F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 5 == 1, F.array(F.concat(F.lit("R"), (F.col("o_orderkey") % 30).cast("string")))).otherwise(
        F.array(F.concat(F.lit("R"), (F.col("o_orderkey") % 30).cast("string")), F.concat(F.lit("Q"), (F.col("o_orderkey") % 11).cast("string")))
    )
    return d.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"), "lon", "lat", "x2", "y2", box.alias("bbox"), routes.alias("route_names"))


def admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    xmin, ymin = F.lit(138.99995) + (k % 5).cast("double") * 0.34, F.lit(34.99995) + F.floor(k / 5).cast("double") * 0.26
    box = F.struct(xmin.alias("xmin"), ymin.alias("ymin"), (xmin + 0.34).alias("xmax"), (ymin + 0.26).alias("ymax"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("admin_id"), F.col("n_name").alias("city_name"), F.col("n_regionkey").alias("region"), box.alias("bbox"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin areas with their north-eastern corner cut off."""
    b = lambda c: F.col(f"bbox.{c}")
    xy = [(b("xmin"), b("ymin")), (b("xmax"), b("ymin")), (b("xmax"), (b("ymin") + b("ymax")) / 2), ((b("xmin") + b("xmax")) / 2, b("ymax")), (b("xmin"), b("ymax")), (b("xmin"), b("ymin"))]
    return admin(spark, sf_dir).withColumn("ring", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in xy]))


def home_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of the home country."""
    return rings(spark, sf_dir).where("region IN (0, 2)")


#: The same tables for other engines, as common table expressions.
SQL = f"""
census AS (SELECT c_custkey, c_name, {lon('c_custkey')} AS lon, {lat('c_custkey')} AS lat, CAST(trunc(c_acctbal) AS BIGINT) AS population FROM customer),
buildings AS (SELECT p_partkey AS id, p_name AS name, p_type AS usage, p_size AS height, p_brand AS city, lon, lat, lon - h AS xmin, lat - h AS ymin, lon + h AS xmax, lat + h AS ymax
  FROM (SELECT *, {lon('p_partkey')} AS lon, {lat('p_partkey')} AS lat, CAST(p_size AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS h FROM part)),
stations AS (SELECT s_suppkey, 'S' || CAST(s_suppkey % 40 AS VARCHAR) AS station, 'L' || CAST(s_suppkey % 7 AS VARCHAR) AS line, n_name AS operator, {lon('s_suppkey')} AS lon, {lat('s_suppkey')} AS lat
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
roads AS (SELECT o_orderkey AS id, o_orderpriority AS class, lon, lat, lon + CAST(o_orderkey * 31 % 200 AS DOUBLE) / CAST(10000 AS DOUBLE) AS x2, lat + CAST(o_orderkey * 17 % 200 AS DOUBLE) / CAST(10000 AS DOUBLE) AS y2,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST([] AS VARCHAR[]) WHEN o_orderkey % 5 = 1 THEN ['R' || CAST(o_orderkey % 30 AS VARCHAR)] ELSE ['R' || CAST(o_orderkey % 30 AS VARCHAR), 'Q' || CAST(o_orderkey % 11 AS VARCHAR)] END AS route_names
  FROM (SELECT *, {lon('o_orderkey')} AS lon, {lat('o_orderkey')} AS lat FROM orders)),
admin AS (SELECT n_nationkey AS admin_id, n_name AS city_name, n_regionkey AS region, xmin, ymin, xmin + CAST(0.34 AS DOUBLE) AS xmax, ymin + CAST(0.26 AS DOUBLE) AS ymax
  FROM (SELECT *, CAST(138.99995 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.34 AS DOUBLE) AS xmin, CAST(34.99995 AS DOUBLE) + CAST(n_nationkey // 5 AS DOUBLE) * CAST(0.26 AS DOUBLE) AS ymin FROM nation))
"""


#: Home areas with their north-eastern corner cut off: a convex area, so a shape meets it where the corner of what they share lies below the cut.
HOME_SQL = "home AS (SELECT *, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM admin WHERE region IN (0, 2))"
CUT = "({x} - a.cx) / (a.xmax - a.cx) + ({y} - a.cy) / (a.ymax - a.cy) <= 1"
_T0 = "greatest(0, CASE WHEN x2 > lon THEN (a.xmin - lon) / (x2 - lon) ELSE 0 END, CASE WHEN y2 > lat THEN (a.ymin - lat) / (y2 - lat) ELSE 0 END)"
_T1 = "least(1, CASE WHEN x2 > lon THEN (a.xmax - lon) / (x2 - lon) ELSE 1 END, CASE WHEN y2 > lat THEN (a.ymax - lat) / (y2 - lat) ELSE 1 END)"
#: Whether the ascending segment of the road r meets the home area a.
SEGMENT_IN_HOME = f"a.xmin <= r.x2 AND a.xmax >= r.lon AND a.ymin <= r.y2 AND a.ymax >= r.lat AND {_T0} <= {_T1} AND {CUT.format(x=f'(lon + {_T0} * (x2 - lon))', y=f'(lat + {_T0} * (y2 - lat))')}"


def mesh_sql(x: str, y: str) -> str:
    """SQL text of the 8-digit mesh code of a place."""
    iy, ix = f"CAST(floor({y} * 120) AS BIGINT)", f"CAST(floor(({x} - 100) * 80) AS BIGINT)"
    d = lambda e, n=1: f"lpad(CAST({e} AS VARCHAR), {n}, '0')"
    return f"({d(f'({iy} // 80)', 2)} || {d(f'({ix} // 80)', 2)} || {d(f'({iy} // 10 % 8)')} || {d(f'({ix} // 10 % 8)')} || {d(f'({iy} % 10)')} || {d(f'({ix} % 10)')})"
