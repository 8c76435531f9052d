"""Text search, indexes and vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.operators import aggregates as agg
from geolake.operators import filters as f

from . import geography as geo
from .registry import registry

QUERIES, ORACLES, query = registry()
WITH = f"WITH {geo.SQL}"


@query(f"{WITH} SELECT city_name || '・' || coalesce(r_name, '') AS label, admin_id FROM admin LEFT JOIN region ON region = r_regionkey WHERE city_name || '・' || coalesce(r_name, '') ILIKE '%nation%' AND city_name || '・' || coalesce(r_name, '') ILIKE '%a_i%' ORDER BY length(label), admin_id LIMIT 10")
def search_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geo.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    label = F.concat("city_name", F.lit("・"), F.coalesce("r_name", F.lit("")))
    d = geo.admin(spark, sf_dir).join(r, "region", "left").select(label.alias("label"), "admin_id")
    return f.top(d.where(f.matches(F.col("label"), "nation　a_i")), 10, F.length("label"), F.col("admin_id"))


@query(f"{WITH} SELECT station || '駅' AS label, line, operator, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat FROM stations WHERE station || '駅' || line ILIKE '%s1%' GROUP BY station, line, operator ORDER BY length(label), label, line, operator LIMIT 10")
def search_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by operator too: stations of one name on far-apart lines are not averaged."""
    d = geo.stations(spark, sf_dir).where(f.matches(F.concat("station", F.lit("駅"), "line"), "s1"))
    d = d.groupBy("station", "line", "operator").agg(F.round(F.avg("lon"), 9).alias("lon"), F.round(F.avg("lat"), 9).alias("lat"))
    d = d.select(F.concat("station", F.lit("駅")).alias("label"), "line", "operator", "lon", "lat")
    return f.top(d, 10, F.length("label"), F.col("label"), F.col("line"), F.col("operator"))


@query(f"{WITH} SELECT line, operator, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax, count(*) AS n FROM stations WHERE line ILIKE '%l%' GROUP BY 1, 2 ORDER BY length(line), line, operator LIMIT 40")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.stations(spark, sf_dir).where(f.matches(F.col("line"), "L")).groupBy("line", "operator")
    d = d.agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"), F.count("*").alias("n"))
    return f.top(d, 40, F.length("line"), F.col("line"), F.col("operator"))


_INDEX = """e AS (SELECT unnest(route_names) AS route_name, class, lon AS xmin, lat AS ymin, x2 AS xmax, y2 AS ymax FROM roads),
c AS (SELECT route_name, class, count(*) AS n FROM e GROUP BY 1, 2), m AS (SELECT route_name, class FROM c QUALIFY row_number() OVER (PARTITION BY route_name ORDER BY n DESC, class) = 1),
routes AS (SELECT e.route_name, any_value(m.class) AS class, count(*) AS segments, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM e JOIN m ON e.route_name = m.route_name GROUP BY 1)"""


@query(f"{WITH}, {_INDEX} SELECT route_name, class, segments, round(xmin, 9) AS xmin, round(ymin, 9) AS ymin, round(xmax, 9) AS xmax, round(ymax, 9) AS ymax FROM routes")
def route_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agg.route_index(geo.roads(spark, sf_dir))
    return d.select("route_name", "class", "segments", *[F.round(c, 9).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"{WITH} SELECT id, array_to_string(route_names, '・') AS label FROM roads WHERE list_contains(route_names, 'R7')")
def route_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.roads(spark, sf_dir).where(F.coalesce(F.array_contains("route_names", "R7"), F.lit(False))).select("id", F.array_join("route_names", "・").alias("label"))


@query(f"""{WITH}, {_INDEX}, u AS (
  SELECT 0 AS priority, route_name AS label, route_name AS k FROM routes WHERE lower(route_name) = 'r1'
  UNION ALL SELECT 1, line || ' (' || operator || ')', line || operator FROM (SELECT DISTINCT line, operator FROM stations WHERE line ILIKE '%r1%')
  UNION ALL SELECT 2, station || '駅', station FROM (SELECT DISTINCT station FROM stations WHERE starts_with(lower(station || '駅'), 'r1駅'))
  UNION ALL SELECT 3, city_name, city_name FROM admin WHERE city_name ILIKE '%r1%'
  UNION ALL SELECT 4, town, town FROM (SELECT DISTINCT town FROM (SELECT 'R' || CAST(s_suppkey % 40 AS VARCHAR) || '町' AS town FROM supplier) WHERE town ILIKE '%r1%' ORDER BY length(town), town LIMIT 3)
  UNION ALL SELECT 5, route_name, route_name FROM (SELECT route_name FROM routes WHERE route_name ILIKE '%r1%' AND lower(route_name) <> 'r1' ORDER BY length(route_name), route_name LIMIT 3)
  UNION ALL SELECT 6, station || '駅', station FROM (SELECT DISTINCT station FROM stations WHERE station ILIKE '%r1%'))
SELECT priority, label FROM u ORDER BY priority, length(label), label, k LIMIT 10""")
def search_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of hits from seven kinds, by priority: exact routes, lines, exact stations, places, three towns, three more routes, stations."""
    kw = "R1"
    routes, stations = agg.route_index(geo.roads(spark, sf_dir)).select("route_name"), geo.stations(spark, sf_dir)
    as_hits = lambda d, p, label: d.distinct().select(F.lit(p).alias("priority"), label.alias("label"))
    exact = F.lower("route_name") == kw.lower()
    label = F.concat("station", F.lit("駅"))
    towns = geo.table(spark, sf_dir, "supplier").select(F.concat(F.lit("R"), (F.col("s_suppkey") % 40).cast("string"), F.lit("町")).alias("town")).distinct()
    parts = [
        as_hits(routes.where(exact), 0, F.col("route_name")),
        as_hits(stations.where(f.matches(F.col("line"), kw)).select("line", "operator"), 1, F.concat("line", F.lit(" ("), "operator", F.lit(")"))),
        as_hits(stations.where(F.lower(label).startswith(kw.lower() + "駅")).select("station"), 2, label),
        as_hits(geo.admin(spark, sf_dir).where(f.matches(F.col("city_name"), kw)).select("city_name"), 3, F.col("city_name")),
        as_hits(f.top(towns.where(f.matches(F.col("town"), kw)), 3, F.length("town"), F.col("town")), 4, F.col("town")),
        as_hits(f.top(routes.where(f.matches(F.col("route_name"), kw) & ~exact), 3, F.length("route_name"), F.col("route_name")), 5, F.col("route_name")),
        as_hits(stations.where(f.matches(F.col("station"), kw)).select("station"), 6, label),
    ]
    return f.top(reduce(DataFrame.unionByName, parts), 10, F.col("priority"), F.length("label"), F.col("label"))


@query("SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.vocabulary(geo.table(spark, sf_dir, "part"), "p_type")


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 HAVING (SELECT count(DISTINCT p_name) FROM part) <= 8")
def vocabulary_too_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.vocabulary(geo.table(spark, sf_dir, "part"), "p_name", 8)


_FILES = "v AS (SELECT s_nationkey % 3 AS file, s_nationkey AS rank, 'v' || CAST(s_nationkey % 10 AS VARCHAR) AS value FROM (SELECT DISTINCT s_nationkey FROM supplier))"


@query(f"WITH {_FILES}, a AS (SELECT value, min(file * 1000 + rank) AS seen FROM v GROUP BY 1) SELECT value, row_number() OVER (ORDER BY seen) AS place FROM a")
def merge_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    d = d.select((F.col("s_nationkey") % 3).alias("file"), F.col("s_nationkey").alias("rank"), F.concat(F.lit("v"), (F.col("s_nationkey") % 10).cast("string")).alias("value"))
    return agg.merge_vocabularies(d)


@query("""SELECT p_partkey, p_name || ['市', '町', '村', '区', '郡'][CAST(p_size % 5 AS INT) + 1] AS name FROM part WHERE p_size % 3 > 0 AND p_size % 5 < 4""")
def municipality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*map(F.lit, "市町村区郡")), (F.col("p_size") % 5).cast("int"))
    d = geo.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", suffix).alias("name"), F.when(F.col("p_size") % 3 > 0, "locality").otherwise("county").alias("subtype"))
    return d.where(f.is_municipality(F.col("subtype"), F.col("name"))).select("p_partkey", "name")


@query("""SELECT doc_id, length(text) AS n FROM documents WHERE text ILIKE '%the and%' AND text ILIKE '%license%'""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = f.matches(F.col("text"), "license") & F.col("text").ilike("%the and%")
    return geo.table(spark, sf_dir, "documents").where(hit).select("doc_id", F.length("text").cast("long").alias("n"))
