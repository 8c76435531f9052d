"""Queries on what the readers do to values: sentinels, code tables, lists, levels, pixels, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.functions import values as v
from geolake.operators import aggregates as agg

from . import geography as geo
from .registry import registry

QUERIES, ORACLES, query = registry()
WITH = f"WITH {geo.SQL}"


@query("SELECT p_partkey, CASE WHEN p_size = 13 THEN NULL ELSE p_size END AS storeys, nullif(trim(CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_name END), '') AS name FROM part")
def sentinel_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 7 == 0, F.lit(" ")).otherwise(F.col("p_name"))
    return geo.table(spark, sf_dir, "part").select("p_partkey", v.sentinel(F.col("p_size"), 13).alias("storeys"), F.nullif(F.trim(name), F.lit("")).alias("name"))


@query("""WITH r AS (SELECT o_orderkey, [{'name': 'N' || CAST(o_orderkey % 9 AS VARCHAR), 'network': CASE WHEN o_orderkey % 2 = 0 THEN 'JP:a' ELSE 'US:b' END}, {'name': CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'M' END, 'network': 'JP:c'}] AS routes FROM orders),
k AS (SELECT o_orderkey, list_filter(routes, lambda x: x.name IS NOT NULL AND starts_with(x.network, 'JP')) AS kept FROM r)
SELECT o_orderkey, array_to_string(list_transform(kept, lambda x: x.name), ',') AS names, array_to_string(list_transform(kept, lambda x: x.network), ',') AS networks FROM k""")
def lod_aligned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and networks of routes: filtered once, then projected, so the lists stay aligned."""
    k = F.col("o_orderkey")
    one = F.struct(F.concat(F.lit("N"), (k % 9).cast("string")).alias("name"), F.when(k % 2 == 0, "JP:a").otherwise("US:b").alias("network"))
    two = F.struct(F.when(k % 3 != 0, "M").alias("name"), F.lit("JP:c").alias("network"))
    d = geo.table(spark, sf_dir, "orders").withColumn("routes", F.array(one, two))
    names, networks = v.aligned("routes", lambda x: x["name"].isNotNull() & x["network"].startswith("JP"), "name", "network")
    return d.select("o_orderkey", F.array_join(names, ",").alias("names"), F.array_join(networks, ",").alias("networks"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x = 8388608 THEN 0 WHEN x < 8388608 THEN round(x / CAST(100 AS DOUBLE), 2) ELSE round((x - 16777216) / CAST(100 AS DOUBLE), 2) END AS metres
FROM (SELECT *, (l_orderkey * 104729 + l_linenumber * 8388608) % 16777216 AS x FROM lineitem)""")
def dem_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights from three colour bytes."""
    x = (F.col("l_orderkey") * 104729 + F.col("l_linenumber").cast("long") * 8388608) % 16777216
    d = geo.table(spark, sf_dir, "lineitem").withColumn("x", x)
    r, g_, b = F.shiftright("x", 16), F.shiftright("x", 8).bitwiseAND(F.lit(255)), F.col("x").bitwiseAND(F.lit(255))
    return d.select("l_orderkey", "l_linenumber", F.round(v.dem_height(r, g_, b), 2).alias("metres"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(s, ','), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x IS NOT NULL))), ',') AS lods
FROM (SELECT p_partkey, CAST(p_size % 4 AS VARCHAR) || ',x,' || CAST(p_size % 3 AS VARCHAR) AS s FROM part)""")
def source_lods(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat((F.col("p_size") % 4).cast("string"), F.lit(",x,"), (F.col("p_size") % 3).cast("string"))
    return geo.table(spark, sf_dir, "part").select("p_partkey", v.format_lods(v.parse_lods(s)).alias("lods"))


@query("SELECT n_nationkey, regexp_extract('tblT001231E' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.zip', 'E([0-9]{2})[.]zip$', 1) AS pref_code FROM nation")
def pref_code_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("tblT001231E"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(".zip"))
    return geo.table(spark, sf_dir, "nation").select("n_nationkey", v.pref_code(file).alias("pref_code"))


@query("""SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'JRの新幹線' WHEN 1 THEN 'JR在来線' WHEN 2 THEN '公営鉄道' WHEN 3 THEN '民営鉄道' ELSE '第三セクター' END AS operator_type FROM supplier""")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("s_nationkey") % 5 + 1).cast("string")
    return geo.table(spark, sf_dir, "supplier").select("s_suppkey", v.name_of(code, v.OPERATOR_TYPES).alias("operator_type"))


@query(f"""{WITH}, o AS (SELECT city, count(*) AS size FROM buildings GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY size, city) - 1 AS i, count(*) OVER () AS total FROM o)
SELECT city, size FROM p WHERE i IN (SELECT CAST(floor(k * CAST(total - 1 AS DOUBLE) / 4 + 0.5) AS BIGINT) FROM range(0, 5) t(k), (SELECT any_value(total) AS total FROM p))""")
def survey_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = geo.buildings(spark, sf_dir).groupBy("city").agg(F.count("*").alias("size"))
    return agg.spaced_sample(cities, 5, "size", "city")


@query("SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1")
def dedupe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("""WITH t AS (SELECT 'layer_' || CAST(n_nationkey AS VARCHAR) AS layer, 'theme_' || CAST(n_regionkey AS VARCHAR) AS theme FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'layer_3', 'theme_9' UNION ALL SELECT 'layer_99', 'theme_0'),
l AS (SELECT 'layer_' || CAST(n_nationkey AS VARCHAR) AS layer FROM nation), c AS (SELECT layer, count(*) AS n FROM t GROUP BY 1)
SELECT coalesce(l.layer, c.layer) AS layer, CASE WHEN c.layer IS NULL THEN 'missing' WHEN l.layer IS NULL THEN 'unknown' ELSE 'duplicate' END AS problem FROM l FULL JOIN c ON l.layer = c.layer WHERE c.layer IS NULL OR l.layer IS NULL OR c.n > 1""")
def theme_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that are not in exactly one theme."""
    n = geo.table(spark, sf_dir, "nation")
    layer = F.concat(F.lit("layer_"), F.col("n_nationkey").cast("string"))
    themes = n.where("n_nationkey <> 7").select(layer.alias("layer"), F.concat(F.lit("theme_"), F.col("n_regionkey").cast("string")).alias("theme"))
    more = spark.createDataFrame([("layer_3", "theme_9"), ("layer_99", "theme_0")], "layer string, theme string")
    return v.theme_problems(n.select(layer.alias("layer")), themes.unionByName(more))
