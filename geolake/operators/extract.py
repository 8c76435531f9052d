"""Extracts of worldwide map data (themes partitioned by type): what lies in a country, under the lakehouse's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolake.functions import values
from geolake.functions.geometry import anchored_in
from geolake.functions.kernels import geo_type
from geolake.sources.shared import stored

from .filters import is_municipality
from .pieces import meeting
from .spatial_join import semi_overlap

# Classes that are taken over, and the country's frame.
ROAD_CLASSES, POWER_CLASSES, WATER_CLASSES = ("motorway", "trunk", "primary"), ("power_line", "cable"), ("river", "canal")
FRAME = (122.0, 20.0, 154.0, 46.0)


def buildings(source: DataFrame, frame: tuple = FRAME) -> DataFrame:
    """Buildings anchored in the frame: a range on both corners' minimum prunes row groups from both sides."""
    return source.where(anchored_in("bbox", *frame)).select("id", F.col("names.primary").alias("name"), "class", "subtype", "height", "num_floors", "geometry", "bbox")


def municipalities(divisions: DataFrame) -> DataFrame:
    return divisions.where(is_municipality(F.col("subtype"), F.col("names.primary")))


def admin(divisions: DataFrame) -> DataFrame:
    """Municipalities with the names of their regions; those of an unknown region stay, without a name."""
    regions = divisions.where("subtype = 'region'").select("region", F.col("names.primary").alias("pref_name"))
    own = municipalities(divisions).select("id", "region", F.col("names.primary").alias("city_name"), "geometry", "bbox")
    return own.join(regions, "region", "left").select(F.col("id").alias("admin_id"), "pref_name", F.lit(None).cast("string").alias("county_name"), "city_name", F.lit(None).cast("string").alias("ward_name"), "geometry", "bbox")


def in_country(source: DataFrame, home: DataFrame) -> DataFrame:
    """Rows whose geometry shares a point with an area of home (home with boxes alone: whose boxes do). Areas may be concave, with holes, of several parts."""
    if "geometry" not in home.columns:
        return semi_overlap(source, home, "id", "bbox", "bbox")
    return source.join(meeting(source, home), "id", "left_semi")


def roads(source: DataFrame, home: DataFrame, frame: tuple = FRAME) -> DataFrame:
    """Roads of the classes that lie in the country or belong to one of its networks.

    home: the country's areas, see in_country. The two conditions are taken apart, so that the spatial one is an equi-join on cells of
    what the first leaves over. What classes and frame leave of the source is stored, as areas' borders are asked in several passes.
    """
    d = source.where(anchored_in("bbox", *frame) & F.col("class").isin(*ROAD_CLASSES)).withColumn("routes", F.coalesce("routes", F.array()))
    if "geometry" in home.columns:
        d = stored(d.select("id", "names", "class", "routes", "geometry", "bbox"), "roads")
    domestic = F.exists("routes", lambda r: F.coalesce(r["network"].startswith("JP"), F.lit(False)))
    found = d.where(domestic).unionByName(in_country(d.where(~domestic), home))
    names, _ = values.aligned("routes", lambda r: r["name"].isNotNull() & F.coalesce(r["network"].startswith("JP"), F.lit(False)), "name", "network")
    return found.select("id", F.col("names.primary").alias("road_name"), "class", F.array_distinct(names).alias("route_names"), "geometry", "bbox")


def lines(source: DataFrame, home: DataFrame, classes: tuple[str, ...], frame: tuple = FRAME) -> DataFrame:
    """Power lines or waterways in the country: classes, and lines only (by the type word of the WKB, of either byte order)."""
    d = source.where(anchored_in("bbox", *frame) & F.col("class").isin(*classes) & (geo_type("geometry") == "LineString"))
    return in_country(d, home).select(F.col("names.primary").alias("name"), "class", "geometry", "bbox")
