"""Roll-ups, coverage, tiles, indexes and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolake.functions import grid
from geolake.functions.geometry import box_distance


def mesh_rollup(cells: DataFrame, digits: int, code: str = "mesh_code") -> DataFrame:
    """mesh_code, population, density by parent cell: populations add up, densities take the maximum; rows without a density are out."""
    d = cells.where("density is not null").groupBy(grid.mesh_parent(F.col(code), digits).alias("mesh_code"))
    return d.agg(F.sum("population").alias("population"), F.max("density").alias("density"))


def accumulate(tables: list[DataFrame], digits: int = 8) -> DataFrame:
    """Cells of several tables on one level: sums are null only where all are, codes shorter than `digits` are left out."""
    d = reduce(DataFrame.unionByName, tables).where(F.length("mesh_code") >= digits)
    return d.groupBy(grid.mesh_parent(F.col("mesh_code"), digits).alias("mesh_code")).agg(F.sum("population").alias("population"), F.sum("households").alias("households"), F.max("density").alias("density"))


def check_totals(tables: list[DataFrame], merged: DataFrame, column: str = "population") -> DataFrame:
    """merged as it is; an error when its rows are read if its total isn't that of the tables."""
    want = reduce(DataFrame.unionByName, [t.select(F.col(column).alias("v")) for t in tables]).agg(F.coalesce(F.sum("v"), F.lit(0)))
    got = merged.agg(F.coalesce(F.sum(column), F.lit(0)))
    return merged.where(F.when(want.scalar() == got.scalar(), True).otherwise(F.raise_error(F.lit(f"totals of {column} differ")).cast("boolean")))


def nearby_cells(levels: dict[int, DataFrame], x: Column, y: Column, radius: float) -> DataFrame:
    """digits, population, cells: whole cells (box as struct b in planar units, population) that a radius touches, of the finest level that
    has any; one row, with 0 and null digits if none has."""
    d = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("digits"), "b", "population") for n, t in levels.items()])
    d = d.where(box_distance(x, y, *(F.col(f"b.{c}") for c in ("xmin", "ymin", "xmax", "ymax"))) <= radius)
    per = d.groupBy("digits").agg(F.coalesce(F.sum("population"), F.lit(0)).alias("population"), F.count("*").alias("cells"))
    best = per.agg(F.max(F.struct("digits", "population", "cells")).alias("m"))
    return best.select("m.digits", F.coalesce("m.population", F.lit(0)).alias("population"), F.coalesce("m.cells", F.lit(0)).alias("cells"))


def coverage(points: DataFrame, lon: Column, lat: Column, city: Column) -> DataFrame:
    """mesh_code, buildings, cities: counts in 8-digit cells and the sorted distinct cities without nulls."""
    d = points.select(grid.mesh_code(lon, lat, 8).alias("mesh_code"), city.alias("city"))
    return d.groupBy("mesh_code").agg(F.count("*").alias("buildings"), F.array_sort(F.collect_set("city")).alias("cities"))


def coverage_rollup(cover: DataFrame, digits: int) -> DataFrame:
    """mesh_code, buildings, filled, ratio, cities by parent cell; ratio: filled 8-digit cells of all there are."""
    d = cover.groupBy(grid.mesh_parent(F.col("mesh_code"), digits).alias("mesh_code"))
    d = d.agg(F.sum("buildings").alias("buildings"), F.count("*").alias("filled"), F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list("cities"))))).alias("cities"))
    return d.withColumn("ratio", F.col("filled") / F.lit(float(grid.mesh_capacity(digits))))


def choose_tiles(keys: DataFrame, least: int, most: int, rows: int, key: str = "key", n: str = "n") -> DataFrame:
    """Tiles (quadkey, rows): a prefix-free cover in which a tile with more than `rows` rows is split, down to `most` digits.

    In closed form: a node is a tile if it has `least` digits or its parent holds too many rows, and it holds few enough itself or
    has `most` digits. keys: counts by keys of `most` digits.
    """
    d = keys.select(F.explode(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda i: F.substring(F.col(key), F.lit(1), i))).alias("quadkey"), F.col(n).alias("n"))
    nodes = d.groupBy("quadkey").agg(F.sum("n").alias("rows"))
    parents = nodes.select(F.col("quadkey").alias("parent"), F.col("rows").alias("above"))
    d = nodes.withColumn("parent", F.expr(f"CASE WHEN length(quadkey) > {least} THEN substring(quadkey, 1, length(quadkey) - 1) END")).join(parents, "parent", "left")
    small, last = F.col("rows") <= rows, F.length("quadkey") == most
    return d.where((F.col("above").isNull() | (F.col("above") > rows)) & (small | last)).select("quadkey", "rows")


def tile_of_keys(counts: DataFrame, tiles: DataFrame, least: int, most: int, key: str = "key") -> DataFrame:
    """The tile (column quadkey) of each distinct fine key: prefixes are joined, and as tiles are prefix-free one of them matches at most.

    Rows are then joined with this map on their key once; they are never multiplied by prefixes.
    """
    d = counts.withColumn("quadkey", F.explode(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda i: F.substring(F.col(key), F.lit(1), i))))
    return d.join(tiles.select("quadkey"), "quadkey")


def places(df: DataFrame, by: str, key: str, bucket: Column) -> DataFrame:
    """df with `place`, its rows' numbers from 0 in the order of (by, key).

    bucket: a value that ascends with `by` and has a bounded number of values, such as a coarse grid line: rows are numbered inside
    their bucket and moved up by the counts of the buckets before, so no task holds the table.
    """
    d = df.withColumn("__bucket", bucket)
    before = d.groupBy("__bucket").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(by, key)) - 1
    return d.withColumn("__own", own).join(before, "__bucket").withColumn("place", F.col("__before") + F.col("__own")).drop("__bucket", "__n", "__before", "__own")


def boundary(rings: DataFrame, key: str, ring: str, digits: int = 9) -> DataFrame:
    """key, ax, ay, bx, by: the directed edges around the union of counter-clockwise rings that share whole edges.

    Coordinates snap to so many digits. An edge that is there in both directions lies inside; no list of a key's rings is gathered.
    """
    xy = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
    edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(xy(F.get(ring, i)).alias("a"), xy(F.get(ring, i + 1)).alias("b")))
    d = rings.select(key, F.explode(edges).alias("e")).withColumn("low", F.least("e.a", "e.b")).withColumn("high", F.greatest("e.a", "e.b"))
    d = d.groupBy(key, "low", "high").agg(F.sum(F.when(F.col("e.a") == F.col("low"), 1).otherwise(-1)).alias("way")).where("way <> 0")
    a, b = (F.when(F.col("way") > 0, F.col(x)).otherwise(F.col(y)) for x, y in (("low", "high"), ("high", "low")))
    return d.select(key, a.alias("a"), b.alias("b")).select(key, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def route_index(roads: DataFrame) -> DataFrame:
    """route_name, class (the most frequent, the least among equals), segments and extent of every route."""
    d = roads.select(F.explode("route_names").alias("route_name"), "class", "bbox")
    return d.groupBy("route_name").agg(
        F.mode("class", deterministic=True).alias("class"), F.count("*").alias("segments"),
        F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"), F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax"),
    )


def vocabulary(df: DataFrame, column: str, most: int = 256) -> DataFrame:
    """value, n of a column, nulls left out; no rows at all if it has more than `most` values. Order by n desc, value."""
    d = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return d.where(d.agg(F.count("*")).scalar() <= most)


def merge_vocabularies(values: DataFrame) -> DataFrame:
    """value, place over files (file, rank, value): the first file's order, then what the next ones add. Vocabularies are small: 256 values a file."""
    first = values.groupBy("value").agg(F.min(F.struct("file", "rank")).alias("seen"))
    return first.select("value", F.row_number().over(Window.orderBy("seen")).alias("place"))


def extent(df: DataFrame, b: str = "bbox") -> DataFrame:
    """Number of rows and union of the boxes: one row, nulls for an empty table."""
    return df.agg(F.count("*").alias("n"), F.min(f"{b}.xmin").alias("xmin"), F.min(f"{b}.ymin").alias("ymin"), F.max(f"{b}.xmax").alias("xmax"), F.max(f"{b}.ymax").alias("ymax"))


def spaced_sample(df: DataFrame, n: int, size: str, key: str) -> DataFrame:
    """n rows evenly spaced in the order of size: the survey's choice of cities from small to large.

    Meant for catalogues of cities, which fit one task.
    """
    ranked = df.withColumn("__place", F.row_number().over(Window.orderBy(size, key)) - 1).withColumn("__total", F.count("*").over(Window.partitionBy()))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("__total") - 1).cast("double") / max(1, n - 1) + 0.5))
    return ranked.where(F.array_contains(picks, F.col("__place").cast("bigint"))).drop("__place", "__total")
