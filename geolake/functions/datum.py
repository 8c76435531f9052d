"""Datum shifts by a grid of differences, as native expressions over a join with the grid's cells.

A grid has a fixed extent, so its cells have a bounded number that is checked before they are broadcast. Between corners
differences are interpolated bilinearly; the way back is found by iteration, which converges as differences change slowly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that a broadcast grid has at most (six numbers each), and rounds of the way back: differences of seconds that change by
#: a thousandth from corner to corner are met to 1e-12 degrees by four.
MOST_CELLS, ROUNDS = 4_000_000, 4


def grid_cells(corners: DataFrame) -> DataFrame:
    """(i, j, and the differences at the cell's four corners) from corners (i, j, dlon, dlat); a cell needs all four."""
    c = corners.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "dlon", "dlat")
    spread = [F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(2 * b + a).alias("k")) for a in (0, 1) for b in (0, 1)]
    at = c.withColumn("s", F.explode(F.array(*spread))).select("s.i", "s.j", "s.k", "dlon", "dlat")
    pick = lambda v, k: F.max(F.when(F.col("k") == k, F.col(v))).alias(f"{v}{k}")
    cells = at.groupBy("i", "j").agg(F.count("*").alias("n"), *(pick(v, k) for v in ("dlon", "dlat") for k in range(4)))
    return cells.where("n = 4").drop("n")


def _looked_up(points: DataFrame, cells: DataFrame, lon: Column, lat: Column, step_lon: float, step_lat: float) -> DataFrame:
    """points with __dlon, __dlat at (lon, lat): null outside of the grid."""
    p = points.withColumn("__u", lon / step_lon).withColumn("__v", lat / step_lat)
    p = p.withColumn("__i", F.floor("__u").cast("long")).withColumn("__j", F.floor("__v").cast("long"))
    g = cells.select(F.col("i").alias("__i"), F.col("j").alias("__j"), *(F.col(f"{v}{k}").alias(f"__{v}{k}") for v in ("dlon", "dlat") for k in range(4)))
    p = p.join(F.broadcast(g), ["__i", "__j"], "left")
    u, v = F.col("__u") - F.col("__i"), F.col("__v") - F.col("__j")

    def between(name: str) -> Column:
        low = F.col(f"__{name}0") + (F.col(f"__{name}1") - F.col(f"__{name}0")) * u
        high = F.col(f"__{name}2") + (F.col(f"__{name}3") - F.col(f"__{name}2")) * u
        return low + (high - low) * v

    p = p.withColumn("__x", between("dlon")).withColumn("__y", between("dlat"))
    return p.select(*points.columns, F.col("__x").alias("__dlon"), F.col("__y").alias("__dlat"))


def shift(points: DataFrame, cells: DataFrame, lon: str, lat: str, step_lon: float, step_lat: float, back: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """points with lon and lat moved by the grid's differences, or moved back; points outside of the grid become null.

    cells: as from grid_cells, with corners at whole multiples of the steps; more than MOST_CELLS of them are an error.
    """
    n = cells.limit(MOST_CELLS + 1).count()
    if n > MOST_CELLS:
        raise ValueError(f"a shift grid of over {MOST_CELLS} cells")
    if not back:
        d = _looked_up(points, cells, F.col(lon), F.col(lat), step_lon, step_lat)
        return d.withColumn(lon, F.col(lon) + F.col("__dlon")).withColumn(lat, F.col(lat) + F.col("__dlat")).drop("__dlon", "__dlat")
    d = points.withColumn("__lon", F.col(lon)).withColumn("__lat", F.col(lat))
    for _ in range(rounds):  # what is moved to the given place lies where the place less the difference there is
        d = _looked_up(d, cells, F.col("__lon"), F.col("__lat"), step_lon, step_lat)
        d = d.withColumn("__lon", F.col(lon) - F.col("__dlon")).withColumn("__lat", F.col(lat) - F.col("__dlat")).drop("__dlon", "__dlat")
    return d.withColumn(lon, F.col("__lon")).withColumn(lat, F.col("__lat")).drop("__lon", "__lat")
