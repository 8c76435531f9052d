"""Grid functions as native expressions: the hierarchical mesh (a prefix is the parent), quadkeys and zoom policies."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# earth's radius for cell areas; Web Mercator's latitude limit; digits of mesh levels with their cell sizes in
# parts of a degree (latitude, longitude).
EARTH_RADIUS_M = 6_371_008.8
MAX_LATITUDE = 85.05112878
MESH_PARTS = {4: (1.5, 1), 6: (12, 8), 8: (120, 80), 9: (240, 160), 10: (480, 320), 11: (960, 640)}


def mesh_code(lon: Column, lat: Column, digits: int = 8) -> Column:
    """The mesh cell of a point. Cells are counted in whole units of the level and the code is put together as one number."""
    ny, nx = MESH_PARTS[digits]
    y, x = F.floor(lat * ny), F.floor((lon - 100) * nx)
    part = lambda v, by: F.floor(v / by)
    if digits == 4:
        number = y * 100 + x
    elif digits == 6:
        number = part(y, 8) * 10_000 + part(x, 8) * 100 + y % 8 * 10 + x % 8
    else:
        half = digits - 8
        y8, x8 = (part(y, 2**half), part(x, 2**half)) if half else (y, x)
        number = part(y8, 80) * 1_000_000 + part(x8, 80) * 10_000 + part(y8, 10) % 8 * 1000 + part(x8, 10) % 8 * 100 + y8 % 10 * 10 + x8 % 10
        for k in range(half - 1, -1, -1):  # 1 south-west, 2 south-east, 3 north-west, 4 north-east
            number = number * 10 + part(y, 2**k) % 2 * 2 + part(x, 2**k) % 2 + 1
    return F.lpad(number.cast("string"), digits, "0")


def mesh_is_valid(code: Column) -> Column:
    return F.coalesce(code.rlike("^[0-9]{4}([0-7]{2}([0-9]{2}[1-4]{0,3})?)?$"), F.lit(False))


def mesh_bounds(code: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax); a malformed code is an error."""
    v = F.rpad(code, 11, "0").cast("double")  # missing digits count as 0, like a south-west cell
    d = lambda k, base=10: F.floor(v / 10**k) % base
    n = F.length(code)
    # south-west corner in the finest units, eighths of an 8-digit cell
    y, x = d(9, 100) * 640 + d(6) * 80 + d(4) * 8, d(7, 100) * 640 + d(5) * 80 + d(3) * 8
    for k, unit in ((2, 4), (1, 2), (0, 1)):
        y, x = y + F.floor(d(k) / 3) * unit, x + F.when(d(k) > 0, (d(k) + 1) % 2).otherwise(0) * unit
    size = F.when(n == 4, 640).when(n == 6, 80).when(n == 8, 8).when(n == 9, 4).when(n == 10, 2).otherwise(1)
    box = F.struct((x / 640 + 100).alias("xmin"), (y / 960).alias("ymin"), ((x + size) / 640 + 100).alias("xmax"), ((y + size) / 960).alias("ymax"))
    return F.when(mesh_is_valid(code), box).otherwise(F.raise_error(F.concat(F.lit("bad mesh code: "), F.coalesce(code, F.lit("null")))).cast(_BOX))


_BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def mesh_area_km2(code: Column) -> Column:
    """Area of a cell from its code alone: only the latitude and the level matter."""
    d = lambda i, n=1: F.coalesce(F.nullif(F.substring(code, i, n), F.lit("")).cast("double"), F.lit(0.0))
    n, r = F.length(code), EARTH_RADIUS_M / 1000
    y = d(1, 2) * 640 + d(5) * 80 + d(7) * 8 + F.floor(d(9) / 3) * 4 + F.floor(d(10) / 3) * 2 + F.floor(d(11) / 3)
    size = F.when(n == 4, 640.0).when(n == 6, 80.0).when(n == 8, 8.0).when(n == 9, 4.0).when(n == 10, 2.0).otherwise(1.0)
    # sin(a + h) - sin(a) = 2 cos(a + h / 2) sin(h / 2)
    half = F.radians(size / 1920)
    return F.radians(size / 640) * 2 * F.cos(F.radians(y / 960) + half) * F.sin(half) * (r * r)


def mesh_parent(code: Column, digits: int) -> Column:
    return F.substring(code, 1, digits)


def mesh_cover(west: Column, south: Column, east: Column, north: Column, most: int = 60, coarse: int = 15) -> Column:
    """The 8-digit cells that touch a view, in ascending order; beyond `most` of them the 6-digit ones; beyond `coarse` of these null."""

    def cells(digits: int) -> tuple[Column, Column]:
        ny, nx = MESH_PARTS[digits]
        rows = F.sequence(F.floor(south * ny), F.floor(north * ny))
        columns = F.sequence(F.floor((west - 100) * nx), F.floor((east - 100) * nx))
        centre = lambda y: F.transform(columns, lambda x: mesh_code((x + 0.5) / nx + 100, (y + 0.5) / ny, digits))
        return F.size(rows).cast("long") * F.size(columns), F.sort_array(F.flatten(F.transform(rows, centre)))

    (n, fine), (m, rough) = cells(8), cells(6)
    return F.when(n <= most, fine).when(m <= coarse, rough)


def mesh_capacity(digits: int) -> int:
    """8-digit cells in a cell of so many digits."""
    if digits >= 8:
        return 1
    if digits in (4, 6):
        return {6: 100, 4: 6400}[digits]
    raise ValueError(f"no capacity for {digits} digits")


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    at = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return F.least(F.greatest(F.floor((1.0 - F.ln(F.tan(at) + 1.0 / F.cos(at)) / math.pi) / 2.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def quadkey_of_tile(x: Column, y: Column, zoom: int) -> Column:
    if zoom == 0:
        return F.lit("")
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(x, k) + bit(y, k) * 2).cast("string") for k in range(zoom - 1, -1, -1)])


def quadkey(lon: Column, lat: Column, zoom: int) -> Column:
    return quadkey_of_tile(tile_x(lon, zoom), tile_y(lat, zoom), zoom)


def quadkey_bounds(key: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax); a character other than 0 to 3 is an error."""
    step = lambda bit: F.aggregate(F.split(key, ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 2 + F.shiftright(c.cast("int"), bit).bitwiseAND(F.lit(1))))
    x, y, n = step(0).cast("double"), step(1).cast("double"), F.pow(F.lit(2.0), F.length(key))
    lon = lambda v: v / n * 360.0 - 180.0
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - v * 2.0 / n))))
    box = F.struct(lon(x).alias("xmin"), lat(y + 1).alias("ymin"), lon(x + 1).alias("xmax"), lat(y).alias("ymax"))
    return F.when(key.rlike("^[0-3]*$"), box).otherwise(F.raise_error(F.lit("bad quadkey")).cast(_BOX))


def mesh_digits(zoom: float) -> int:
    """Digits of the mesh to show at a zoom."""
    return next((d for least, d in ((15, 11), (14, 10), (12, 9), (9, 8), (6, 6)) if zoom >= least), 4)


def metres_per_pixel(zoom: float) -> float:
    return 126_643 / 2**zoom


def coarse_until(tolerance_m: float, pixels: float = 2) -> int:
    """The last whole zoom at which rows simplified to a tolerance look exact, 24 at most."""
    return max((z for z in range(25) if tolerance_m / metres_per_pixel(z) <= pixels), default=0)


def level_for_zoom(tolerance_m: float | None, zoom: float) -> int | None:
    """0 for the coarse level, 1 for the exact one, None for a table without levels."""
    return None if tolerance_m is None else int(zoom > coarse_until(tolerance_m))


def tier_depth(zoom: float, min_zoom: float, tiers: int) -> int:
    """Rank of the last tier to show: one tier less for each zoom step below min_zoom."""
    return tiers - 1 - max(0, math.ceil(min_zoom - zoom))


# The zoom from which roads of a class are shown; other classes at any.
ROAD_MIN_ZOOM = {"motorway": 0, "trunk": 8, "primary": 10}


def road_classes(classes: list[str], zoom: float, shift: float = 0) -> list[str]:
    """The chosen classes that are shown at a zoom; a detail setting shifts their zooms down, not below 0."""
    return [c for c in classes if zoom >= max(0, ROAD_MIN_ZOOM.get(c, 0) - shift)]


# Limits of density (people per km2, exclusive) and the ground-risk class by aircraft class; None: out of scope.
IGRC_LIMITS = (5, 50, 500, 5000, 50000, math.inf)
IGRC_CLASSES = ((2, 3, 4, 5, 6), (3, 4, 5, 6, 7), (4, 5, 6, 7, 8), (5, 6, 7, 8, 9), (6, 7, 8, 9, 10), (7, 8, None, None, None))


def igrc(density: Column, aircraft: int) -> Column:
    """Ground-risk class of a density for an aircraft class 0 to 4; null density gives null."""
    out = F.lit(None).cast("int")
    for limit, row in reversed(list(zip(IGRC_LIMITS, IGRC_CLASSES, strict=True))):
        value = F.lit(row[aircraft]).cast("int")
        out = value if math.isinf(limit) else F.when(density < limit, value).otherwise(out)
    return F.when(density.isNotNull(), out)
