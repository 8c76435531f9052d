"""Readers of source formats: address CSV in zips, census tables with two header rows, GeoJSON, CityGML."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.functions import arrange, wkb
from geolake.functions.kernels import signed_area
from geolake.operators.overlay import trace

from .archives import PART_BYTES, geojson_features, zip_entries
from .shared import stored

# Reference systems by their names in the sources; columns of town-level address points with their names here.
CRS = {"JGD2000 / (B, L)": 4612, "JGD2011 / (B, L)": 6668}
TOWN_COLUMNS = {
    "都道府県コード": "pref_code", "都道府県名": "pref_name", "市区町村コード": "city_code", "市区町村名": "city_name", "大字町丁目コード": "oaza_code",
    "大字町丁目名": "oaza_name", "緯度": "lat", "経度": "lon", "原典資料コード": "origin_code", "大字・字・丁目区分コード": "classification_code",
}


#: Columns of block-level address points.
BLOCK_COLUMNS = {
    "都道府県名": "pref_name", "市区町村名": "city_name", "大字・丁目名": "oaza_name", "小字・通称名": "koaza_name", "街区符号・地番": "block_number",
    "緯度": "lat", "経度": "lon", "住居表示フラグ": "residential_display_flag", "代表フラグ": "representative_flag",
}
#: Properties of railway sections; stations have three more.
SECTION_PROPERTIES = {"N02_001": "railway_class_code", "N02_002": "institution_type_code", "N02_003": "line_name", "N02_004": "operator"}
STATION_PROPERTIES = SECTION_PROPERTIES | {"N02_005": "station_name", "N02_005c": "station_code", "N02_005g": "station_group_code"}


def epsg(name: str) -> int:
    """The number of a reference system; JGD2000 and JGD2011 need no shift at the precision kept here, others are an error."""
    if name in CRS:
        return CRS[name]
    tail = name.rsplit(":", 1)[-1]
    if tail in ("4612", "6668", "4326"):
        return int(tail)
    raise ValueError(f"unknown reference system {name}")


def address_points(spark: SparkSession, path: str, columns: dict[str, str] = TOWN_COLUMNS) -> DataFrame:
    """Address points (town level, or BLOCK_COLUMNS) from zips of Shift-JIS CSV files with a header; a malformed row is an error.

    Empty texts stay empty texts. Entries of a zip are read by several tasks.
    """
    names = list(columns.values())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for b in batches:
            for entry, content in zip(b["entry"], b["content"]):
                rows = csv.reader(io.TextIOWrapper(io.BytesIO(content), "cp932", newline=""))
                head = next(rows)
                place = [head.index(c) for c in columns]
                out = []
                for row in rows:
                    if len(row) != len(head):
                        raise ValueError(f"{entry}: a row of {len(row)} values under {len(head)} columns")
                    out.append([row[i] for i in place])
                d = pd.DataFrame(out, columns=names)
                d[["lat", "lon"]] = d[["lat", "lon"]].astype(float)
                yield d

    kinds = ", ".join(f"{n} {'double' if n in ('lat', 'lon') else 'string'}" for n in names)
    d = zip_entries(spark, path, r"(?i).*\.csv$").select("entry", "content").mapInPandas(parse, kinds)
    return d.withColumn("bbox", F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax")))


def census_mesh(spark: SparkSession, path: str, items: dict[str, str]) -> DataFrame:
    """mesh_code and one column for each item, found by its name in the second header row (white space trimmed).

    `*`, `-` and blanks are null, rows without a code are left out. A first cell other than KEY_CODE, an unknown item, a bad code or a
    file without rows is an error. Files are read whole by tasks: they hold one prefecture.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import re

        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                rows = csv.reader(io.StringIO(content.decode("cp932")))
                head, names = next(rows, [""]), [c.strip(" 　") for c in next(rows, [])]
                if head[0] != "KEY_CODE":
                    raise ValueError(f"{file}: the first cell is {head[0]!r}")
                missing = [n for n in items if n not in names]
                if missing:
                    raise ValueError(f"{file}: no {missing}, there are {[n for n in names if n]}")
                place = [names.index(n) for n in items]
                out = []
                for row in rows:
                    if not row or not row[0].strip():
                        continue
                    if not re.fullmatch(r"\d{4}([0-7]{2}(\d{2}[1-4]{0,3})?)?", row[0]):
                        raise ValueError(f"{file}: bad mesh code {row[0]}")
                    values = [row[i].strip() for i in place]
                    out.append([row[0], *[int(v) if v.lstrip("-").isdigit() else None for v in values]])
                if not out:
                    raise ValueError(f"{file}: no rows")
                yield pd.DataFrame(out, columns=["mesh_code", *items.values()], dtype=object)

    kinds = "mesh_code string, " + ", ".join(f"{c} long" for c in items.values())
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, kinds)


def geojson(spark: SparkSession, path: str, columns: dict[str, str], required: set[str], kinds: set[str]) -> DataFrame:
    """Features of FeatureCollections: properties renamed, geometry as WKB with its box.

    A missing required property, another geometry kind, no `crs` or something else than a FeatureCollection is an error.
    """

    names = [*columns.values(), "geometry", "bbox"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for crs in b.column("crs").unique().to_pylist():
                if crs is None:
                    raise ValueError("no crs")
                epsg(crs)
            values, shapes = [[] for _ in columns], []
            for text in b.column("feature").to_pylist():
                feature = json.loads(text)
                props = feature["properties"]
                if any(props.get(k) in (None, "") for k in required):
                    raise ValueError(f"a required property is missing: {props}")
                kind, c = wkb.from_geojson(feature["geometry"])
                if kind not in kinds:
                    raise ValueError(f"unexpected {kind}")
                for v, k in zip(values, columns):
                    v.append(props.get(k))
                shapes.append(wkb.dumps(kind, c))
            geometry = pa.array(shapes, pa.binary())
            box = arrange.boxes(geometry)
            if np.isnan(box).any():
                raise ValueError("a geometry without places")
            bbox = pa.StructArray.from_arrays([pa.array(box[:, k]) for k in range(4)], ["xmin", "ymin", "xmax", "ymax"])
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.string()) for v in values), geometry, bbox], names)

    schema = ", ".join(f"{c} string" for c in columns.values()) + ", geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    return geojson_features(spark, path).select("crs", "feature").mapInArrow(parse, schema)


def railways(spark: SparkSession, path: str, stations: bool = False) -> DataFrame:
    """Railway sections, or stations (their platforms), with the names of their class and operator type; unknown codes are an error."""
    from geolake.functions import values

    columns = STATION_PROPERTIES if stations else SECTION_PROPERTIES
    required = {"N02_001", "N02_002", "N02_003", "N02_004"} | ({"N02_005"} if stations else set())
    d = geojson(spark, path, columns, required, {"LineString"})
    kind = values.name_of(F.col("railway_class_code"), values.RAILWAY_CLASSES)
    return d.withColumn("railway_class", kind).withColumn("institution_type", values.name_of(F.col("institution_type_code"), values.OPERATOR_TYPES))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _faces(top: ET.Element) -> list[list[list[tuple[float, float, float]]]]:
    """The faces below an element, each one its shell and then its holes, as (lon, lat, height); a ring that is in no polygon is a shell."""
    faces: list[list] = []

    def walk(x: ET.Element, hole: bool, face: list | None) -> None:
        name = _local(x.tag)
        if name in ("Polygon", "PolygonPatch", "Triangle", "Rectangle"):
            face = []
            faces.append(face)
        if name == "posList" and x.text:
            v = list(map(float, x.text.split()))
            ring = list(zip(v[1::3], v[0::3], v[2::3]))
            if face is None:
                faces.append([ring])
            elif hole:
                face.append(ring)
            else:
                face.insert(0, ring)
        for c in x:
            walk(c, hole or name == "interior", face)

    walk(top, False, None)
    return [f for f in faces if f]


def building_footprint(element: ET.Element) -> list[list[list[tuple[float, float]]]]:
    """Polygons (lon, lat; shells counter-clockwise, holes clockwise) of a building's LOD0 outline, or else of its lowest horizontal
    LOD1 faces, which are one outline where they share edges."""
    flat = [f for x in element.iter() if _local(x.tag) in ("lod0RoofEdge", "lod0FootPrint") for f in _faces(x)]
    base = not flat
    if base:
        level = lambda ring: max(p[2] for p in ring) - min(p[2] for p in ring) <= 0.01
        faces = [f for x in element.iter() if _local(x.tag) == "lod1Solid" for f in _faces(x) if level(f[0])]
        ground = min((p[2] for f in faces for p in f[0]), default=0.0)
        flat = [f for f in faces if min(p[2] for p in f[0]) - ground <= 0.01]
    out = []
    for f in flat:
        rings = [[(x, y) for x, y, _ in r] for r in f]
        out.append([r if (signed_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)])
    if not base or len(out) < 2:
        return out
    # an edge of two faces runs both ways and bounds nothing
    edges = [(*p, *q) for f in out for r in f for p, q in zip(r, r[1:]) if p != q]
    once = set(edges)
    kind, c, _ = trace(np.array([e for e in edges if (e[2], e[3], e[0], e[1]) not in once], float).reshape(-1, 4))
    return [c] if kind == "Polygon" else c


# Elements of the finer levels and of appearances, which are not read.
_UNREAD = re.compile(rb"<(/?)(?:\w+:)?(appearanceMember|boundedBy|lod[234]\w+)\b[^>]*?(/?)>")


def without_unread(data: bytes) -> bytes:
    """The document without the elements that aren't read here, in one pass over their tags; elements may hold others of their own name."""
    out, at, inside = [], 0, []
    for m in _UNREAD.finditer(data):
        closes, name, empty = m[1], m[2], m[3]
        if closes:
            if name in inside:
                while inside.pop() != name:
                    pass
                if not inside:
                    at = m.end()
        elif not inside:
            out.append(data[at : m.start()])
            at = m.end()
            if not empty:
                inside.append(name)
        elif not empty:
            inside.append(name)
    return b"".join(out) + (b"" if inside else data[at:])


_OWN = ("name", "usage", "class", "measuredHeight", "storeysAboveGround", "city")


def _buildings(data: bytes) -> list[list]:
    """Rows of a CityGML document, read as a stream: one building is held at a time. Codes stay codes, with the name of their list."""
    out = []
    steps = ET.iterparse(io.BytesIO(data), ("start", "end"))
    _, root = next(steps)
    for event, e in steps:
        if event != "end" or _local(e.tag) != "Building":
            continue
        own: dict[str, tuple] = {}
        for c in [*e, *(c for c in e.iter() if _local(c.tag) == "city")]:
            key = _local(c.tag)
            if key in _OWN and key not in own:
                own[key] = (c.text, (c.get("codeSpace") or "").rpartition("/")[2] or None)
        shapes = building_footprint(e)
        if shapes:
            get = lambda k: own.get(k, (None, None))  # noqa: B023, E731
            height, storeys = float(get("measuredHeight")[0] or -9999), int(get("storeysAboveGround")[0] or 9999)
            key = next((v for k, v in e.attrib.items() if _local(k) == "id"), None)
            coded = [x for k in ("usage", "class", "city") for x in get(k)]
            out.append([key, get("name")[0], *coded, None if height == -9999 else height, None if storeys == 9999 else storeys, wkb.dumps("MultiPolygon", shapes)])
        e.clear()
        root.clear()
    return out


_CODED = ("usage", "class", "city")


def citygml_buildings(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """building_id, name, usage, class, city, height, storeys, geometry of zips of CityGML; sentinels (storeys 9999, height -9999) are null.

    Entries of a zip are read by several tasks, each one as a stream. Usages, classes and cities are looked up in the zip's code lists by a
    join; a code that a list lacks stays. A document that can't be parsed is tried again without the elements that aren't read here, and
    skipped if that fails too; a zip without any building is an error that says how many documents were. What is parsed is stored once.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "bad", "building_id", "name", *(f"{c}{x}" for c in _CODED for x in ("", "_list")), "height", "storeys", "geometry"]
        for b in batches:
            for file, content in zip(b["file"], b["content"]):
                try:
                    rows = _buildings(content)
                except ET.ParseError:
                    try:
                        rows = _buildings(without_unread(content))
                    except ET.ParseError:
                        rows = None
                found = [[file, False, *r] for r in rows] if rows else [[file, rows is None, *[None] * (len(names) - 2)]]
                yield pd.DataFrame(found, columns=names).astype({"storeys": "Int64", "height": "Float64"})

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, entry, content in zip(b["file"], b["entry"], b["content"]):
                entries = [{_local(c.tag): c.text for c in d} for d in ET.fromstring(content).iter() if _local(d.tag) == "Definition"]
                yield pd.DataFrame([(file, entry.rpartition("/")[2], d["name"], d["description"]) for d in entries], columns=["file", "list", "code", "label"])

    coded = ", ".join(f"`{c}` string, {c}_list string" for c in _CODED)
    read = zip_entries(spark, path, r".*udx/bldg/.*\.gml$", part_bytes=part_bytes).select("file", "content")
    rows = stored(read.mapInPandas(parse, f"file string, bad boolean, building_id string, name string, {coded}, height double, storeys long, geometry binary"), "buildings")
    per = zip_entries(spark, path, contents=False).select("file").distinct().join(rows.groupBy("file").agg(F.count("geometry").alias("n"), F.count_if("bad").alias("bad")), "file", "left")
    empty = per.where("coalesce(n, 0) = 0").first()
    if empty:
        raise ValueError(f"{empty['file']}: no building, {empty['bad'] or 0} files could not be read")
    codes = zip_entries(spark, path, r".*codelists/.*\.xml$").select("file", "entry", "content").mapInPandas(lists, "file string, list string, code string, label string")
    codes = stored(codes.groupBy("file", "list", "code").agg(F.first("label").alias("label")), "codes")
    d = rows.where("geometry is not null")
    for c in _CODED:
        own = codes.select("file", F.col("list").alias(f"{c}_list"), F.col("code").alias(c), F.col("label").alias(f"{c}_label"))
        d = d.join(own, ["file", f"{c}_list", c], "left").withColumn(c, F.coalesce(f"{c}_label", c))
    return d.select("building_id", "name", *_CODED, "height", "storeys", "geometry")
