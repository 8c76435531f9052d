"""The catalogue: what collections there are, their files as items, and which files or collections a query needs."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass, field
from pathlib import PurePath
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system

ITEM_COLUMNS = {"id", "collection", "file", "rows", "xmin", "ymin", "xmax", "ymax", "kinds", "vintage", "source_lod"}


@dataclass(frozen=True)
class Collection:
    """A logical dataset: its kind, the prefix of its files' names, and what queries may rely on."""

    id: str
    kind: str
    prefix: str
    mesh_digits: int | None = None
    tiers: tuple = ()
    coarse_tolerance_m: float | None = None
    covers: str | None = None
    columns: tuple[str, ...] = field(default=())


def collection_of(file: str, collections: list[Collection]) -> Collection:
    """By the longest prefix of the file's name; an unknown file is an error."""
    name = os.path.basename(file)
    found = [c for c in collections if name.startswith(c.prefix)]
    if not found:
        raise ValueError(f"no collection for {name}")
    return max(found, key=lambda c: len(c.prefix))


def mesh_source(collections: list[Collection], digits: int) -> Collection | None:
    """The coarsest mesh collection that is fine enough, so that as little as possible is read."""
    return min((c for c in collections if c.mesh_digits and c.mesh_digits >= digits), key=lambda c: c.mesh_digits, default=None)


def covering(collections: list[Collection]) -> dict[str, str]:
    """Coverage collections by the collection they summarise."""
    return {c.covers: c.id for c in collections if c.covers}


def extents(items: DataFrame) -> DataFrame:
    """collection, files, rows and the union of the items' boxes."""
    return items.groupBy("collection").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def write_items(items: DataFrame, path: str) -> list[str]:
    """The items as one file: a row group for each collection, the ones with most items first (equal ones by name), statistics on
    collection and box only. Returns the order. An unknown column is an error. Items are files, so their table is small."""
    unknown = set(items.columns) - ITEM_COLUMNS
    if unknown:
        raise ValueError(f"unknown properties {sorted(unknown)}")
    t = items.orderBy("collection", "id").toArrow()
    sizes: dict[str, int] = {}
    for c in t.column("collection").to_pylist():
        sizes[c] = sizes.get(c, 0) + 1
    order = sorted(sizes, key=lambda c: (-sizes[c], c))
    stats = [c for c in ("collection", "xmin", "ymin", "xmax", "ymax") if c in t.column_names]
    files, path = file_system(path)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with pq.ParquetWriter(temporary, t.schema, compression="zstd", use_dictionary=False, write_statistics=stats, filesystem=files) as w:
        for c in order:
            own = t.filter(pa.compute.equal(t.column("collection"), c))
            w.write_table(own, row_group_size=len(own))
    files.move(temporary, path)
    return order


def read_items(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """One collection's items: the statistics leave only its row group to be read."""
    return spark.read.parquet(path).where(F.col("collection") == collection)


def city_catalog(spark: SparkSession, path: str) -> DataFrame:
    """city_code, city_name, lods of a JSON catalogue of cities (a list of {city_code, city_name, url, lods}): entries without a
    url are left out, levels are distinct and ascend."""
    d = spark.read.option("multiLine", True).schema("city_code string, city_name string, url string, lods array<int>").json(path)
    d = d.where("url is not null and url <> ''").select("city_code", "city_name", F.explode_outer("lods").alias("lod"))
    return d.groupBy("city_code", "city_name").agg(F.array_join(F.array_sort(F.collect_set("lod")).cast("array<string>"), ",").alias("lods"))


def collection_documents(items: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """(path, json): a catalogue with links to its collections, and a collection document for each of them with the extent of its items.

    A collection without a description is an error; descriptions of what isn't there are ignored.
    """
    missing = [r["collection"] for r in items.select("collection").distinct().collect() if r["collection"] not in descriptions]  # collections are few
    if missing:
        raise ValueError(f"no description of {sorted(missing)}")
    said = F.create_map(*[F.lit(x) for pair in descriptions.items() for x in pair])
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.alias("href"), F.lit("application/json").alias("type"))
    file = F.concat(F.col("collection"), F.lit("/collection.json"))
    whole = extents(items)
    head = lambda kind, name, text: [F.lit(kind).alias("type"), F.lit("1.0.0").alias("stac_version"), name.alias("id"), text.alias("description")]
    box = F.when(F.col("xmin").isNotNull(), F.array("xmin", "ymin", "xmax", "ymax"))
    extent = F.struct(F.struct(F.array(box).alias("bbox")).alias("spatial"), F.struct(F.array(F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))).alias("interval")).alias("temporal"))
    documents = whole.select(file.alias("path"), F.to_json(F.struct(
        *head("Collection", F.col("collection"), said[F.col("collection")]), F.lit("various").alias("license"), extent.alias("extent"),
        F.struct("files", "rows").alias("summaries"), F.array(link("root", F.lit("../catalog.json")), link("items", F.lit("../items.parquet"))).alias("links"),
    )).alias("json"))
    links = F.concat(F.array(link("self", F.lit("catalog.json"))), F.transform(F.array_sort(F.collect_list(file)), lambda x: link("child", x)))
    return documents.unionByName(whole.agg(links.alias("links")).select(F.lit("catalog.json").alias("path"), F.to_json(F.struct(*head("Catalog", F.lit("catalogue"), F.lit("All collections")), "links")).alias("json")))


def resolve(href: str, base: str) -> str:
    """A link of the document `base` (a path from the catalogue's root, or a URL) as such a path or URL; absolute URLs stay."""
    if re.match("[a-z][a-z0-9+.-]*:", href, re.I):
        return href
    if re.match("[a-z][a-z0-9+.-]*:", base, re.I):
        return urljoin(base, href)
    return urljoin("https://root.invalid/" + base, href).removeprefix("https://root.invalid/")


def delivery_path(path: str, base: str) -> str:
    """The path below base with slashes, as the key of a file in a store."""
    own, top = PurePath(path.replace("\\", "/")), PurePath(base.replace("\\", "/"))
    return "/".join((own.relative_to(top) if own.is_relative_to(top) else own).parts)


def feature(geometry: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text; geometry is a GeoJSON geometry as text."""
    props = F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()]), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))


def box_geojson(b: Column) -> Column:
    """A box as a GeoJSON polygon, as text."""
    xy = lambda x, y: F.array(b[x], b[y])
    ring = F.array(xy("xmin", "ymin"), xy("xmax", "ymin"), xy("xmax", "ymax"), xy("xmin", "ymax"), xy("xmin", "ymin"))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def provenance(path: str) -> dict[str, str]:
    """The entries of a file's metadata other than Arrow's own."""
    files, path = file_system(path)
    return {k.decode(): v.decode() for k, v in (pq.read_schema(path, filesystem=files).metadata or {}).items() if not k.startswith(b"ARROW")}


def describe(path: str) -> dict:
    """Columns, rows, row groups and geometry kinds of one file, from its footer."""
    files, path = file_system(path)
    meta = pq.read_metadata(path, filesystem=files)
    geo = json.loads((meta.metadata or {}).get(b"geo", b"{}") or b"{}")
    primary = geo.get("columns", {}).get(geo.get("primary_column", ""), {})
    return {"columns": meta.schema.to_arrow_schema().names, "rows": meta.num_rows, "row_groups": meta.num_row_groups, "kinds": primary.get("geometry_types", []), "bbox": primary.get("bbox")}


def document_tree(items: DataFrame, descriptions: dict[str, str], groups: dict[str, str], derived: dict[str, list[str]] | None = None, translated: dict[str, dict[str, str]] | None = None) -> dict[str, dict]:
    """The documents of a catalogue by path: the root, a sub-catalogue for each group, a collection document below its group, copies in other
    languages (`x.ja.json` beside `x.json`), and one bundle of them all.

    groups: the group of each collection. derived: the collections that a collection is made of, as links. translated: by language,
    descriptions of collections and groups; what a language lacks keeps the first one's text. Extents are aggregated from the items; collections
    are few, so their documents are built here. A collection without a description or a group, and a link to what isn't there, are errors.
    """
    derived, translated = derived or {}, translated or {}
    found = {r["collection"]: r for r in extents(items).collect()}
    missing = sorted(c for c in found if c not in descriptions or c not in groups)
    if missing:
        raise ValueError(f"no description or group of {missing}")
    own = {c: f"{groups[c]}/{c}/collection.json" for c in found}
    out: dict[str, dict] = {}

    def link(rel: str, target: str, here: str, **more: str) -> dict:
        return {"rel": rel, "href": os.path.relpath(target, os.path.dirname(here) or ".").replace(os.sep, "/"), "type": "application/json", **more}

    def put(path: str, kind: str, name: str, links: list[tuple[str, str]], **more) -> None:
        for language in (None, *sorted(translated)):
            at = path if language is None else path.replace(".json", f".{language}.json")
            text = translated.get(language or "", {}).get(name, descriptions.get(name, name))
            copies = [link("alternate", path if x is None else path.replace(".json", f".{x}.json"), at, **({"hreflang": x} if x else {})) for x in (None, *sorted(translated)) if x != language]
            out[at] = {"type": kind, "stac_version": "1.0.0", "id": name, "description": text, **more, "links": [link("self", at, at), *(link(r, t, at) for r, t in links), *copies]}

    top = "catalog.json"
    put(top, "Catalog", "catalogue", [("root", top), *(("child", f"{g}/catalog.json") for g in sorted({groups[c] for c in found}))])
    for g in sorted({groups[c] for c in found}):
        put(f"{g}/catalog.json", "Catalog", g, [("root", top), ("parent", top), *(("child", own[c]) for c in sorted(found) if groups[c] == g)])
    for c, r in sorted(found.items()):
        box = None if r["xmin"] is None else [r["xmin"], r["ymin"], r["xmax"], r["ymax"]]
        made = [("derived_from", own.get(d, f"{groups.get(d, 'unknown')}/{d}/collection.json")) for d in derived.get(c, [])]
        put(own[c], "Collection", c, [("root", top), ("parent", f"{groups[c]}/catalog.json"), ("items", "items.parquet"), *made],
            license="various", extent={"spatial": {"bbox": [box]}, "temporal": {"interval": [[None, None]]}}, summaries={"files": r["files"], "rows": r["rows"]})
    check_links(out, {"items.parquet"})
    out["bundle.json"] = {"type": "Bundle", "documents": [{"path": p, **d} for p, d in sorted(out.items())]}
    return out


def check_links(documents: dict[str, dict], files: set[str] = frozenset()) -> None:
    """Every link of the documents leads to one of them, to one of the files, or out of the tree by an absolute URL; others are an error that names them all."""
    dangling = [(p, x["href"]) for p, d in sorted(documents.items()) for x in d.get("links", []) if not re.match("[a-z][a-z0-9+.-]*:", (to := resolve(x["href"], p)), re.I) and to not in documents and to not in files]
    if dangling:
        raise ValueError(f"dangling links {dangling}")


def write_documents(documents: dict[str, dict], folder: str) -> None:
    """The documents as files below a folder, each one under a temporary name that is moved when complete."""
    for at, d in documents.items():
        files, path = file_system(f"{folder.rstrip('/')}/{at}")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(temporary) as f:
            f.write(json.dumps(d, ensure_ascii=False, indent=1).encode())
        files.move(temporary, path)
