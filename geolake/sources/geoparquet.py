"""GeoParquet 1.1 files: metadata, spatial packing into row groups, and a distributed writer.

Spark's own writer can neither set file metadata nor cut row groups where a level ends, so files are written by pyarrow
inside tasks, one file for each tile of a bounded number of rows, through pyarrow's file systems, under a temporary name that is moved when complete: a
retried task repeats its file. Reading and pruning are Spark's: predicates on `bbox` reach the row groups' statistics.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.functions import grid
from geolake.functions.geometry import intersects_view
from geolake.operators.aggregates import choose_tiles, tile_of_keys

from .shared import file_system, stored

# Bytes aimed at in a row group (by file, and by cell of a leveled layout), most rows in one, most groups in a file.
GROUP_BYTES, CELL_BYTES, MOST_ROWS, MOST_GROUPS = 2 << 20, 1 << 20, 100_000, 2_000
# Row groups that a task reading footers gives out at once.
HELD_GROUPS = 10_000


def geo_metadata(kinds: list[str], bbox: list[float] | None = None) -> str:
    """The `geo` entry: WKB in `geometry`, covered by the struct `bbox`."""
    column = {"encoding": "WKB", "geometry_types": kinds, "covering": {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}}
    if bbox:
        column["bbox"] = bbox
    return json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}})


def covering_bbox(geo: str) -> tuple[str, tuple[str, str, str, str]]:
    """(struct column, its four fields) of the primary column's covering; anything else than four paths into one struct is an error."""
    meta = json.loads(geo)
    cover = meta["columns"][meta["primary_column"]].get("covering", {}).get("bbox")
    if not cover:
        raise ValueError("no covering")
    paths = [cover[k] for k in ("xmin", "ymin", "xmax", "ymax")]
    if any(len(p) != 2 for p in paths) or len({p[0] for p in paths}) != 1:
        raise ValueError("the covering must be four fields of one struct")
    return paths[0][0], tuple(p[1] for p in paths)


def row_group_size(size: int, rows: int, target: int = GROUP_BYTES) -> int:
    """Rows in a group of about the target bytes, 1 to 100 000, and no more than 2 000 groups in the file."""
    if rows == 0:
        return 1
    n = max(1, min(MOST_ROWS, int(target / max(1e-9, size / rows)))) if size else MOST_ROWS
    return max(n, -(-rows // MOST_GROUPS))


def pack(box: np.ndarray, size: int) -> np.ndarray:
    """An order of rows in which every `size` of them lie together: split along the longer side of the centres' extent at
    a multiple of the size, and again."""
    if size < 1 or not np.isfinite(box).all():
        raise ValueError("boxes must be finite and the size positive")
    centre = np.stack([box[:, 0] + box[:, 2], box[:, 1] + box[:, 3]], 1)
    out: list[np.ndarray] = []
    todo = [np.arange(len(box))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        extent = np.ptp(centre[own], axis=0)
        axis = int(extent[1] > extent[0])
        own = own[np.argsort(centre[own, axis], kind="stable")]
        half = max(1, -(-len(own) // size) // 2) * size
        todo += [own[half:], own[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def layout(box: np.ndarray, levels: np.ndarray | None, size: int, cells_first: bool = False) -> tuple[np.ndarray, list[int]]:
    """(order of rows, rows of each row group). Levels ascend, and no group holds two: over the whole file, or inside each
    packed cell of `size` rows if cells_first."""
    if levels is None:
        order = pack(box, size)
        return order, [len(x) for x in _chunks(order, size)]
    if np.isnan(levels.astype(float)).any():
        raise ValueError("a row has no level")
    if cells_first:
        groups = [part for cell in _chunks(pack(box, size), size) for part in _by_level(cell, levels)]
    else:
        groups = [g for part in _by_level(np.arange(len(box)), levels) for g in _chunks(part[pack(box[part], size)], size)]
    return np.concatenate(groups) if groups else np.zeros(0, np.int64), [len(x) for x in groups]


def _chunks(a: np.ndarray, n: int) -> list[np.ndarray]:
    return [a[i : i + n] for i in range(0, len(a), n)]


def _by_level(rows: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    rows = rows[np.argsort(levels[rows], kind="stable")]
    return np.split(rows, np.flatnonzero(np.diff(levels[rows])) + 1) if len(rows) else []


def write_file(t: pa.Table, path: str, metadata: dict[str, str], size: int | None = None, level: str | None = None, cells_first: bool = False) -> int:
    """Write one packed file and return its row groups."""
    b = t.column("bbox").combine_chunks()
    box = np.stack([b.field(k).to_numpy(zero_copy_only=False) for k in ("xmin", "ymin", "xmax", "ymax")], 1) if len(t) else np.zeros((0, 4))
    size = size or row_group_size(t.nbytes, len(t), CELL_BYTES if cells_first else GROUP_BYTES)
    order, groups = layout(box, t.column(level).to_numpy() if level else None, size, cells_first)
    if cells_first:  # the pruning column first: readers get it with the footer
        t = t.select(["bbox", *[c for c in t.column_names if c != "bbox"]])
    t = t.take(pa.array(order)).replace_schema_metadata(metadata)
    files, path = file_system(path)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with pq.ParquetWriter(temporary, t.schema, compression="zstd", filesystem=files) as w:
        at = 0
        for n in groups:
            w.write_table(t.slice(at, n), row_group_size=n)
            at += n
    files.move(temporary, path)
    return len(groups)


def write(df: DataFrame, folder: str, by: str, kinds: list[str], extra: dict[str, str] | None = None, folders: bool = False, **how) -> DataFrame:
    """One file for each value of `by` (a tile, a city: groups that fit a task), under a folder that all executors share.

    folders: each file in a folder of its own, so that readers have `by` as a partition column (see read_tiles).

    Returns `by`, file, rows, groups and the extent of every file, as a stored table: the files are written once, however often
    it is read. df needs `geometry` (WKB) and `bbox`. A folder that can't be written from tasks is an error.
    """
    file_system(folder)
    metadata = {"geo": geo_metadata(kinds), **(extra or {})}

    def put(key: tuple, t: pa.Table) -> pa.Table:
        path = f"{folder}/{by}={key[0].as_py()}" + ("/part.parquet" if folders else ".parquet")
        groups = write_file(t.drop_columns([by]), path, metadata, **how)
        b = t.column("bbox").combine_chunks()
        edge = [f(b.field(k).to_numpy(zero_copy_only=False)) for k, f in (("xmin", np.min), ("ymin", np.min), ("xmax", np.max), ("ymax", np.max))]
        return pa.table({by: [str(key[0].as_py())], "file": [path], "rows": [len(t)], "groups": [groups], "xmin": [edge[0]], "ymin": [edge[1]], "xmax": [edge[2]], "ymax": [edge[3]]})

    return stored(df.groupBy(by).applyInArrow(put, f"{by} string, file string, rows long, groups long, xmin double, ymin double, xmax double, ymax double"), "items")


def write_tiles(df: DataFrame, folder: str, least: int, most: int, rows: int, kinds: list[str], **how) -> DataFrame:
    """Files of adaptive tiles: a tile with more than `rows` rows is split, from `least` down to `most` digits of the quadkey.

    df: `lon`, `lat`, `geometry` and `bbox`. Rows are placed by a join of their fine key with the key's tile. That the files written
    are the tiles chosen is checked.
    """
    keyed = df.withColumn("key", grid.quadkey(F.col("lon"), F.col("lat"), most))
    counts = stored(keyed.groupBy("key").agg(F.count("*").alias("n")), "keys")
    tiles = stored(choose_tiles(counts, least, most, rows), "tiles")
    placed = keyed.join(tile_of_keys(counts, tiles, least, most).select("key", "quadkey"), "key").drop("key")
    items = write(placed, folder, "quadkey", kinds, **how)
    wrong = items.select("quadkey", "rows").exceptAll(tiles.select("quadkey", "rows")).unionByName(tiles.select("quadkey", "rows").exceptAll(items.select("quadkey", "rows")))
    if not wrong.isEmpty():
        raise ValueError(f"files differ from the tiles: {[r['quadkey'] for r in wrong.limit(5).collect()]}")
    return items


def read_tiles(spark: SparkSession, folder: str, items: DataFrame, schema: str, view: tuple[float, float, float, float], by: str = "quadkey") -> DataFrame:
    """What a view shows of files in folders (see write): the catalogue's items choose the tiles at run time (dynamic partition
    pruning), the boxes' statistics the row groups, and the boxes the rows. items: `by` and the extent of each tile; a tile is one row, so
    the view's are few, and Spark broadcasts them if they are small."""
    west, south, east, north = view
    chosen = items.where((F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south)).select(by)
    d = spark.read.schema(f"{schema}, {by} string").parquet(folder)
    return d.where(intersects_view("bbox", west, south, east, north)).join(chosen, by)


def repack(spark: SparkSession, source: str, folder: str, least: int, most: int, rows: int, kinds: list[str], **how) -> DataFrame:
    """Existing files (with `geometry` and `bbox`) written anew as packed files of adaptive tiles; returns their items.

    Row counts are compared; the source stays as it is, and the folder must be another one.
    """
    if source.rstrip("/") == folder.rstrip("/"):
        raise ValueError("the folder is the source")
    d = spark.read.parquet(source)
    middle = lambda a, b: (F.col(f"bbox.{a}") + F.col(f"bbox.{b}")) / 2
    items = write_tiles(d.withColumn("lon", middle("xmin", "xmax")).withColumn("lat", middle("ymin", "ymax")), folder, least, most, rows, kinds, **how)
    if (items.agg(F.sum("rows")).first()[0] or 0) != d.count():
        raise ValueError("rows were lost")
    return items


def _of_row_groups(df: DataFrame, column: str, values: Callable[[pq.RowGroupMetaData, dict[str, int]], tuple], schema: pa.Schema) -> DataFrame:
    """file, row_group and values() of every row group of the files named in a column, read in tasks from footers only; values() gets the
    group and the places of its columns by their paths.

    One footer is held at a time. `schema` of a footer is not asked for: it refers to the footer and the footer to it, so both would
    stay until Python looks for cycles, and footers of many row groups would pile up.
    """
    schema = pa.schema([("file", pa.string()), ("row_group", pa.int64()), *schema])
    types = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else f.type}" for f in schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        for b in batches:
            for file in b.column(0).to_pylist():
                files, path = file_system(file)
                with files.open_input_file(path) as f:
                    meta = pq.read_metadata(f)
                places = {}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    places = places or {group.column(i).path_in_schema: i for i in range(group.num_columns)}
                    rows.append((file, g, *values(group, places)))
                    if len(rows) >= HELD_GROUPS:
                        yield out()
                        rows.clear()
        if rows:
            yield out()

    return df.select(column).mapInArrow(read, types)


def footers(df: DataFrame, column: str = "file") -> DataFrame:
    """file, row_group, rows, bytes and extent of every row group of the files named in a column, read in tasks from footers only."""

    def values(group: pq.RowGroupMetaData, places: dict[str, int]) -> tuple:
        edge = lambda k, end: getattr(group.column(places[f"bbox.{k}"]).statistics, end)
        return group.num_rows, group.total_byte_size, edge("xmin", "min"), edge("ymin", "min"), edge("xmax", "max"), edge("ymax", "max")

    extent = [(k, pa.float64()) for k in ("xmin", "ymin", "xmax", "ymax")]
    return _of_row_groups(df, column, values, pa.schema([("rows", pa.int64()), ("bytes", pa.int64()), *extent]))


def column_ranges(df: DataFrame, of: str, column: str = "file") -> DataFrame:
    """file, row_group, low and high (of a whole-number column) of every row group of the files named in a column, from footers only; without
    statistics, or if all are null, both are null."""

    def values(group: pq.RowGroupMetaData, places: dict[str, int]) -> tuple:
        seen = group.column(places[of]).statistics
        return (seen.min, seen.max) if seen is not None and seen.has_min_max else (None, None)

    return _of_row_groups(df, column, values, pa.schema([("low", pa.int64()), ("high", pa.int64())]))


def spatially_sorted(df: DataFrame, lon: str, lat: str, files: int, zoom: int = 16) -> DataFrame:
    """Rows in quadkey order over `files` partitions of about equal size: the layout of tables too large to pack as one file."""
    key = grid.quadkey(F.col(lon), F.col(lat), zoom)
    return df.withColumn("quadkey", key).repartitionByRange(files, "quadkey").sortWithinPartitions("quadkey")
