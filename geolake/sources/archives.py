"""Data sources that give the parts of large files to tasks: entries of zips, features of GeoJSON.

The driver reads directories of zips and sizes only; a task opens the file itself and holds one entry, or one feature, at a
time. Files are found and opened through pyarrow's file systems.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import file_system

#: Bytes of packed entries, or of text, that a task is given; a larger entry stands alone.
PART_BYTES = 32 << 20


def found_files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder whose names end so, in order of name."""
    files, at = file_system(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inner = sorted((i for i in files.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(suffix)), key=lambda i: i.path)
    return [(path.rstrip("/") + i.path[len(at.rstrip("/")) :], i.size) for i in inner]


def opened(path: str):
    files, at = file_system(path)
    return files.open_input_file(at)


@dataclass
class _Entries(InputPartition):
    file: str
    names: list


class ZipEntries(DataSource):
    """`zip_entries`: file, entry, bytes, packed (bytes in the zip) and content of the entries of zips.

    Options: path (a zip or a folder of zips), entries (a regular expression that names match from their start; all by default),
    contents (false: null contents, and nothing but the directory is read).
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "file string, entry string, bytes long, packed long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part = options["path"], int(options.get("partBytes", PART_BYTES))
        self.wanted, self.contents = re.compile(options.get("entries", "")), options.get("contents", "true") == "true"

    def partitions(self) -> list[_Entries]:
        parts = []
        for file, _ in found_files(self.path, ".zip"):
            with opened(file) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for i in z.infolist():
                    if i.is_dir() or not self.wanted.match(i.filename):
                        continue
                    if held and size + i.file_size > self.part:
                        parts.append(_Entries(file, held))
                        held, size = [], 0
                    held.append(i.filename)
                    size += i.file_size
                if held:
                    parts.append(_Entries(file, held))
        return parts

    def read(self, partition: _Entries) -> Iterator[tuple]:
        if partition is None:
            return
        with opened(partition.file) as f, zipfile.ZipFile(f) as z:
            for n in partition.names:
                i = z.getinfo(n)
                yield partition.file, n, i.file_size, i.compress_size, z.read(n) if self.contents else None


@dataclass
class _Range(InputPartition):
    file: str
    begin: int
    end: int


class GeoJsonFeatures(DataSource):
    """`geojson_features`: file, crs (the collection's name of its reference system) and feature (JSON text) of FeatureCollections.

    Where a file's features stand on lines of their own, ranges of it are read by several tasks; any other file is read by one, in
    steps. No task holds more than a step and a feature. Members after the features are not read, so `crs` must come before
    them, else it is null.
    """

    @classmethod
    def name(cls) -> str:
        return "geojson_features"

    def schema(self) -> str:
        return "file string, crs string, feature string"

    def reader(self, schema) -> DataSourceReader:
        return _FeatureReader(self.options)


_STEP = 1 << 20
_START = re.compile(rb'"features"\s*:\s*\[')


class _FeatureReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part = options["path"], int(options.get("partBytes", PART_BYTES))

    @staticmethod
    def head(file: str) -> tuple[str | None, int, bool]:
        """The reference system, where the features begin, and whether each one has a line of its own."""
        held = b""
        with opened(file) as f:
            while True:
                more = f.read(_STEP)
                held += more
                at = _START.search(held)
                if at or not more:
                    break
            if not at:
                raise ValueError(f"{file}: not a FeatureCollection")
            try:
                top = json.loads(held[: at.end()].decode() + "]}")
            except ValueError as e:
                raise ValueError(f"{file}: not a FeatureCollection: {e}") from None
            if top.get("type", "FeatureCollection") != "FeatureCollection":
                raise ValueError(f"{file}: not a FeatureCollection")
            f.seek(at.end())
            lines = f.read(_STEP).split(b"\n")
            own = len(lines) > 2 and not lines[0].strip()
            for text in lines[1:3] if own else []:
                try:
                    own &= isinstance(json.loads(text.strip().rstrip(b",")), dict)
                except ValueError:
                    own = False
        return ((top.get("crs") or {}).get("properties") or {}).get("name"), at.end(), own

    def partitions(self) -> list[_Range]:
        parts = []
        for file, size in found_files(self.path, "json"):
            _, begin, own = self.head(file)
            step = self.part if own else size
            parts += [_Range(file, b, min(size, b + step)) for b in range(begin, max(size, begin + 1), max(1, step))]
        return parts

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition is None:
            return
        crs, begin, own = self.head(partition.file)
        with opened(partition.file) as f:
            for text in self._lines(f, partition, begin) if own else self._steps(f, begin):
                yield partition.file, crs, text

    @staticmethod
    def _lines(f, part: _Range, begin: int) -> Iterator[str]:
        """Lines that begin in the range."""
        at = part.begin - (part.begin > begin)
        f.seek(at)
        reader = io.BufferedReader(f, _STEP)
        if at < part.begin:  # the line that runs into the range is the range before's
            at += len(reader.readline())
        while at < part.end:
            line = reader.readline()
            if not line:
                return
            at += len(line)
            text = line.strip().rstrip(b",")
            if text.startswith(b"]"):
                return
            if text:
                if text.endswith(b"]}") and not _whole(text):  # the collection ends on the last feature's line
                    text = text[:-2].rstrip()
                yield text.decode()

    @staticmethod
    def _steps(f, begin: int) -> Iterator[str]:
        import codecs

        f.seek(begin)
        decode, scan, text = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder(), ""
        done = False
        while not done:
            more = f.read(_STEP)
            text, done = text + decode.decode(more, final=not more), not more
            while True:
                text = text.lstrip(" \t\r\n,")
                if text.startswith("]"):
                    return
                try:
                    feature, end = scan.raw_decode(text)
                except ValueError:
                    if done and text:
                        raise
                    break
                yield json.dumps(feature, ensure_ascii=False)
                text = text[end:]


def _whole(text: bytes) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def _load(spark: SparkSession, source: type[DataSource], **options: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def zip_entries(spark: SparkSession, path: str, entries: str = "", contents: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    return _load(spark, ZipEntries, path=path, entries=entries, contents=str(contents).lower(), partBytes=str(part_bytes))


def geojson_features(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    return _load(spark, GeoJsonFeatures, path=path, partBytes=str(part_bytes))


def zip_summary(spark: SparkSession, path: str, entries: str = "") -> DataFrame:
    """file, entries, bytes, packed: what the zips hold, from their directories alone; the sizes for a survey's sample."""
    from pyspark.sql import functions as F

    return zip_entries(spark, path, entries, contents=False).groupBy("file").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.sum("packed").alias("packed"))
