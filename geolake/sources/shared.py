"""The folder that the driver and all executors share, tables stored there, and the file systems that files are written to."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own below the shared one: tables that are stored inside this context go there, and it is removed at the end.

    Results must be written or collected before that, as they read from it.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The open scratch folder, or else spark.checkpoint.dir; a session without one is an error, as a folder of one machine would be lost on a cluster."""
    base = _SCRATCH.get() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def stored(df: DataFrame, name: str = "t", **options) -> DataFrame:
    """df written as Parquet into the shared folder once and read again: cuts the lineage, outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df dealt over tasks of about so many rows: a small file is one task otherwise, however much work its rows make. df is counted first."""
    return df.repartition(max(1, -(-df.count() // rows)))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; a scheme that files can't be written to from tasks is an error."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", path)
    if not scheme or scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    if scheme[1] not in ("s3", "s3a", "gs", "hdfs"):
        raise ValueError(f"files can't be written to {scheme[1]}:")
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
