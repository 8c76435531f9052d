"""A streaming roll-up: events in time windows and mesh cells. The grid functions are stateless expressions, so they are the same as in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.functions import grid
from geolake.sources.shared import shared_dir


def windowed(events: DataFrame, late: str = "10 minutes", window: str = "1 day", digits: int = 4) -> DataFrame:
    """window start, mesh_code, n, value of a batch or a stream of events; rows later than the watermark are left out of a stream."""
    lon = F.expr("139 + CAST((event_id * 7919) % 17000 AS DOUBLE) / 10000")
    lat = F.expr("35 + CAST((event_id * 104729) % 13000 AS DOUBLE) / 10000")
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), grid.mesh_code(lon, lat, digits).alias("mesh_code"))
    return d.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "mesh_code", "n", "value")


def run_coverage(spark: SparkSession, source: str, folder: str) -> None:
    """Take in what is new under `source` (a path or pattern of Parquet files) since the last run with this folder, and stop.

    The folder holds the state of all windows, so a second run reads the new files only. After each batch the windows that it
    changed, open ones too, are written under the batch's number; a batch that is repeated after a failure writes the same again.
    """
    schema = spark.read.parquet(source).schema

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/windows/batch={batch}")

    events = windowed(spark.readStream.schema(schema).parquet(source))
    events.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """start, mesh_code, n, value: the last state of every window, from what the runs wrote."""
    d = spark.read.schema("start timestamp, mesh_code string, n long, value double, batch long").parquet(f"{folder}/windows")
    last = d.groupBy("start", "mesh_code").agg(F.max_by(F.struct("n", "value"), "batch").alias("last"))
    return last.select("start", "mesh_code", "last.n", "last.value")


def stream_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Run the stream over the table at `path` until it is consumed; all windows come from the stream's state."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_coverage(spark, f"{path[:-1]}[{path[-1]}]", folder)  # a pattern that only this file matches
    return coverage(spark, folder)
