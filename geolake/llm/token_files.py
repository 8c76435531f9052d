"""Token ids as Parquet lists, with selective reads of tokens and metadata.

Files hold ascending, disjoint ranges of doc_id; inside, rows ascend too. Ids are a dictionary-encoded list column, small
metadata columns stand beside it (a reader that wants lengths never touches ids), row groups are kept small enough to skip,
and the writer's column and offset indexes let a reader find the pages of a doc_id range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table
from .tokens import encoder

VOCABULARY = "word_bpe_49k.json"
END = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 2000
SCHEMA = "doc_id long, ids array<int>, n_tokens long"


def _encode(name: str, path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, path)
        for b in batches:
            for lo, hi, ids, at in enc.encode(b.column("text"), end):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), lists, pa.array(np.diff(at))], ["doc_id", "ids", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, vocabulary_path: str | None = None, end: int = END) -> None:
    """Encode every whole text (null: empty), append the end id and write the files under `path`.

    Rows with a null doc_id come first, equal ids stand together in the order of their texts. Extra columns are not read.
    """
    d = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ids = d.mapInArrow(_encode(vocabulary, vocabulary_path, end), SCHEMA)
    ids.write.options(**{"parquet.enable.dictionary": "true", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "compression": "zstd"}).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, ids, n_tokens; with bounds, only the row groups and pages whose ranges meet them are read."""
    d = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        d = d.where(F.col("doc_id") >= first)
    return d if last is None else d.where(F.col("doc_id") <= last)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        at = np.asarray(ids.offsets)
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crc = pa.array([zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), crc, *b.columns[2:]], ["doc_id", "n_tokens", "ids_crc32", *b.schema.names[2:]])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the ids themselves.

    start: ids of all documents before it in the order of doc_id. Sums run inside a file and are moved up by the files
    before it: files hold ascending ranges, so one row a file settles their order.
    """
    d = read_tokens(spark, path).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.row_index").alias("row"))
    d = d.mapInArrow(_checksums, "doc_id long, n_tokens long, ids_crc32 long, file string, block long, row long").drop("block")
    files = read_tokens(spark, path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("doc_id").alias("lo"), F.sum("n_tokens").alias("all"))
    files = files.withColumn("base", F.sum("all").over(Window.orderBy(F.col("lo").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return d.withColumn("within", within).join(files.select("file", "base"), "file").select("doc_id", (F.coalesce("base", F.lit(0)) + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)
