"""Best-fit packing of token sequences by large-item matching.

Lengths are at most the capacity, so a histogram of at most `capacity` counts says all that a packing needs to know. On it,
pieces over a third of the capacity are paired greedily (the longest with the longest that still fits; at most two to a
bin), smaller ones go, longest first, to the tightest remaining gap. The outcome is a short list of runs: `count` pieces of
one length at one offset of `count` consecutive sequences. Pieces are numbered inside their length and take their places
from the runs by a join, so nothing but counts is ever gathered and the packing is as tight as one over all pieces at once.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END = 2
CAPACITY = 1024
#: Rows that are numbered in one group, at least; groups and their rows both grow with the root of a length's count.
GROUP_ROWS = 500


def _cut(name: str, path: str | None, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, path)
        for b in batches:
            for lo, hi, ids, at in enc.encode(b.column("text"), end):
                data = memoryview(ids.astype("<u4")).cast("B")
                n = np.diff(at)
                parts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = (n - 1) % capacity + 1
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                begin = at[row] + start
                crc = [zlib.crc32(data[4 * i : 4 * (i + k)]) for i, k in zip(begin.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place all pieces; ranks and sequences from 0.

    Work and output grow with the number of distinct lengths, not with the pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, count)

    def put(n: int, first: int, count: int, offset: int) -> None:
        runs.append((n, rank[n], count, first, offset))
        rank[n] += count
        left[n] -= count
        if (room := capacity - offset - n) > 0:
            gaps.setdefault(room, []).append((first, count))

    def opened(count: int) -> int:
        nonlocal sequences
        sequences += count
        return sequences - count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        fit = bisect_right(large, capacity - n) - 1
        while fit >= 0 and not left[large[fit]]:
            large.pop(fit)
            fit -= 1
        if fit < 0:
            put(n, opened(left[n]), left[n], 0)
            continue
        m = large[fit]
        count = left[n] // 2 if m == n else min(left[n], left[m])
        if not count:  # one piece of this length is left; its match is a shorter one
            fit -= 1
            while fit >= 0 and not left[large[fit]]:
                fit -= 1
            if fit < 0:
                put(n, opened(1), 1, 0)
                continue
            m, count = large[fit], 1
        first = opened(count)
        runs.append((n, rank[n], count, first, 0))
        rank[n] += count
        left[n] -= count
        put(m, first, count, n)
    rooms = sorted(gaps)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                first, count, room = opened(c := -(-left[n] // (capacity // n))), c, capacity
            else:
                room = rooms[k]
                first, count = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
                    rooms.pop(k)
            take = min(count, left[n])
            if take < count:
                _free(gaps, rooms, room, first + take, count - take)
            runs.append((n, rank[n], take, first, capacity - room))
            rank[n] += take
            left[n] -= take
            if room > n:
                _free(gaps, rooms, room - n, first, take)
    return runs


def _free(gaps: dict, rooms: list[int], room: int, first: int, count: int) -> None:
    if room not in gaps:
        gaps[room] = []
        insort(rooms, room)
    gaps[room].append((first, count))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, vocabulary_path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for every piece of every document.

    A null or empty text is the end id alone; a null doc_id is carried. Very long texts are encoded whole and cut. An empty table gives no rows. Documents of more than `capacity` ids are cut from the end, so only the first
    piece may be shorter. Equal rows, also of one doc_id, are packed each for itself. Extra columns are not read.
    """
    spark = docs.sparkSession
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_cut(vocabulary, vocabulary_path, end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(counts, capacity), "length long, rank0 long, n long, sequence0 long, offset long")
    groups = [max(1, math.ceil(counts.get(n, 0) / max(GROUP_ROWS, math.sqrt(counts.get(n, 0))))) for n in range(1, capacity + 1)]
    # rank inside the length: inside a hashed part of it, moved up by the parts before
    own_groups = F.get(F.split(F.lit(" ".join(map(str, groups))), " ").cast("array<int>"), F.col("length").cast("int") - 1)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), own_groups).cast("int")
    ranked = pieces.withColumn("part", part).withColumn("in_part", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    parts = pieces.withColumn("part", part).groupBy("length", "part").agg(F.count("*").alias("rows"))
    parts = parts.withColumn("base", F.sum("rows").over(Window.partitionBy("length").orderBy("part")) - F.col("rows")).drop("rows")
    ranked = ranked.join(parts, ["length", "part"]).withColumn("rank", F.col("base") + F.col("in_part"))
    # the runs of a length in order of rank0, as one array a length: at most `capacity` rows in all
    by_length = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank0", "n", "sequence0", "offset"))).alias("runs"))
    own = F.filter("runs", lambda r: (F.col("rank") >= r["rank0"]) & (F.col("rank") < r["rank0"] + r["n"]))[0]
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("run", own)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.sequence0") + F.col("rank") - F.col("run.rank0")).alias("sequence_id"), F.col("run.offset").alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
