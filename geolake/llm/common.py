"""What the operators share: shared-folder tables, vectorised word splitting and 64-bit mixing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.sources.shared import shared_dir, stored

__all__ = ["shared_dir", "stored"]

#: ASCII white space, the separators of words in the contracts.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes in a batch that goes between Spark and Python: whole texts are long rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches sized for texts, so that a worker holds a few megabytes at a time; a session that sets its own smaller size keeps it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than 1 / HEAVY of all rows is heavy: there are fewer than HEAVY such keys.
HEAVY = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left joined (inner) with right, which has one row a key and in its column `rows` how many rows of left the key has.

    total: all rows of left. Rows of heavy keys stay where they are and meet a broadcast of less than HEAVY rows, the others are
    shuffled by key. The heavy keys come to the driver; right should be a stored table.
    """
    heavy = [r[0] for r in right.where(F.col(rows) * HEAVY > total).select(key).collect()]
    right = right.drop(rows)
    if not heavy:
        return left.join(right, key)
    much = F.col(key).isin(heavy)
    return left.where(~much).join(right.where(~much), key).unionByName(left.where(much).join(F.broadcast(right.where(much)), key))


def crc_of_id(col="doc_id"):
    """crc32 of the id as text, the rule that deals documents into folds."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, p, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary Arrow column in one array, and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(buf: np.ndarray, at: np.ndarray, fold: bool = True, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows at once: their first and end bytes, their 64-bit hashes, and the bounds of each row in these arrays.

    fold: A-Z count as a-z. Words are runs of bytes of which `solid` is true, or else that are not ASCII white space; they end
    with their row.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[buf] if solid is None else solid[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = at[:-1][at[:-1] < n]
    first[cut] = solid[cut]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    last = at[1:][at[1:] > 0] - 1
    end[last] = solid[last]
    s, e = np.flatnonzero(first), np.flatnonzero(end) + 1
    return s, e, hashes(_LOWER[buf] if fold else buf, s, e), np.searchsorted(s, at)


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs from s to e: a polynomial modulo 2**64 by differences of a running sum, then mixed."""
    n = len(buf)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    term = buf.astype(np.uint64)
    term += np.uint64(1)
    term *= up[:n]
    np.cumsum(term, out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def blocks(at: np.ndarray, most: int = 2 << 20) -> list[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each, to bound the memory of vectorised work; a longer row stands alone."""
    out, lo = [], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out
