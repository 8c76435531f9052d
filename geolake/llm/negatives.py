"""Hard negatives by exact integer products, computed bit-plane by bit-plane.

Components are integers in two's complement. The planes of all rows meet the anchors most significant first; after each plane
a score lies in an interval: what is summed so far, and what the lower planes can still add. A pair of an anchor and a row is
dropped once its interval can't qualify any more: when it is below the score of as many surely qualifying rows as are wanted,
or outside the bounds that the contract sets. Pairs that are left after the last plane have exact scores.

Anchors go to the rows in blocks of bounded bytes; rows stay where they are, and every task gives a few rows an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Anchors a block: what is broadcast at once is at most this many bytes of components and bounds.
BLOCK_BYTES = 16 << 20
#: Pairs that a task holds at once.
PAIRS = 1 << 21
POSITIVES, NEGATIVES = 5, 10
#: Percent of a positive's score that a negative's lies between.
LEAST, MOST = 30, 90
SCALE = 256


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, vector being array<long>: each component times 256, rounded down.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Of rows of one id the one with the least
    label, and then the least vector, does. Columns other than vec_id, label and embedding aren't read.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    d = rows.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("vector"))
    one = d.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("vec_id", "row.label", "row.vector")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; shorter lists end in zeros."""
    at = vectors.offsets.to_numpy()
    values, at = vectors.values.to_numpy()[at[0] : at[-1]], at - at[0]
    out = np.zeros((len(vectors), width), np.int64)
    row = np.repeat(np.arange(len(vectors)), np.diff(at))
    out[row, np.arange(len(values)) - at[row]] = values
    return out


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or -inf where a row has fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def first_of_groups(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(g) else np.zeros(0, int)
    return order[rank < k]


class Planes:
    """Anchors (rows of integers), their slots' score bounds, and the search for the first `k` rows of each slot.

    A slot (anchor, lo, hi) wants the k best rows with a score from lo to hi. `same`: rows of the anchor's own label, itself
    left out, or rows of other labels.
    """

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, slots: tuple[np.ndarray, np.ndarray, np.ndarray], bits: int, same: bool, k: int):
        self.a, self.ids, self.labels, self.bits, self.same, self.k = anchors, ids, labels, bits, same, k
        self.owner, self.lo, self.hi = slots[0].astype(np.int64), slots[1].astype(np.float64), slots[2].astype(np.float64)
        # sums of 0 or 1 times components are whole numbers below 2**24 or 2**53: floats hold them exactly
        most = int(np.abs(anchors).sum(1).max(initial=0)) << bits
        if most >= 1 << 53:
            raise ValueError("components are too large for exact products")
        self.real = np.float32 if most < 1 << 24 else np.float64
        self.up, self.down = np.where(anchors > 0, anchors, 0).sum(1).astype(self.real), np.where(anchors < 0, anchors, 0).sum(1).astype(self.real)
        self.slots_of = [np.flatnonzero(self.owner == a) for a in range(len(anchors))]
        self.per = max((len(s) for s in self.slots_of), default=0)
        #: by anchor and slot of the anchor: bounds and the k-th best score found so far (an anchor with fewer slots has impossible ones)
        self.slot = np.full((len(anchors), self.per), -1)
        for a, s in enumerate(self.slots_of):
            self.slot[a, : len(s)] = s
        self.least = np.where(self.slot < 0, np.inf, np.append(self.lo, 0)[self.slot])
        self.greatest = np.where(self.slot < 0, -np.inf, np.append(self.hi, 0)[self.slot])
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64))
        self.looked = 0

    def _alive(self, a, low, high) -> np.ndarray:
        """Pairs that can still qualify for one of the slots of their anchors `a`, by their scores' intervals."""
        alive = np.zeros(low.shape, bool)
        for j in range(self.per):
            alive |= (high >= self.least[a, j]) & (low <= self.greatest[a, j])
        return alive

    def _tighten(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> None:
        """Raise the slots' lower bounds to the k-th largest low end of rows that surely qualify. low, high: anchors x rows."""
        for j in range(self.per):
            sure = np.where(alive & (low >= self.least[:, j, None]) & (high <= self.greatest[:, j, None]), low, -np.inf)
            self.least[:, j] = np.maximum(self.least[:, j], kth_largest(sure, self.k))

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Meet more rows."""
        if not len(ids) or not len(self.a) or not self.per:
            return
        a, unsigned = self.a.astype(self.real), vectors & ((1 << self.bits) - 1)
        cols = np.arange(len(ids))
        alive = (labels[None, :] == self.labels[:, None]) == self.same
        if self.same:
            alive &= ids[None, :] != self.ids[:, None]
        total = np.zeros(alive.shape, self.real)
        plane = self.bits - 1
        while plane >= 0:
            self.looked += alive.shape[0] * alive.shape[1]
            bit = ((unsigned[cols] >> plane) & 1).astype(self.real)
            total += (a @ bit.T) * self.real(-(1 << plane) if plane == self.bits - 1 else 1 << plane)
            rest = self.real((1 << plane) - 1)
            low, high = total + rest * self.down[:, None], total + rest * self.up[:, None]
            alive &= self._alive(np.arange(len(self.a))[:, None], low, high)
            if plane <= self.bits - 3:
                self._tighten(low, high, alive)
                alive &= self._alive(np.arange(len(self.a))[:, None], low, high)
            plane -= 1
            if alive.sum() * 8 < alive.size:
                break
            left = alive.any(0)
            if left.sum() * 2 < len(cols):  # rows that no anchor wants any more
                cols, total, alive = cols[left], total[:, left], alive[:, left]
        # the few pairs left, each for itself
        at, col = np.nonzero(alive)
        score, col = total[at, col].astype(np.float64), cols[col]
        while plane >= 0 and len(at):
            step = max(1, PAIRS // a.shape[1] if a.shape[1] else PAIRS)
            part = np.empty(len(at))
            for i in range(0, len(at), step):
                s = slice(i, i + step)
                part[s] = np.einsum("pd,pd->p", self.a[at[s]], (unsigned[col[s]] >> plane) & 1)
            score += part * float(-(1 << plane) if plane == self.bits - 1 else 1 << plane)
            self.looked += len(at)
            rest = float((1 << plane) - 1)
            keep = self._alive(at, score + rest * self.down[at], score + rest * self.up[at])
            at, col, score = at[keep], col[keep], score[keep]
            plane -= 1
        self._take(at, score, ids[col])

    def _take(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Put exact scores into the slots that they qualify for and keep each slot's first k."""
        groups, scores, rows = [self.found[0]], [self.found[1]], [self.found[2]]
        for j in range(self.per):
            fits = (score >= self.least[at, j]) & (score <= self.greatest[at, j])
            groups.append(self.slot[at[fits], j])
            scores.append(score[fits])
            rows.append(ids[fits])
        g, s, r = np.concatenate(groups), np.concatenate(scores), np.concatenate(rows)
        best = first_of_groups(g, s, r, self.k)
        self.found = g, s, r = g[best], s[best], r[best]
        # a full slot needs at least its last score
        count, last = np.bincount(g, minlength=len(self.owner)), np.full(len(self.owner) + 1, np.inf)
        np.minimum.at(last, g, s)
        full = np.append(count >= self.k, False)
        last = np.where(full, last, -np.inf)
        self.least = np.maximum(self.least, last[self.slot])


def _search(rows: DataFrame, block: list, slots: list, bits: int, width: int, same: bool, k: int) -> DataFrame:
    """(slot, score, vec_id): every task's first k rows of each slot. block: (vec_id, label, vector) of anchors, slots: (place in block, lo, hi)."""
    ids, labels = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.int64)
    anchors = np.zeros((len(block), width), np.int64)
    for i, r in enumerate(block):
        anchors[i, : len(r[2])] = r[2]
    owner, lo, hi = (np.array([s[j] for s in slots]) for j in range(3))
    sent = rows.sparkSession.sparkContext.broadcast((anchors, ids, labels, (owner, lo, hi)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, ids, labels, slots = sent.value
        planes = Planes(anchors, ids, labels, slots, bits, same, k)
        held: list[tuple] = []

        def flush():
            if held:
                planes.add(*(np.concatenate(c) for c in zip(*held)))
                held.clear()

        step = max(64, PAIRS // max(1, len(ids)))
        for b in batches:
            for i in range(0, b.num_rows, step):
                c = b.slice(i, step)
                held.append((c.column(0).to_numpy(), c.column(1).to_numpy(), matrix(c.column(2), width)))
                if sum(len(h[0]) for h in held) >= step:
                    flush()
        flush()
        g, s, r = planes.found
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s.astype(np.int64)), pa.array(r)], names=["slot", "score", "vec_id"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, "slot long, score long, vec_id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first rows of its label; the negatives of a positive are the first rows of other labels whose scores are
    from `least` to `most` percent of the positive's. Higher scores come first, ties by smaller id; scores are exact. See `prepared` for the rows that take part;
    vectors of different lengths count as ending in zeros. An anchor without positives, and a positive without negatives, has no rows;
    an empty table gives an empty result. Scores that could pass 2**53 are an error.

    Rows are read twice a block of anchors: once for positives, once for negatives within the bounds that the positives set.
    """
    spark = rows.sparkSession
    rows = stored(prepared(rows), "vectors")
    low, high, width = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector")), F.max(F.size("vector"))).first()
    bits = max(int(max(high or 0, -1 - (low or 0))).bit_length() + 1, 2)
    width = max(width or 0, 1)
    per = max(1, block_bytes // (8 * width + 24 * (positives + 1)))
    count = rows.where(is_anchor).count()
    n_blocks = -(-count // per)
    # by hash of the id: blocks of about equal numbers
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_blocks)))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = None
    for b in range(n_blocks):
        block = [tuple(r) for r in rows.where(is_anchor & (block_of == b)).select("vec_id", "label", "vector").collect()]
        if not block:
            continue
        everything = [(i, -np.inf, np.inf) for i in range(len(block))]
        best = _first(_search(rows, block, everything, bits, width, True, positives), positives)
        found = sorted((r["slot"], r["rank"], r["vec_id"], r["score"]) for r in best.collect())  # at most `positives` an anchor of the block
        slots = [(a, -(-least * s // 100), most * s // 100) for a, _, _, s in found]
        near = _first(_search(rows, block, slots, bits, width, False, negatives), negatives)
        names = spark.createDataFrame([(j, block[a][0], p, s) for j, (a, _, p, s) in enumerate(found)], "slot long, anchor_id long, positive_id long, positive_score long")
        near = near.join(F.broadcast(names), "slot").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        near = stored(near, "negatives")
        out = near if out is None else out.unionByName(near)
    return spark.createDataFrame([], schema) if out is None else out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
