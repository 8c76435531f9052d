"""Benchmark decontamination: SimHash of item-sized windows, found through a multi-index of Hamming blocks, verified exactly.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; shingles are K consecutive words (an item with
fewer words is one shingle). A shingle weighs log((items + 1) / (items with it + 1/2)), counted over the whole benchmark. The
similarity of a window of a document to an item of as many words is the weight of the item's distinct shingles that the
window holds, as a share of the item's weight, and must be at least SIMILARITY.

A window of n words is seen through the shingles of items of n words; others weigh nothing there. Its fingerprint has BITS
bits, the signs of the sums of sqrt(weight) x a random number over its distinct shingles. So a window that holds the share s
of an item's weight and no shingle of another item of that size has the cosine sqrt(s) to the item: at 0.8 a bit differs
with probability 0.148, 151 +- 11 of 1024, and RADIUS 191 loses a window at the limit with probability under 3e-4. The index cuts fingerprints
into BITS / BLOCK blocks; within RADIUS some block differs in at most FLIPS bits (pigeonhole), so looking up every block's
neighbours within FLIPS bits finds all fingerprints within RADIUS. Candidates found so are verified on all windows of
the document: a shingle counts for the windows that start after its previous occurrence and hold it, so a running sum over these
ranges has the exact similarity of every window. The fingerprints of a document's windows are running sums over the same ranges.

Only the benchmark is sent to the executors, in blocks of bounded text and number of items; documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix, stored, table, text_buffer, words

K = 5
SIMILARITY = 0.8
BITS, BLOCK, FLIPS = 1024, 16, 2
RADIUS = BITS // BLOCK * (FLIPS + 1) - 1
#: UTF-8 bytes of benchmark texts and items in one block that is broadcast: some 500 bytes of index an item, 20 a shingle.
BLOCK_BYTES, BLOCK_ITEMS = 16 << 20, 200_000
#: Bits of the sieve through which documents go once if there are several blocks.
SIEVE = 1 << 25

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TURN = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
_SEEDS = mix(np.arange(1, BITS // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: All words of BLOCK bits with at most FLIPS ones.
_NEAR = np.array([x for x in range(1 << BLOCK) if x.bit_count() <= FLIPS], np.int64)


def _combined(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; near the end of a row they run into the next one."""
    total = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k):
        total += h[j : j + len(total)] * _TURN[j]
    return mix(total)


def _numbers(h: np.ndarray) -> np.ndarray:
    """BITS random numbers for each shingle, alike on both sides of 0."""
    return mix(h[:, None] ^ _SEEDS[None, :]).view(np.int8).reshape(len(h), BITS) + 0.5


def _signs(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def fingerprint(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS)
    for lo in range(0, len(h), 512):  # a long item has many shingles
        total += np.sqrt(weight[lo : lo + 512]) @ _numbers(h[lo : lo + 512])
    return _signs(total[None, :])[0]


def _in(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the members of x are in an ascending array, and where."""
    if not len(sorted_):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x, at


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each range of `many` places."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())


def _distinct(place: np.ndarray, x: np.ndarray, span: int, last_start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, from, to): the starts of windows of `span` places that hold x at this place and not at an earlier one."""
    order = np.argsort(x, kind="stable")
    again = x[order][1:] == x[order][:-1]
    before = np.full(len(place), -1)  # where the same one stood last
    before[order[1:][again]] = place[order[:-1][again]]
    lo, hi = np.maximum(before + 1, np.maximum(place - span + 1, 0)), np.minimum(place, last_start)
    which = np.flatnonzero(lo <= hi)
    return which, lo[which], hi[which]


class Multi:
    """Fingerprints by the values of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = prints.view(np.uint16).reshape(len(prints), BITS // BLOCK)
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).copy()
        self.first = np.stack([np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << BLOCK))]) for v in values.T]).astype(np.int32)
        self.within = lru_cache(1 << 13)(self._within)

    def _within(self, one: bytes) -> np.ndarray:
        """All fingerprints at most RADIUS bits away."""
        p = np.frombuffer(one, np.uint64)
        cell = np.frombuffer(one, np.uint16).astype(np.int64)[:, None] ^ _NEAR[None, :]
        block = np.arange(BITS // BLOCK)[:, None]
        lo = self.first[block, cell]
        many = self.first[block, cell + 1] - lo
        b, c = np.nonzero(many)
        lo, many = lo[b, c].astype(np.int64), many[b, c].astype(np.int64)
        found = np.unique(self.order[np.repeat(b, many), _spread(lo, many)])
        return found[np.bitwise_count(self.prints[found] ^ p).sum(1) <= RADIUS]


class Index:
    """Items of one block of the benchmark. Items of one size with the same shingles are one entry.

    keys: shingles in ascending order, with weights and the sizes (numbers of words) of items that hold them.
    """

    def __init__(self, ids: list, n: np.ndarray, sets: list[np.ndarray], prints: np.ndarray, keys: np.ndarray, weight: np.ndarray, k: int = K):
        entry: dict[tuple[int, bytes], int] = {}
        self.k, self.ids, first = k, [], []
        for i, (size, s) in enumerate(zip(n.tolist(), sets)):
            e = entry.setdefault((size, s.tobytes()), len(entry))
            if e == len(first):
                first.append(i)
                self.ids.append([])
            self.ids[e].append(ids[i])
        self.keys, self.weight, self.n = keys, weight, n[first].astype(np.int64)
        self.prints = prints[first].reshape(-1, BITS // 64)
        own = [np.searchsorted(keys, sets[i]) for i in first]
        self.bound = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        self.own = np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int32)
        self._ready()

    def __getstate__(self) -> dict:
        return {x: getattr(self, x) for x in ("k", "ids", "keys", "weight", "n", "prints", "bound", "own")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def _ready(self) -> None:
        """What follows from the entries is made where it is used."""
        size = np.repeat(self.n, np.diff(self.bound))
        self.sizes, code = np.unique(size, return_inverse=True)
        pair = np.unique(self.own.astype(np.int64) * max(1, len(self.sizes)) + code)
        self.of_key, self.size_of = pair // max(1, len(self.sizes)), (pair % max(1, len(self.sizes))).astype(np.int32)
        self.first_size = np.searchsorted(self.of_key, np.arange(len(self.keys) + 1))
        self.whole = np.add.reduceat(self.weight[self.own], self.bound[:-1]) if len(self.n) else np.zeros(0)
        self.least = np.full(len(self.sizes), np.inf)
        np.minimum.at(self.least, np.searchsorted(self.sizes, self.n), self.whole)
        self.lengths = sorted({min(self.k, x) for x in self.sizes.tolist()})  # of shingles
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys & np.uint64((1 << 20) - 1)] = True
        self.multi = Multi(self.prints)

    @classmethod
    def of(cls, ids: list, texts: list[str | None], k: int = K) -> Index:
        """The index of a whole small benchmark in one place."""
        found = [(i, n, s) for i, (n, s) in zip(ids, item_sets(pa.array(texts, pa.string()), k)) if n]
        keys, df = np.unique(np.concatenate([*(s for _, _, s in found), np.zeros(0, np.uint64)]), return_counts=True)
        weight = _weight(df, len(found))
        prints = np.array([fingerprint(s, weight[np.searchsorted(keys, s)]) for _, _, s in found], np.uint64)
        return cls([i for i, _, _ in found], np.array([n for _, n, _ in found], np.int64), [s for _, _, s in found], prints, keys, weight, k)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that hold a shingle of some item, and which."""
        at = np.flatnonzero(self.sieve[h & np.uint64((1 << 20) - 1)])
        ok, key = _in(self.keys, h[at])
        return at[ok], key[ok]

    def windows(self, place: np.ndarray, key: np.ndarray, size: int, n_words: int, k: int, least: float) -> np.ndarray:
        """Distinct fingerprints of the windows of a row that hold weight enough for the lightest item of this size."""
        span = min(int(self.sizes[size]), n_words) - k + 1
        which, lo, hi = _distinct(place, key, span, n_words - k + 1 - span)
        edge = np.concatenate([lo, hi + 1])
        order = np.argsort(edge, kind="stable")
        edge, which = edge[order], np.concatenate([which, which])[order]
        gone = order >= len(lo)
        w = self.weight[key[which]]
        held = np.cumsum(np.where(gone, -w, w))
        last = np.append(edge[1:] != edge[:-1], True)  # all changes of a start are in
        enough = last & (held >= least * self.least[size] * (1 - 1e-9) - 1e-9)
        if not enough.any():
            return np.zeros((0, BITS // 64), np.uint64)
        out, total = [], np.zeros(BITS)
        end = int(np.flatnonzero(enough)[-1]) + 1
        for a in range(0, end, 1024):
            part = slice(a, min(a + 1024, end))
            step = _numbers(self.keys[key[which[part]]])
            step *= np.where(gone[part], -1, 1)[:, None] * np.sqrt(w[part])[:, None]
            step[0] += total
            np.cumsum(step, axis=0, out=step)
            total = step[-1].copy()
            out.append(_signs(step[enough[part]]))
        return np.unique(np.concatenate(out), axis=0)

    def best(self, place: np.ndarray, key: np.ndarray, n_words: int, k: int, e: int, least: float) -> tuple[int, float] | None:
        """The window of the entry's size that is most similar (the first among equals), if it is similar enough.

        place, key: where a row holds shingles of the benchmark, in ascending order, and which.
        """
        own = self.own[self.bound[e] : self.bound[e + 1]]
        ok, _ = _in(own, key)
        place, key = place[ok], key[ok]
        span = min(int(self.n[e]), n_words) - k + 1
        which, lo, hi = _distinct(place, key, span, n_words - k + 1 - span)
        if not len(which):
            return None
        w = self.weight[key[which]]
        start, at = np.unique(np.concatenate([lo, hi + 1]), return_inverse=True)
        total = np.cumsum(np.bincount(at, np.concatenate([w, -w])))
        first = int(start[np.flatnonzero(total >= total.max() - 1e-9 * self.whole[e])[0]])
        inside = np.unique(key[(place >= first) & (place < first + span)])
        sim = float(self.weight[inside].sum()) / float(self.whole[e])
        return (first, sim) if sim >= least - 1e-9 else None

    def find(self, column: pa.Array, least: float) -> Iterator[tuple[int, int, int, float]]:
        """(row, item id, first word, similarity) of every row and item with a window that is similar enough."""
        whole, whole_at = text_buffer(column)
        for lo, hi in blocks(whole_at) if len(self.n) else ():
            buf, at = whole[whole_at[lo] : whole_at[hi]], whole_at[lo : hi + 1] - whole_at[lo]
            _, _, word, bound = words(buf, at, solid=_ALNUM)
            for k in self.lengths:
                p, key = self.hits(_combined(word, k))
                row = np.searchsorted(bound, p, "right") - 1
                inside = p + k <= bound[row + 1]
                p, key, row = p[inside], key[inside], row[inside]
                # every hit under the sizes of the items that hold it
                many = self.first_size[key + 1] - self.first_size[key]
                hit, size = np.repeat(np.arange(len(p)), many), self.size_of[_spread(self.first_size[key], many)]
                fits = np.minimum(self.sizes[size], self.k) == k
                hit, size = hit[fits], size[fits]
                order = np.lexsort((hit, size, row[hit]))
                hit, size = hit[order], size[order]
                group = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (row[hit][1:] != row[hit][:-1])])) if len(hit) else np.zeros(0, np.int64)
                weight = np.add.reduceat(self.weight[key[hit]], group) if len(group) else np.zeros(0)
                end = np.append(group[1:], len(hit))
                for g in np.flatnonzero(weight >= least * self.least[size[group]] * (1 - 1e-9) - 1e-9).tolist():
                    mine = hit[group[g] : end[g]]
                    r, s = int(row[mine[0]]), int(size[group[g]])
                    place, own, n_words = p[mine] - int(bound[r]), key[mine], int(bound[r + 1] - bound[r])
                    near = self.windows(place, own, s, n_words, k, least)
                    for e in sorted({e for x in near for e in self.multi.within(x.tobytes()).tolist() if self.n[e] == self.sizes[s]}):
                        got = self.best(place, own, n_words, k, e, least)
                        if got:
                            for i in self.ids[e]:
                                yield lo + r, i, got[0], got[1]


def item_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and ascending distinct shingles of every item."""
    buf, at = text_buffer(column)
    _, _, h, bound = words(buf, at, solid=_ALNUM)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        yield b - a, np.unique(_combined(h[a:b], min(k, b - a))) if b > a else np.zeros(0, np.uint64)


def _weight(df: np.ndarray, items: int) -> np.ndarray:
    return np.log((items + 1) / (df + 0.5))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sets = zip(*found) if (found := list(item_sets(b.column("text"), k))) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(n, pa.int32()), _lists(sets)], ["item_id", "n", "shingles"])

    return run


def _shingles(b: pa.RecordBatch) -> list[np.ndarray]:
    at, flat = b.column("shingles").offsets.to_numpy(), b.column("shingles").values.to_numpy().view(np.uint64)
    return [flat[x:y] for x, y in zip(at[:-1], at[1:])]


def _printed(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weight = known.value
        for b in batches:
            prints = [fingerprint(s, weight[np.searchsorted(keys, s)]).tobytes() for s in _shingles(b)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("n"), b.column("shingles"), pa.array(prints, pa.binary())], ["item_id", "n", "shingles", "print"])

    return run


def _indexes(benchmark: DataFrame, k: int) -> tuple[int, Iterator]:
    """The number of blocks, and one broadcast Index after the other.

    Shingles are counted over the whole benchmark by an aggregation, fingerprints are made in tasks; the driver holds one block at a time.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, -(-(size[0] or 0) // BLOCK_BYTES), -(-size[1] // BLOCK_ITEMS))
    sets = stored(items.mapInArrow(_sets(k), "item_id long, n int, shingles array<long>").where("n > 0"), "items")
    total = sets.count()
    df = stored(sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df")), "shingles")

    def built() -> Iterator:
        for i in range(n):
            mine = sets.where(F.pmod(F.xxhash64("item_id", "n", "shingles"), F.lit(n)) == i)
            here = df if n == 1 else df.join(mine.select(F.explode("shingles").alias("shingle")).distinct(), "shingle", "left_semi")
            t = here.toArrow()
            h = t.column("shingle").to_numpy().view(np.uint64)
            order = np.argsort(h)
            keys, weight = h[order], _weight(t.column("df").to_numpy()[order], total)
            known = spark.sparkContext.broadcast((keys, weight))
            rows = mine.mapInArrow(_printed(known), "item_id long, n int, shingles array<long>, print binary").toArrow()
            known.unpersist()
            parts = rows.to_batches()
            own = [s for b in parts for s in _shingles(b)]
            prints = np.frombuffer(b"".join(x for b in parts for x in b.column("print").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            yield spark.sparkContext.broadcast(Index(rows.column("item_id").to_pylist(), rows.column("n").to_numpy().astype(np.int64), own, prints, keys, weight, k))

    return n, built()


def _found(index, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, item, start, sim = zip(*found) if (found := list(index.value.find(b.column("text"), least))) else ([],) * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(sim, pa.float64())], ["doc_id", "item_id", "first_word", "similarity"])

    return run


def _clean(index, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = np.ones(len(b), bool)
            clean[[row for row, *_ in index.value.find(b.column("text"), least)]] = False
            yield b.filter(pa.array(clean))

    return run


def _holding(sieve, lengths: list[int], some: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for b in batches:
            hold = np.zeros(len(b), bool)
            whole, whole_at = text_buffer(b.column("text"))
            for lo, hi in blocks(whole_at):
                _, _, word, bound = words(whole[whole_at[lo] : whole_at[hi]], whole_at[lo : hi + 1] - whole_at[lo], solid=_ALNUM)
                for k in lengths:
                    h = _combined(word, k) & np.uint64(SIEVE - 1)
                    p = np.flatnonzero(bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1)
                    row = np.searchsorted(bound, p, "right") - 1
                    hold[lo + row[p + k <= bound[row + 1]]] = True
            yield b.filter(pa.array(hold == some))

    return run


def _sieve(benchmark: DataFrame, k: int):
    """A bit for every shingle of the whole benchmark, of a fixed size."""
    bits = np.zeros(SIEVE // 8, np.uint8)
    lengths: set[int] = set()
    sets = benchmark.select("item_id", "text").mapInArrow(_sets(k), "item_id long, n int, shingles array<long>").where("n > 0")
    held = sets.select(F.least("n", F.lit(k)).alias("k"), F.explode("shingles").alias("h"))
    held = held.selectExpr("k", f"shiftright(h & {SIEVE - 1}, 3) AS byte", "shiftleft(1, CAST(h & 7 AS INT)) AS bit").groupBy("k", "byte").agg(F.bit_or("bit").alias("bit"))
    for b in held.toArrow().to_batches():
        np.bitwise_or.at(bits, b.column("byte").to_numpy(), b.column("bit").to_numpy().astype(np.uint8))
        lengths |= set(b.column("k").to_pylist())
    return benchmark.sparkSession.sparkContext.broadcast(bits), sorted(lengths)


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_word, similarity of every document and item with a similar window: the best window's, the first
    among equals.

    A document shorter than the item is one window. Null or empty texts and items have no windows. Repeated documents and
    repeated items give a row for each pair. Very long texts are worked on in one piece, with memory in proportion to the text.
    Extra columns are not read. An empty benchmark or an empty table gives no rows.
    """
    d = docs.select("doc_id", "text")
    n, indexes = _indexes(benchmark, k)
    kind = "doc_id long, item_id long, first_word long, similarity double"
    if n == 1:
        return d.mapInArrow(_found(next(indexes), least), kind)
    # several blocks: documents are read once, those with any shingle of the benchmark go on
    d, out = stored(d.mapInArrow(_holding(*_sieve(benchmark, k), True), d.schema), "suspects"), []
    for index in indexes:
        out.append(stored(d.mapInArrow(_found(index, least), kind), "leaks"))
        index.unpersist()
    return reduce(DataFrame.unionByName, out)


def keep(docs: DataFrame, benchmark: DataFrame, k: int = K, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs without a leak, with all their columns; rows with a null or empty text stay."""
    n, indexes = _indexes(benchmark, k)
    if n == 1:
        return docs.mapInArrow(_clean(next(indexes), least), docs.schema)
    sieve, lengths = _sieve(benchmark, k)
    d = stored(docs.mapInArrow(_holding(sieve, lengths, True), docs.schema), "suspects")
    for index in indexes:
        d = stored(d.mapInArrow(_clean(index, least), docs.schema), "suspects")
        index.unpersist()
    return docs.mapInArrow(_holding(sieve, lengths, False), docs.schema).unionByName(d)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
