"""Line merging as list ranking: lines that follow each other are contracted into chains, however far they reach.

Two lines follow each other where exactly two ends of a group meet. Each line is two arcs, one a direction; an arc's next one
is the other line at its end. Pointers are doubled in rounds (each one an equi-join of all arcs, stored), so a chain of n
lines takes about log2(n) rounds, and every arc learns the end of its chain and how many arcs away it is. Closed chains
have no end: they are cut before the arc with their least id. Only the lines of one chain ever come together, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolake.functions import kernels, wkb
from geolake.sources.shared import stored


def ends_of(lines: DataFrame, group: str, key: str = "id", geometry: str = "geometry") -> DataFrame:
    """(group, key, x1, y1, x2, y2): the ends of LineStrings; other kinds, empty and null ones have no row."""
    kinds = {c: lines.schema[c].dataType.simpleString() for c in (group, key)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *c[0], *c[-1]) for i, g in enumerate(b.column(2).to_pylist()) if g is not None for kind, c in [wkb.loads(g)] if kind == "LineString" and len(c) > 1]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(1, 5))], [group, key, "x1", "y1", "x2", "y2"])

    return lines.select(group, key, geometry).mapInArrow(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, x1 double, y1 double, x2 double, y2 double")


def _arcs(ends: DataFrame, group: str, key: str) -> DataFrame:
    """(arc, next): arc and next are (id, way); next is null at the end of a chain."""
    spot = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    both = [(0, spot("x1", "y1"), spot("x2", "y2")), (1, spot("x2", "y2"), spot("x1", "y1"))]
    rows = [F.struct(F.struct(F.col(key).alias("id"), F.lit(w).alias("way")).alias("arc"), a.alias("a"), b.alias("b")) for w, a, b in both]
    arcs = ends.select(F.col(group).alias("group"), F.inline(F.array(*rows)))
    # at a place where two arcs begin, the one that ends there goes on with the other line's
    meet = arcs.groupBy("group", F.col("a").alias("b")).agg(F.count("*").alias("n"), F.min("arc").alias("one"), F.max("arc").alias("two")).where("n = 2")
    back = lambda arc: F.struct(arc["id"].alias("id"), (1 - arc["way"]).alias("way"))
    arcs = arcs.join(meet, ["group", "b"], "left")
    own = back(F.col("arc"))  # the arc of this line that begins where it ends
    return arcs.select("arc", F.when(own == F.col("one"), F.col("two")).when(own == F.col("two"), F.col("one")).alias("next"))


def _jump(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arc, last, steps) of the arcs of open chains, and (arc, least) of those of closed ones: the least id of their chain."""
    span = stored(arcs.select("arc", "next", F.coalesce("next", "arc").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("arc.id").alias("least")), "arcs")
    # arcs that have not reached an end, and what they have found: on the way, open chains leave and closed ones find their least id,
    # which all their arcs have once no arc finds a lesser one
    going = [F.count("*"), F.sum(F.xxhash64("least").cast("decimal(38,0)"))]
    left = span.where("next is not null").agg(*going).first()
    while left[0]:
        far = span.select(F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("last").alias("last2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"))
        span = span.join(far, "next", "left").select(
            "arc", F.col("next2").alias("next"), F.coalesce("last2", "last").alias("last"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.least("least", "least2").alias("least")
        )
        span = stored(span, "arcs")
        now = span.where("next is not null").agg(*going).first()
        if tuple(now) == tuple(left):
            break
        left = now
    return span.where("next is null").select("arc", "last", "steps"), span.where("next is not null").select("arc", "least")


def chains(ends: DataFrame, group: str, key: str = "id") -> DataFrame:
    """(key, chain, place, way, closed) of every line (group, key, x1, y1, x2, y2): its chain's id, its place in it from 0 and whether it runs backwards (way 1).

    Lines join where exactly two ends of a group meet; with three or more, or at a line's own loop, chains end. A chain's id is the
    least id of its two end lines, or of its lines if closed; an open chain runs from the end line with the lesser (id, way), a closed one begins
    with its least line, forwards. Ids are distinct. Null ends are a place of their own.
    """
    arcs = stored(_arcs(ends, group, key), "arcs")
    open_, closed = _jump(arcs)
    closed = stored(closed, "closed")
    # cut closed chains before the forward arc of the least line, and what runs against it behind its mirror
    cut = arcs.join(closed, "arc").withColumn("next", F.when(~((F.col("next.id") == F.col("least")) & (F.col("next.way") == 0) | (F.col("arc.id") == F.col("least")) & (F.col("arc.way") == 1)), F.col("next")))
    ring, _ = _jump(cut.select("arc", "next"))
    every = stored(open_.withColumn("least", F.lit(None).cast(arcs.schema["arc"].dataType["id"].dataType)).unionByName(ring.join(closed, "arc")), "ranked")
    back = lambda arc: F.struct(arc["id"].alias("id"), (1 - arc["way"]).alias("way"))
    # where the arc's chain begins is the end of the mirrored chain
    mirror = every.select(back(F.col("arc")).alias("arc"), back(F.col("last")).alias("first"), F.col("steps").alias("place"))
    d = every.join(mirror, "arc").withColumn("closed", F.col("least").isNotNull())
    # of the two mirrored chains one
    d = d.where(F.when(F.col("closed"), (F.col("first.id") == F.col("least")) & (F.col("first.way") == 0)).otherwise(F.col("first") < back(F.col("last"))))
    return d.select(F.col("arc.id").alias(key), F.least("first.id", "last.id", "least").alias("chain"), F.col("place"), F.col("arc.way").alias("way"), "closed")


def merged(lines: DataFrame, group: str, key: str = "id", geometry: str = "geometry") -> DataFrame:
    """(group, chain, lines, closed, geometry): LineStrings joined into chains; lines: how many a chain is made of. Other kinds are left out."""
    order = chains(ends_of(lines, group, key, geometry), group, key)
    d = lines.select(group, key, geometry).join(order, key).groupBy(group, "chain").agg(
        F.count("*").alias("lines"), F.max("closed").alias("closed"), F.array_sort(F.collect_list(F.struct("place", "way", F.col(geometry).alias("shape")))).alias("parts")
    )
    kinds = {c: d.schema[c].dataType.simpleString() for c in (group, "chain")}

    def one(parts: list) -> bytes:
        path: list = []
        for p in parts:
            c = wkb.loads(p["shape"])[1]
            c = c[::-1] if p["way"] else c
            path += c[1:] if path else c
        return wkb.dumps("LineString", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([one(p) for p in b.column(4).to_pylist()], pa.binary())], [group, "chain", "lines", "closed", "geometry"])

    return d.mapInArrow(run, f"`{group}` {kinds[group]}, chain {kinds['chain']}, lines long, closed boolean, geometry binary")
