"""Polygon overlay and union as joins over edges.

Edges of the polygons of a group are split where they meet (an equi-join on grid cells), pieces of edges that coincide are
counted together, and each one is labelled with the polygons on its left and on its right: those it bounds itself, and those
that hold its middle (a join with the polygons' quadtree pieces). An edge bounds the result if the result lies on one side
only. No row carries a polygon before the result's edges are traced into rings, group by group, holes in their shells.

Coordinates that are given stay as they are; crossings are rounded once, the same for both edges. Areas that coincide but for
rounding may leave slivers, which are dropped below an area.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolake.functions import arrange, kernels, wkb
from geolake.sources.shared import stored

from .pieces import ORIGIN, edges_in, merged, met_blocks, points_in, subdivide
from .spatial_join import overlap_join

#: Rings of a smaller area (in square units of the coordinates) are rounding's.
SLIVER = 1e-12
_XY = ("x1", "y1", "x2", "y2")


def edges_of(areas: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """(key, x1, y1, x2, y2): the edges of a WKB column's polygons, the area on their left, whichever way the rings turn. Null geometries have none."""
    schema = areas.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [np.zeros(0, np.int64)], [np.zeros((0, 4))]
            for some, rings in arrange.alike(b.column(1)):
                if rings is None:
                    rings = [(np.asarray(r, float).reshape(1, -1, 2), k > 0) for p in kernels.polygons(*wkb.loads(b.column(1)[some[0]].as_py())) for k, r in enumerate(p)]
                for p in arrange.oriented(rings):
                    rows.append(np.concatenate([p[:, :-1], p[:, 1:]], 2).reshape(-1, 4))
                    at.append(np.repeat(some, p.shape[1] - 1))
            e, at = np.concatenate(rows), np.concatenate(at)
            keep = (e[:, :2] != e[:, 2:]).any(1)
            e, at = e[keep], at[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(e[:, k]) for k in range(4))], [key, *_XY])

    return areas.select(key, geometry).mapInArrow(run, f"`{key}` {schema}, x1 double, y1 double, x2 double, y2 double")


def _turn(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _within(p: Column, a: Column, b: Column) -> Column:
    """Whether p, on the line of a segment, is inside the segment."""
    in_box = p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    return (_turn(a, b, p) == 0) & in_box & (p != a) & (p != b)


def _cuts(pairs: DataFrame) -> DataFrame:
    """(group, s, p): where the segments s of pairs (group, s, t), of ends (u, v), are split by t: at t's ends or where they cross."""
    # in one order, so that both segments of a crossing take the same point; step by step, so that no expression is repeated
    d = pairs.withColumn("one", F.least("s", "t")).withColumn("two", F.greatest("s", "t"))
    one, two, s, t = (F.col(c) for c in ("one", "two", "s", "t"))
    d = d.withColumns({"a": _turn(two["u"], two["v"], one["u"]), "b": _turn(two["u"], two["v"], one["v"]), "c": _turn(one["u"], one["v"], two["u"]), "d": _turn(one["u"], one["v"], two["v"])})
    d = d.withColumn("w", F.when((F.signum("a") * F.signum("b") < 0) & (F.signum("c") * F.signum("d") < 0), F.col("a") / (F.col("a") - F.col("b"))))
    cross = F.struct(*((one["u"][k] + F.col("w") * (one["v"][k] - one["u"][k])).alias(k) for k in "xy"))
    found = F.array(F.when(F.col("w").isNotNull(), cross), F.when(_within(t["u"], s["u"], s["v"]), t["u"]), F.when(_within(t["v"], s["u"], s["v"]), t["v"]))
    return d.select("group", "s", F.explode(found).alias("p")).where("p is not null")


def _box(u: Column, v: Column) -> Column:
    return F.struct(*(f(u[k], v[k]).alias(f"{k}{n}") for n, f in (("min", F.least), ("max", F.greatest)) for k in "xy"))


def noded(edges: DataFrame) -> DataFrame:
    """(group, u, v, poly, layer, turn): edges (group, poly, layer, x1..y2) split where those of a group meet.

    u, v: ends in ascending order; turn: 1 if the polygon lies left of the way from u to v, else -1.
    """
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    owned = stored(edges.select("group", "poly", "layer", F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")).alias("s"), F.when(p < q, 1).otherwise(-1).alias("turn")), "edges")
    lines = owned.select("group", "s").distinct().withColumn("box", _box(F.col("s.u"), F.col("s.v")))
    other = lines.select(F.col("group").alias("g2"), F.col("s").alias("t"), F.col("box").alias("box2"))
    met = overlap_join(lines, other, "box", "box2", on=(("group", "g2"),)).where("s != t").select("group", "s", "t")
    met = _cuts(met).groupBy("group", "s").agg(F.collect_set("p").alias("cuts"))
    along = lambda p: (p["x"] - F.col("s.u.x")) * (F.col("s.v.x") - F.col("s.u.x")) + (p["y"] - F.col("s.u.y")) * (F.col("s.v.y") - F.col("s.u.y"))
    inner = F.transform(F.array_sort(F.transform(F.coalesce("cuts", F.array()), lambda p: F.struct(along(p).alias("t"), p.alias("p")))), lambda c: c["p"])
    path = owned.join(met, ["group", "s"], "left").withColumn("path", F.concat(F.array("s.u"), F.when(F.col("cuts").isNotNull(), inner).otherwise(F.array_repeat(F.col("s.u"), 0)), F.array("s.v")))
    path = path.select("group", "poly", "layer", "turn", "path", F.posexplode(F.slice("path", F.lit(2), F.size("path"))).alias("k", "b"))
    path = path.withColumn("a", F.get("path", F.col("k"))).where("a != b")
    return path.select("group", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "poly", "layer", (F.col("turn") * F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("turn"))


def outline(edges: DataFrame, holders: list[tuple[DataFrame, int]], inside: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, x1, y1, x2, y2): the edges that bound what `inside` (of the numbers of polygons of the layers 0 and 1 that hold a place) takes in, on their left.

    edges: as in noded; holders: for each layer pieces (poly, cell, inside, corner, edges), as from subdivide or merged, either of all groups or with the group
    that each one counts for as g2: then places meet the pieces of their own group only, however many other groups lie there.
    """
    parts = stored(noded(edges), "parts")
    own = parts.groupBy("group", "u", "v").agg(
        *(F.count_if((F.col("layer") == k) & (F.col("turn") == t)).alias(f"{side}{k}") for k in (0, 1) for t, side in ((1, "left"), (-1, "right"))), F.collect_set("poly").alias("own")
    )
    own = stored(own.withColumn("mx", (F.col("u.x") + F.col("v.x")) / 2).withColumn("my", (F.col("u.y") + F.col("v.y")) / 2), "sides")
    held = None
    for pieces, layer in holders:
        on = (("group", "g2"),) if "g2" in pieces.columns else ()
        found = points_in(own.select("group", "u", "v", "own", "mx", "my"), pieces.hint("merge"), "mx", "my", boundary=False, on=on)
        found = found.where(~F.coalesce(F.array_contains("own", F.col("poly")), F.lit(False))).select("group", "u", "v", F.lit(layer).alias("layer"))
        held = found if held is None else held.unionByName(found)
    held = held.groupBy("group", "u", "v").agg(*(F.count_if(F.col("layer") == k).alias(f"more{k}") for k in (0, 1)))
    both = own.join(held.hint("merge"), ["group", "u", "v"], "left").fillna(0, ["more0", "more1"])
    left, right = (inside(*(F.col(f"{side}{k}") + F.col(f"more{k}") for k in (0, 1))) for side in ("left", "right"))
    both = both.select("group", "u", "v", left.alias("l"), right.alias("r")).where("l != r")
    start, end = F.when(F.col("l"), F.col("u")).otherwise(F.col("v")), F.when(F.col("l"), F.col("v")).otherwise(F.col("u"))
    return both.select("group", start["x"].alias("x1"), start["y"].alias("y1"), end["x"].alias("x2"), end["y"].alias("y2"))


def exposed(edges: DataFrame, covers: DataFrame) -> DataFrame:
    """The edges of polygons that don't lie wholly in cells that one polygon fills; covers: the merged pieces of the same polygons. What the polygons take in
    together has no border in such a cell, so the others bound nothing, nor do places where edges meet there."""
    near = edges_in(covers).select(F.col("poly").alias("p2"), F.least(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))).alias("s"),
                                   F.greatest(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))).alias("t"))
    p, q = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2))
    return edges.withColumn("s1", F.least(p, q)).withColumn("t1", F.greatest(p, q)).join(near.hint("merge"), (F.col("poly") == F.col("p2")) & (F.col("s1") == F.col("s")) & (F.col("t1") == F.col("t")), "left_semi").drop("s1", "t1")


def trace(edges: np.ndarray, sliver: float = SLIVER) -> tuple[str, list, int]:
    """Directed edges with the area on their left as (kind, coordinates, edges that close no ring).

    At a place where several edges begin the leftmost one is taken, so that areas that touch in a corner stay apart; a ring that
    comes back to a place is cut there, so that a hole that touches its shell is a hole.
    """
    out: dict[tuple, list[tuple]] = defaultdict(list)
    for x1, y1, x2, y2 in edges.tolist():
        out[x1, y1].append((x2, y2))
    rings, lost = [], 0
    for begin in sorted(out):
        while out[begin]:
            path, seen = [begin], {begin: 0}
            step = min(out[begin])
            out[begin].remove(step)
            while True:
                path.append(step)
                if step in seen:  # the loop since then is a ring
                    k = seen[step]
                    rings.append(path[k:])
                    for p in path[k + 1 :]:
                        seen.pop(p, None)
                    path = path[: k + 1]
                    seen[step] = k
                    if k == 0:
                        break
                else:
                    seen[step] = len(path) - 1
                here = path[-1]
                choices = out.get(here)
                if not choices:
                    lost += len(path) - 1
                    break
                if len(choices) == 1:
                    step = choices.pop()
                    continue
                back = math.atan2(path[-2][1] - here[1], path[-2][0] - here[0]) if len(path) > 1 else 0.0
                # the first one clockwise from where the path came from
                step = min(choices, key=lambda q: ((back - math.atan2(q[1] - here[1], q[0] - here[0])) % (2 * math.pi) or 2 * math.pi, q))
                choices.remove(step)
    sized = [(kernels.signed_area(r), r) for r in rings]
    shells = [[r] for a, r in sorted(sized, key=lambda x: (-x[0], x[1])) if a > sliver]
    holes = [r for a, r in sized if a < -sliver]
    for r, k in zip(holes, _shells_around(holes, [shell[0] for shell in shells])):
        if k >= 0:
            shells[k].append(r)
    return ("Polygon", shells[0], lost) if len(shells) == 1 else ("MultiPolygon", shells, lost)


def _shells_around(holes: list, shells: list) -> np.ndarray:
    """For each hole the last of the shells (which come by falling area) that hold the middle of its longest edge, or -1.

    Shells' edges are dealt into strips along y, so a hole is held against those of its own strip only.
    """
    found = np.full(len(holes), -1)
    if not holes or not shells:
        return found
    e = np.concatenate([np.hstack([np.asarray(r)[:-1], np.asarray(r)[1:]]) for r in shells])
    of = np.repeat(np.arange(len(shells)), [len(r) - 1 for r in shells])
    spots = []
    for r in holes:
        p = np.asarray(r)
        k = int(np.hypot(*np.diff(p, axis=0).T).argmax())
        spots.append((p[k] + p[k + 1]) / 2)
    x, y = np.array(spots).T
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    n = len(e) // 8 + 1
    strip = lambda v: np.clip(np.floor((v - low.min()) / ((high.max() - low.min()) or 1.0) * n), 0, n - 1).astype(int)
    first, size = strip(low), strip(high) - strip(low) + 1
    row = np.repeat(np.arange(len(e)), size)
    at = arrange.ranges(first, size)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    begin, end = np.searchsorted(at, strip(y)), np.searchsorted(at, strip(y), "right")
    for part in arrange.blocks(end - begin):
        h, k = np.repeat(np.arange(part.start, part.stop), (end - begin)[part]), row[arrange.ranges(begin[part], (end - begin)[part])]
        ax, ay, bx, by = e[k].T
        turn = (bx - ax) * (y[h] - ay) - (by - ay) * (x[h] - ax)
        crossed = ((ay > y[h]) != (by > y[h])) & (turn != 0) & ((turn > 0) == (by > ay))
        key, times = np.unique(h[crossed] * len(shells) + of[k[crossed]], return_counts=True)
        key = key[times % 2 == 1]
        np.maximum.at(found, key // len(shells), key % len(shells))
    return found


def assembled(edges: DataFrame) -> DataFrame:
    """(group, geometry, open): a group's edges as one WKB geometry, traced in one task: no more than the result itself. Groups with nothing but
    slivers have no row; open: edges that rounding left without a ring."""
    schema = edges.schema["group"].dataType.simpleString()
    # the work is not in bytes: partitions that aren't put together
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = edges.repartition(n, "group").groupBy("group").agg(F.collect_list(F.array(*_XY)).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, shapes, lost = [], [], []
            for i, e in enumerate(b.column(1)):
                kind, c, n = trace(e.values.flatten().to_numpy().reshape(-1, 4))
                if c:
                    at.append(i)
                    shapes.append(wkb.dumps(kind, c))
                    lost.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(shapes, pa.binary()), pa.array(lost, pa.int32())], ["group", "geometry", "open"])

    return lists.mapInArrow(run, f"group {schema}, geometry binary, open int")


def _cut(areas: DataFrame, key: str, geometry: str, layer: int) -> tuple[DataFrame, DataFrame]:
    """Edges and pieces under (poly, layer)."""
    poly = F.concat(F.lit(f"{layer}:"), F.col(key).cast("string"))
    d = areas.where(F.col(key).isNotNull() & F.col(geometry).isNotNull()).select(poly.alias("poly"), F.col(geometry).alias("geometry"))
    return stored(edges_of(d, "poly").withColumn("layer", F.lit(layer)), "edges"), stored(subdivide(d, "poly"), "pieces")


#: Groups of more areas than this are looked over for edges that others cover.
CROWDED = 32
#: Edges of a group that is united in a task beside others. Larger ones are united tile by tile, unless an area is wider than so many tiles or has more edges.
GROUP_EDGES, WIDEST, MOST_EDGES = 1 << 8, 4.0, 1 << 12


def union(areas: DataFrame, by: str, key: str = "id", geometry: str = "geometry") -> DataFrame:
    """(by, geometry, open): the union of each group's areas, which may overlap, touch in parts of edges or lie apart. Rows need distinct keys; null groups are left out.

    Small groups are united in tasks, many at once. Of larger groups each tile's task gets all areas that meet an edge of the tile and yields the edges
    whose middles lie there, so no task holds a group before its rings are traced. Groups of areas of very unlike sizes have their edges as rows.
    """
    areas = areas.where(F.col(by).isNotNull() & F.col(key).isNotNull() & F.col(geometry).isNotNull())
    n = int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    outlines = stored(_outlines(areas, by, geometry), "outlines")
    wide = F.greatest(F.col("box.xmax") - F.col("box.xmin"), F.col("box.ymax") - F.col("box.ymin"))
    sizes = outlines.groupBy("group").agg((F.sum(F.size("edges")) / 4).alias("n"), F.max(F.size("edges") / 4).alias("most"), F.max(wide).alias("wide"), F.max("longest").alias("longest"))
    middle = outlines.agg(F.percentile_approx(wide, 0.5)).first()[0]
    tile = 2.0 ** (math.ceil(math.log2(middle)) + 1) if middle else 1.0
    small, even = F.col("n") <= GROUP_EDGES, (F.col("wide") <= WIDEST * tile) & (F.col("longest") <= tile) & (F.col("most") <= MOST_EDGES)
    sizes = stored(sizes.select("group", F.when(small, 0).when(even, 1).otherwise(2).alias("way"), "longest"), "sizes")
    ways = {r.way: r.longest for r in sizes.groupBy("way").agg(F.max("longest").alias("longest")).collect()}
    of = lambda d, way: d if set(ways) == {way} else d.join(sizes.where(F.col("way") == way).select("group").hint("merge"), "group", "left_semi")
    found = []
    if 0 in ways or not ways:
        found.append(_united(of(outlines, 0).repartition(n, "group")))
    if 1 in ways:
        found.append(assembled(_tiled(of(outlines, 1), tile, ways[1])))
    if 2 in ways:
        some = of(areas.select(F.col(by).alias("group"), F.col(key).alias("key"), F.col(geometry).alias("geometry")), 2)
        found.append(_union(some, "group", "key", "geometry"))
    return functools.reduce(DataFrame.unionByName, found).withColumnRenamed("group", by)


def _outlines(areas: DataFrame, by: str, geometry: str) -> DataFrame:
    """(group, box, longest, edges): the edges of each row's polygons as a flat list, their box, and the widest extent of an edge; rows without edges are left out."""
    schema = areas.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = arrange.Shapes.read(b.column(1))
            some = np.flatnonzero(found.n)
            longest = np.maximum.reduceat((found.high - found.low).max(1), found.at[some]) if len(some) else np.zeros(0)
            box = pa.StructArray.from_arrays([pa.array(found.box[some, k]) for k in range(4)], ["xmin", "ymin", "xmax", "ymax"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(4 * found.n[some])]), pa.int32()), pa.array(found.e.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), box, pa.array(longest), lists], ["group", "box", "longest", "edges"])

    return areas.select(by, geometry).mapInArrow(run, f"group {schema}, box struct<xmin:double,ymin:double,xmax:double,ymax:double>, longest double, edges array<double>")


def _shapes_of(lists: pa.ListArray) -> arrange.Shapes:
    return arrange.Shapes(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False) // 4)]))


def _united(outlines: DataFrame) -> DataFrame:
    """union() of groups that a task can hold, from the rows of _outlines."""
    schema = outlines.schema["group"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            every, shapes = lists.value_lengths().to_numpy(zero_copy_only=False), _shapes_of(lists.flatten())
            ends = np.concatenate([[0], np.cumsum(every)])
            for part in arrange.blocks(np.array([(shapes.at[hi] - shapes.at[lo]) ** 2 for lo, hi in zip(ends, ends[1:])])):
                lo, hi = ends[part.start], ends[part.stop]
                of = np.arange(lo, hi)
                group = np.repeat(np.arange(part.start, part.stop), every[part])
                edges = np.arange(shapes.at[lo], shapes.at[hi])
                e, g = arrange.bounding(shapes, of, group, np.zeros(len(of), np.int64), edges, np.repeat(of - lo, shapes.n[of]), lambda one, _: one > 0)
                at, geometry, lost = arrange.polygons(e, g, trace, SLIVER)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), geometry, pa.array(lost, pa.int32())], ["group", "geometry", "open"])

    return outlines.groupBy("group").agg(F.collect_list("edges").alias("edges")).mapInArrow(run, f"group {schema}, geometry binary, open int")


def _tiled(outlines: DataFrame, tile: float, longest: float) -> DataFrame:
    """(group, x1, y1, x2, y2): the directed edges of the union of each group's areas, tile by tile. No edge extends over more than `longest`."""
    schema = outlines.schema["group"].dataType.simpleString()
    d = outlines
    # an area that meets an edge which touches a tile is no further from the tile than the edge extends
    for axis, o in zip("xy", ORIGIN.tolist()):
        cell = lambda v: F.floor((v - F.lit(o)) / F.lit(tile)).cast("long")  # noqa: B023, E731
        d = d.withColumn(f"t{axis}", F.explode(F.sequence(cell(F.col(f"box.{axis}min") - F.lit(longest) * 1.000001), cell(F.col(f"box.{axis}max") + F.lit(longest) * 1.000001))))

    def run(group: tuple, t: pa.Table) -> pa.Table:
        lists = t.column("edges").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        shapes = _shapes_of(lists)
        same = {shapes.e[lo:hi].tobytes(): k for k, (lo, hi) in enumerate(zip(shapes.at, shapes.at[1:]))}  # copies of an area add nothing
        if len(same) < len(t):
            few = np.array(sorted(same.values()))
            shapes = arrange.Shapes(shapes.e[arrange.ranges(shapes.at[few], shapes.n[few])], np.concatenate([[0], np.cumsum(shapes.n[few])]))
        lo = ORIGIN + np.array([group[1].as_py(), group[2].as_py()]) * tile
        hi = ORIGIN + np.array([group[1].as_py() + 1, group[2].as_py() + 1]) * tile
        e = arrange.union_part(shapes, (*lo.tolist(), *hi.tolist()))
        return pa.table({"group": pa.array([group[0].as_py()] * len(e), t.schema.field("group").type), **{c: pa.array(e[:, k]) for k, c in enumerate(_XY)}})

    n = int(outlines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["group", "tx", "ty"]
    return d.select(*names, "edges").repartition(n, *names).groupBy(*names).applyInArrow(run, f"group {schema}, x1 double, y1 double, x2 double, y2 double")


def _union(areas: DataFrame, by: str, key: str, geometry: str) -> DataFrame:
    """(group, geometry, open): union() of groups of any areas, with their edges as rows."""
    edges, pieces = _cut(areas, key, geometry, 0)
    members = areas.select(F.col(by).alias("group"), F.concat(F.lit("0:"), F.col(key).cast("string")).alias("poly"))
    pieces = stored(pieces.join(members.withColumnRenamed("group", "g2").hint("merge"), "poly"), "pieces")
    # only where many areas of a group may cover each other is it worth a look
    crowded = stored(members.groupBy("group").agg(F.count("*").alias("areas")).where(F.col("areas") > CROWDED).select("group"), "crowded")
    edges = edges.join(members.hint("merge"), "poly")
    covers = stored(merged(pieces.join(crowded.hint("merge"), F.col("g2") == F.col("group"), "left_semi"), "g2").drop("g2"), "merged")
    edges = edges.join(crowded.hint("merge"), "group", "left_anti").unionByName(exposed(edges.join(crowded.hint("merge"), "group", "left_semi"), covers))
    return assembled(outline(edges, [(pieces, 0)], lambda a, _: a > 0))


def _near(edges: DataFrame, box: str) -> Column:
    c = lambda f: F.col(f"{box}.{f}")
    return (F.least("x1", "x2") <= c("xmax")) & (F.greatest("x1", "x2") >= c("xmin")) & (F.least("y1", "y2") <= c("ymax")) & (F.greatest("y1", "y2") >= c("ymin"))


def intersection(left: DataFrame, right: DataFrame, key: str = "id", other: str = "other", geometry: str = "geometry", box: str = "bbox") -> DataFrame:
    """(key, other, geometry, open) of every pair of areas that share more than a border. Keys are distinct; boxes are those of the geometries.

    Areas meet in the cells of their boxes. A pair is overlaid in the one cell of its overlap's corner, many pairs at once, and areas of a full cell are
    dealt into blocks: no pair is a row before its result, and a task's memory is bounded. Copies of an area in a block are overlaid once.
    """
    side = lambda d, k, p: stored(d.where(f"{box} is not null and {geometry} is not null").select(F.col(k).alias(f"{p}key"), F.col(box).alias(f"{p}box"), F.col(geometry).alias(f"{p}shape")), "areas")
    l, r = side(left, key, "l"), side(right, other, "r")
    corners = lambda p: F.length(f"{p}shape") / 16
    (le, lone), (re_, rone) = (d.agg(F.max(corners(p)), F.min(corners(p))).first() for d, p in ((l, "l"), (r, "r")))
    schema = f"`{key}` {left.schema[key].dataType.simpleString()}, `{other}` {right.schema[other].dataType.simpleString()}, geometry binary, open int"
    most = PAIR_EDGES

    def meet(group: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({key: pa.array([], a.schema.field("lkey").type), other: pa.array([], b.schema.field("rkey").type), "geometry": pa.array([], pa.binary()), "open": pa.array([], pa.int32())})
        if not len(a) or not len(b):
            return empty

        def read(t: pa.Table, p: str) -> tuple:
            flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            shapes, bounds = flat(t.column(f"{p}shape").combine_chunks()).dictionary_encode(), flat(t.column(f"{p}box").combine_chunks())
            at = np.stack([bounds.field(k).to_numpy(zero_copy_only=False) for k in ("xmin", "ymin", "xmax", "ymax")], 1)
            size = pc.binary_length(shapes.dictionary).to_numpy(zero_copy_only=False) / 16
            return arrange.Shapes.read(shapes.dictionary).split(), shapes.indices.to_numpy(zero_copy_only=False).astype(np.int64), size, at, t.column("fx").to_numpy(), t.column("fy").to_numpy()

        (one, ones, size, box1, fx, fy), (two, twos, size2, box2, gx, gy) = read(a, "l"), read(b, "r")
        x, y = group[1].as_py(), group[2].as_py()
        rows, cols = [], []
        for part in arrange.blocks(np.full(len(a), len(b))):
            p, q = box1[part, None], box2[None]
            near = (p[..., 0] <= q[..., 2]) & (p[..., 2] >= q[..., 0]) & (p[..., 1] <= q[..., 3]) & (p[..., 3] >= q[..., 1])
            near &= (np.maximum(fx[part, None], gx) == x) & (np.maximum(fy[part, None], gy) == y)
            i, j = np.nonzero(near)
            rows.append(i + part.start)
            cols.append(j)
        i, j = np.concatenate(rows), np.concatenate(cols)
        few = size[ones[i]] * size2[twos[j]] <= most
        i, j = i[few], j[few]
        pairs, of = np.unique(ones[i] * len(size2) + twos[j], return_inverse=True)
        at, found, lost = _shared(one, two, pairs // len(size2), pairs % len(size2))
        place = np.full(len(pairs), -1, np.int64)
        place[at] = np.arange(len(at))
        some = place[of] >= 0
        i, j, of = i[some], j[some], place[of[some]]
        return pa.table({key: a.column("lkey").take(pa.array(i)), other: b.column("rkey").take(pa.array(j)), "geometry": found.take(pa.array(of)), "open": pa.array(lost[of])}) if len(i) else empty

    # of the larger areas those that no area is small enough for stay away
    small_l, small_r = l.where(corners("l") * F.lit(rone) <= most), r.where(corners("r") * F.lit(lone) <= most)
    blocks = lambda p, rows, size: F.ceil(F.greatest(F.count("*") / rows, F.sum(F.length(f"{p}shape")) / size))
    parts = [a.cogroup(b).applyInArrow(meet, schema) for a, b in met_blocks(small_l, small_r, blocks("l", 256, 1 << 18), blocks("r", 1024, 1 << 20))]
    if le is not None and re_ is not None and le * re_ > most:
        big_l, big_r = l.where(corners("l") * F.lit(re_) > most), r.where(corners("r") * F.lit(le) > most)
        many = overlap_join(big_l.select("lkey", "lbox", corners("l").alias("le")), big_r.select("rkey", "rbox", corners("r").alias("re")), "lbox", "rbox").where(F.col("le") * F.col("re") > most)
        many = stored(many.select(F.struct(F.col("lkey").alias("l"), F.col("rkey").alias("r")).alias("group"), F.col("lkey").alias("left_key"), F.col("rkey").alias("right_key")), "pairs")
        parts.append(_intersection(many, left, right, key, other, geometry, box))
    return functools.reduce(DataFrame.unionByName, parts)


#: Pairs of areas with at most so many pairs of edges are overlaid in a task, each by itself; edges of the others are rows.
PAIR_EDGES = 1 << 16


def _shared(one: arrange.Shapes, two: arrange.Shapes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(pairs, WKB, open): what areas i of one and j of two share, as noded and outline find it; pairs that share nothing have no row."""
    shapes, at, texts, lost = arrange.Shapes.joined(one, two), [np.zeros(0, np.int64)], [pa.array([], pa.binary())], [np.zeros(0, np.int32)]
    for part in arrange.blocks(one.n[i] + two.n[j], 1 << 15):
        of = np.stack([i[part], len(one.n) + j[part]], 1)
        group, layer, against = np.repeat(np.arange(part.start, part.start + len(of)), 2), np.tile([0, 1], len(of)), of[:, ::-1].ravel()
        of = of.ravel()
        member = np.repeat(np.arange(len(of)), shapes.n[of])
        edges, box = arrange.ranges(shapes.at[of], shapes.n[of]), shapes.box[against[member]]
        # edges off the other area's box bound nothing that both hold
        near = (shapes.low[edges, 0] <= box[:, 2]) & (shapes.high[edges, 0] >= box[:, 0]) & (shapes.low[edges, 1] <= box[:, 3]) & (shapes.high[edges, 1] >= box[:, 1])
        e, g = arrange.bounding(shapes, of, group, layer, edges[near], member[near], lambda a, b: (a > 0) & (b > 0), apart=True)
        for a, b in zip((at, texts, lost), arrange.polygons(e, g, trace, SLIVER)):
            a.append(b)
    return np.concatenate(at), pa.concat_arrays(texts), np.concatenate(lost)


def _intersection(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str, other: str, geometry: str, box: str) -> DataFrame:
    """intersection() of pairs (group, left_key, right_key) of any size, with their edges as rows."""
    l = left.select(F.col(key).alias("left_key"), F.concat(F.lit("0:"), F.col(key).cast("string")).alias("a"), F.col(box).alias("abox"))
    r = right.select(F.col(other).alias("right_key"), F.concat(F.lit("1:"), F.col(other).cast("string")).alias("b"), F.col(box).alias("bbox2"))
    pairs = stored(pairs.join(l, "left_key").join(r, "right_key"), "pairs")
    (le, lp), (re_, rp) = _cut(left.join(pairs.select(F.col("left_key").alias(key)), key, "left_semi"), key, geometry, 0), _cut(right.join(pairs.select(F.col("right_key").alias(other)), other, "left_semi"), other, geometry, 1)
    # of a pair's edges those near the other area: the others bound nothing that both hold
    edges = le.join(pairs.select("group", F.col("a").alias("poly"), "bbox2"), "poly").where(_near(le, "bbox2")).drop("bbox2")
    edges = edges.unionByName(re_.join(pairs.select("group", F.col("b").alias("poly"), "abox"), "poly").where(_near(re_, "abox")).drop("abox"))
    holders = [(p.join(pairs.select(F.col(c).alias("poly"), F.col("group").alias("g2")), "poly"), k) for k, (p, c) in enumerate(((lp, "a"), (rp, "b")))]
    found = assembled(outline(edges, holders, lambda a, b: (a > 0) & (b > 0)))
    return found.select(F.col("group.l").alias(key), F.col("group.r").alias(other), "geometry", "open")


def difference(left: DataFrame, right: DataFrame, key: str = "id", other: str = "other", geometry: str = "geometry", box: str = "bbox") -> DataFrame:
    """(key, geometry, open): each area of left less all areas of right, which may overlap each other; areas of which nothing is left have no row."""
    (le, lp), (re_, rp) = _cut(left, key, geometry, 0), _cut(right, other, geometry, 1)
    wet = stored(merged(rp), "merged")
    own = left.select(F.col(key).alias("group"), F.concat(F.lit("0:"), F.col(key).cast("string")).alias("poly"), F.col(box).alias("abox"))
    # edges of left in a cell that right fills bound nothing
    boxed = lambda d: d.withColumn("ebox", F.struct(F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"), F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax")))
    e, c = (lambda f: F.col(f"ebox.{f}")), (lambda f: F.col(f"cell.{f}"))
    drowned = overlap_join(boxed(le).select("poly", *_XY, "ebox"), wet.where("inside").select("cell").distinct(), "ebox", "cell")
    drowned = drowned.where((e("xmin") >= c("xmin")) & (e("xmax") <= c("xmax")) & (e("ymin") >= c("ymin")) & (e("ymax") <= c("ymax"))).select("poly", *_XY)
    dry = le.join(drowned.hint("merge"), ["poly", *_XY], "left_anti").join(own.drop("abox").hint("merge"), "poly")
    cutting = stored(boxed(exposed(re_, wet)), "cutting")
    cutting = overlap_join(cutting, own.select("group", "abox"), "ebox", "abox").drop("ebox", "abox")
    pieces = lp.join(own.select("poly", F.col("group").alias("g2")).hint("merge"), "poly")
    return assembled(outline(dry.unionByName(cutting), [(pieces, 0), (wet, 1)], lambda a, b: (a > 0) & (b == 0))).withColumnRenamed("group", key)
