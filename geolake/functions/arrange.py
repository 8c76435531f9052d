"""Many areas' edges at once, in numpy: read from WKB, split where they meet, labelled with what lies on their sides, and joined to rings.

Areas belong to groups, and edges meet those of their own group only; arrays are worked on in blocks, so memory is bounded by the
input and the result. Crossings are rounded as in operators.overlay, so a place is the same whichever way it is found.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import kernels, wkb

#: Pairs of edges, or of places and edges, that are held against each other at once.
BLOCK = 1 << 19


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of each row, `count` numbers, one row after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ascending numbers where its equals begin and end."""
    new = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), a[1:] != a[:-1]]))
    size = np.diff(np.append(new, len(a)))
    return np.repeat(new, size), np.repeat(new + size, size)


def blocks(cost: np.ndarray, most: int | None = None) -> Iterator[slice]:
    """Rows in slices of about so much cost."""
    total, lo = np.cumsum(cost), 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (most or BLOCK), "right")))
        yield slice(lo, hi)
        lo = hi


def _layout(data: bytes, kinds: tuple[int, ...]) -> tuple[list[int], list[tuple[int, int, bool]]] | None:
    """(bytes of counts and kinds, (offset, points, hole) of the rings or lines) of plain little-endian polygons (3, many: 6) or lines (2, many: 5); None: other kinds."""
    head, rings, at = [], [], 0

    def word() -> int:
        nonlocal at
        head.extend(range(at, at + 4))
        at += 4
        return struct.unpack_from("<I", data, at - 4)[0]

    def begin() -> int:
        nonlocal at
        head.append(at)
        at += 1
        return word() if data[at - 1] == 1 else 0

    def part(kind: int) -> None:
        nonlocal at
        for k in range(word() if kind == 3 else 1):
            n = word()
            rings.append((at, n, k > 0))
            at += 16 * n

    kind = begin()
    if kind not in kinds:
        return None
    if kind < 4:
        part(kind)
    else:
        for _ in range(word()):
            if begin() != kind - 3:
                return None
            part(kind - 3)
    return head, rings


def like(shape: tuple[str, list], points: np.ndarray) -> pa.Array:
    """Polygons as WKB with the rings of a sample, from all their points (rows, points, 2)."""
    data, k = np.frombuffer(wkb.dumps(*shape), np.uint8), 0
    out = np.tile(data, (len(points), 1))
    for at, n, _ in _layout(data.tobytes(), (3, 6))[1]:
        out[:, at : at + 16 * n] = np.ascontiguousarray(points[:, k : k + n], "<f8").view(np.uint8).reshape(-1, 16 * n)
        k += n
    return pa.Array.from_buffers(pa.binary(), len(points), [None, pa.py_buffer((np.arange(len(points) + 1) * len(data)).astype(np.int32)), pa.py_buffer(out)])


def alike(column: pa.Array, kinds: tuple[int, ...] = (3, 6)) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, bool]] | None]]:
    """Rows of a binary column with geometries of one layout together, with their rings or lines as (points (rows, n, 2), hole); others than these kinds by themselves, with None.
    Nulls are left out."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = pa.concat_arrays([column.drop_null().cast(pa.large_binary())])
    if not len(column):
        return
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, length = np.frombuffer(column.buffers()[2], np.uint8), np.diff(starts)
    for n in np.unique(length):
        left = np.flatnonzero(length == n)
        for part in blocks(np.full(len(left), max(int(n), 1)), 1 << 24):
            some = left[part]
            raw = data[starts[some][:, None] + np.arange(n)]
            while len(some):
                found = _layout(raw[0].tobytes(), kinds)
                if found is None:
                    yield rows[some[:1]], None
                    some, raw = some[1:], raw[1:]
                    continue
                same = (raw[:, found[0]] == raw[0, found[0]]).all(1)
                yield rows[some[same]], [(np.ascontiguousarray(raw[same, at : at + 16 * k]).view("<f8").reshape(int(same.sum()), k, 2), hole) for at, k, hole in found[1]]
                some, raw = some[~same], raw[~same]


def _signed(p: np.ndarray) -> np.ndarray:
    return (p[:, :-1, 0] * p[:, 1:, 1] - p[:, 1:, 0] * p[:, :-1, 1]).sum(1) / 2 if p.shape[1] > 2 else np.zeros(len(p))


def areas(column: pa.Array) -> np.ndarray:
    """kernels.area of a WKB column; null: NaN."""
    found = np.full(len(column), np.nan)
    for rows, rings in alike(column):
        found[rows] = kernels.area(*wkb.loads(column[rows[0]].as_py())) if rings is None else sum(((-1 if hole else 1) * np.abs(_signed(p)) for p, hole in rings), np.zeros(len(rows)))
    return found


def lengths(column: pa.Array) -> np.ndarray:
    """kernels.length of a WKB column; null: NaN."""
    found = np.full(len(column), np.nan)
    for rows, paths in alike(column, (2, 5)):
        if paths is None or any(p.shape[1] == 0 for p, _ in paths):
            found[rows] = [kernels.length(*wkb.loads(column[r].as_py())) for r in rows]
        else:
            found[rows] = sum((np.hypot(*np.moveaxis(np.diff(p, axis=1), 2, 0)).sum(1) for p, _ in paths), np.zeros(len(rows)))
    return found


def boxes(column: pa.Array) -> np.ndarray:
    """(rows, 4): kernels.bounds of a WKB column; null, or nothing but empty points: NaN."""
    found = np.full((len(column), 4), np.nan)
    for rows, paths in alike(column, (2, 3, 5, 6)):
        p = np.concatenate([p for p, _ in paths], 1) if paths else np.zeros((len(rows), 0, 2))
        plain = ~np.isnan(p).any((1, 2)) if p.shape[1] else np.zeros(len(rows), bool)
        if plain.any():
            found[rows[plain]] = np.hstack([p[plain].min(1), p[plain].max(1)])
        for r in rows[~plain]:
            found[r] = kernels.bounds(*wkb.loads(column[r].as_py())) or np.nan
    return found


def oriented(rings: list[tuple[np.ndarray, bool]]) -> Iterator[np.ndarray]:
    """Rings (points (rows, n, 2), hole) with the area on their left, whichever way they turn."""
    return (np.where(((_signed(p) < 0) != hole)[:, None, None], p[:, ::-1], p) for p, hole in rings if p.shape[1] > 1)


class Shapes:
    """Areas as edges e (x1, y1, x2, y2), the area on their left, those of area k from at[k] to at[k + 1]; box: of each area."""

    def __init__(self, e: np.ndarray, at: np.ndarray):
        self.e, self.at, self.n = e + 0.0, at, np.diff(at)
        self.flip = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
        self.s = np.where(self.flip[:, None], self.e[:, [2, 3, 0, 1]], self.e)
        self.low, self.high = np.minimum(self.e[:, :2], self.e[:, 2:]), np.maximum(self.e[:, :2], self.e[:, 2:])
        self.box = np.tile(np.array([np.inf, np.inf, -np.inf, -np.inf]), (len(self.n), 1))
        some = self.n > 0
        if some.any():
            self.box[some] = np.hstack([np.minimum.reduceat(self.low, at[:-1][some]), np.maximum.reduceat(self.high, at[:-1][some])])

    @staticmethod
    def read(column: pa.Array) -> Shapes:
        """The polygons of a WKB column, whichever way their rings turn; rows without any have no edges."""
        parts, size = [], np.zeros(len(column), np.int64)
        for rows, rings in alike(column):
            if rings is None:
                rings = [(np.asarray(r, float).reshape(1, -1, 2), k > 0) for p in kernels.polygons(*wkb.loads(column[rows[0]].as_py())) for k, r in enumerate(p)]
            turned = [*oriented(rings)]
            if turned:
                parts.append((rows, np.concatenate([np.concatenate([p[:, :-1], p[:, 1:]], 2) for p in turned], 1)))
                size[rows] = parts[-1][1].shape[1]
        at = np.concatenate([[0], np.cumsum(size)])
        e, of = np.zeros((at[-1], 4)), np.repeat(np.arange(len(column)), size)
        for rows, p in parts:
            e[at[rows][:, None] + np.arange(p.shape[1])] = p
        keep = (e[:, :2] != e[:, 2:]).any(1)
        return Shapes(e[keep], np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(column)))]))

    @staticmethod
    def joined(*parts: Shapes) -> Shapes:
        return Shapes(np.concatenate([p.e for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([p.n for p in parts]))]))

    def split(self) -> Shapes:
        """Edges of an area split where they meet each other."""
        of = np.repeat(np.arange(len(self.n)), self.n)
        k, p = cuts(self.s, np.arange(len(of)) + 1, self.at[1:][of])
        if not len(k):
            return self
        u, v, at, flip = _parts(self.s, self.flip, k, p)
        return Shapes(np.where(flip[:, None], np.hstack([v, u]), np.hstack([u, v])), np.concatenate([[0], np.cumsum(np.bincount(of[at], minlength=len(self.n)))]))


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a come after those of b, column by column."""
    late = np.zeros(len(a), bool)
    for k in reversed(range(a.shape[1])):
        late = (a[:, k] > b[:, k]) | ((a[:, k] == b[:, k]) & late)
    return late


def cuts(s: np.ndarray, first: np.ndarray, last: np.ndarray, keep: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(segments, places): where segments (ends in ascending order) are split by others: row k meets the rows from first[k] to last[k], of which `keep` takes pairs."""
    lo_y, hi_y = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    of, places = [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    n = np.maximum(last - first, 0)
    turn = lambda l, x, y: (l[:, 2] - l[:, 0]) * (y - l[:, 1]) - (l[:, 3] - l[:, 1]) * (x - l[:, 0])
    for part in blocks(n):
        i, j = np.repeat(np.arange(part.start, part.stop), n[part]), ranges(first[part], n[part])
        near = (s[i, 0] <= s[j, 2]) & (s[i, 2] >= s[j, 0]) & (lo_y[i] <= hi_y[j]) & (hi_y[i] >= lo_y[j])
        i, j = i[near], j[near]
        if keep is not None:
            kept = keep(i, j)
            i, j = i[kept], j[kept]
        # in one order, so that a crossing is the same point whichever way a pair comes
        swap = _after(s[i], s[j])
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        p, q = s[i], s[j]
        ta, tb, tc, td = turn(q, p[:, 0], p[:, 1]), turn(q, p[:, 2], p[:, 3]), turn(p, q[:, 0], q[:, 1]), turn(p, q[:, 2], q[:, 3])
        k = np.flatnonzero((np.sign(ta) * np.sign(tb) < 0) & (np.sign(tc) * np.sign(td) < 0))
        w = (ta[k] / (ta[k] - tb[k]))[:, None]
        at = p[k, :2] + w * (p[k, 2:] - p[k, :2])
        of += [i[k], j[k]]
        places += [at, at]
        for t, to, on, end in ((ta, j, q, p[:, :2]), (tb, j, q, p[:, 2:]), (tc, i, p, q[:, :2]), (td, i, p, q[:, 2:])):
            k = np.flatnonzero(t == 0)
            end, on = end[k], on[k]
            within = (end[:, 0] >= on[:, 0]) & (end[:, 0] <= on[:, 2]) & (end[:, 1] >= np.minimum(on[:, 1], on[:, 3])) & (end[:, 1] <= np.maximum(on[:, 1], on[:, 3]))
            within &= (end != on[:, :2]).any(1) & (end != on[:, 2:]).any(1)
            of.append(to[k[within]])
            places.append(end[within])
    return np.concatenate(of), np.concatenate(places) + 0.0


def _parts(s: np.ndarray, flip: np.ndarray, k: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, segment, flip): the parts of segments that are split at places p of the segments k; u before v, flip: whether the edge goes from v to u."""
    along = (p[:, 0] - s[k, 0]) * (s[k, 2] - s[k, 0]) + (p[:, 1] - s[k, 1]) * (s[k, 3] - s[k, 1])
    order = np.lexsort((p[:, 1], p[:, 0], along, k))
    k, p = k[order], p[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1]).any(1)
    k, p = k[new], p[new]
    n = np.bincount(k, minlength=len(s))
    first = np.cumsum(n + 1) - (n + 1)
    u, v = np.empty((len(s) + len(k), 2)), np.empty((len(s) + len(k), 2))
    u[first], v[first + n] = s[:, :2], s[:, 2:]
    at = first[k] + np.arange(len(k)) - (np.cumsum(n) - n)[k]
    v[at], u[at + 1] = p, p
    of = np.repeat(np.arange(len(s)), n + 1)
    some = (u != v).any(1)
    u, v, of = u[some], v[some], of[some]
    swap = _after(u, v)
    return np.where(swap[:, None], v, u), np.where(swap[:, None], u, v), of, flip[of] ^ swap


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows with equal ones together, and whether a row in that order differs from the one before."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ np.ascontiguousarray(c).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    differs = lambda o: np.concatenate([np.ones(min(len(o), 1), bool), np.logical_or.reduce([c[o[1:]] != c[o[:-1]] for c in columns])])
    new, h = differs(order), h[order]
    if (new[1:] & (h[1:] == h[:-1])).any():  # two rows of one hash
        order = np.lexsort(columns)
        new = differs(order)
    return order, new


def sides(shapes: Shapes, of: np.ndarray, group: np.ndarray, layer: np.ndarray, u: np.ndarray, v: np.ndarray, at: np.ndarray, flip: np.ndarray, inside: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(edges, groups): the parts (u, v, flip) of edges of members `at` that bound what `inside` (of the numbers of areas of layers 0 and 1 that hold a place) takes in, on their left.

    Member m is the area of[m] in group[m] and layer[m], in ascending order of groups.
    """
    if not len(u):
        return np.zeros((0, 4)), np.zeros(0, np.int64)
    order, new = _same(group[at].astype(float), u[:, 0], u[:, 1], v[:, 0], v[:, 1])
    part = np.cumsum(new) - 1
    at, flip, first = at[order], flip[order], order[new]
    u, v, g, n = u[first], v[first], group[at[new]], int(new.sum())
    own = np.bincount(part * 4 + layer[at] * 2 + flip, minlength=4 * n).reshape(n, 2, 2)
    x, y = ((u + v) / 2).T
    begin, end = (c[at[new]] for c in _spans(group))
    more = np.zeros((n, 2), np.int64)
    for some in blocks(end - begin):
        count = (end - begin)[some]
        q, m = np.repeat(np.arange(some.start, some.stop), count), ranges(begin[some], count)
        mine, lines = np.zeros(len(q), bool), slice(*np.searchsorted(part, (some.start, some.stop)))
        mine[(np.cumsum(count) - count)[part[lines] - some.start] + at[lines] - begin[part[lines]]] = True
        box = shapes.box[of[m]]
        near = (box[:, 0] <= x[q]) & (box[:, 1] <= y[q]) & (box[:, 2] >= x[q]) & (box[:, 3] >= y[q]) & ~mine
        q, m = q[near], m[near]
        count = shapes.n[of[m]]
        for few in blocks(count):
            a, b, c = q[few], m[few], count[few]
            k, pair = ranges(shapes.at[of[b]], c), np.repeat(np.arange(len(a)), c)
            py = y[a][pair]
            level = (shapes.low[k, 1] <= py) & (shapes.high[k, 1] >= py) & (shapes.high[k, 0] >= x[a][pair])
            k, pair, py = k[level], pair[level], py[level]
            (ax, ay, bx, by), px = shapes.e[k].T, x[a][pair]
            t = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            odd = ((ay > py) != (by > py)) & (t != 0) & ((t > 0) == (by > ay))
            held = np.bincount(pair[odd], minlength=len(a)) % 2 == 1
            held[pair[(t == 0) & (shapes.low[k, 0] <= px)]] = False
            np.add.at(more, (a[held], layer[b[held]]), 1)
    l, r = (inside(*(own[:, k, side] + more[:, k] for k in (0, 1))) for side in (0, 1))
    left, right = np.flatnonzero(l & ~r), np.flatnonzero(r & ~l)
    return np.concatenate([np.hstack([u[left], v[left]]), np.hstack([v[right], u[right]])]), np.concatenate([g[left], g[right]])


def bounding(shapes: Shapes, of: np.ndarray, group: np.ndarray, layer: np.ndarray, edges: np.ndarray, at: np.ndarray, inside: Callable, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """sides() of the edges of members `at`, in ascending order, split where they meet in their group. apart: edges of one area are split already."""
    s, g = shapes.s[edges], group[at]
    k, p = cuts(s, _spans(at)[1] if apart else np.arange(len(at)) + 1, _spans(g)[1])
    u, v, seg, flip = _parts(s, shapes.flip[edges], k, p)
    return sides(shapes, of, group, layer, u, v, at[seg], flip, inside)


def covered(shapes: Shapes, box: tuple[float, float, float, float], n: int) -> np.ndarray:
    """(n, n), rows along y: the cells of a square box that lie inside a single area, which no edge of it touches."""
    w, found = (box[2] - box[0]) / n, np.zeros((n, n), bool)
    few = np.flatnonzero((shapes.box[:, 0] <= box[2]) & (shapes.box[:, 2] >= box[0]) & (shapes.box[:, 1] <= box[3]) & (shapes.box[:, 3] >= box[1]) & (shapes.n > 0))
    for some in blocks(np.full(len(few), n * n), 1 << 22):
        m = few[some]
        k, c = ranges(shapes.at[m], shapes.n[m]), shapes.n[m]
        p, e = np.repeat(np.arange(len(m)), c), shapes.e[k]
        lo, hi = (shapes.low[k] - box[:2]) / w, (shapes.high[k] - box[:2]) / w
        flips = np.zeros((len(m), n, n + 1), np.int32)
        # where an edge passes the middle of a row of cells, what lies right of it changes sides
        a, b = np.clip(np.ceil(lo[:, 1] - 0.5), 0, n).astype(int), np.clip(np.ceil(hi[:, 1] - 0.5), 0, n).astype(int)
        row, q = ranges(a, b - a), np.repeat(np.arange(len(e)), b - a)
        y = box[1] + (row + 0.5) * w
        x = e[q, 0] + (y - e[q, 1]) / (e[q, 3] - e[q, 1]) * (e[q, 2] - e[q, 0])
        np.add.at(flips, (p[q], row, np.clip(np.ceil((x - box[0]) / w - 0.5), 0, n).astype(int)), 1)
        filled = np.cumsum(flips[:, :, :n], 2) % 2 == 1
        # cells that an edge's box touches; running sums over the corners of these boxes
        lo, hi = np.floor(lo - 1e-9).astype(int), np.floor(hi + 1e-9).astype(int) + 1
        seen = ((hi > 0) & (lo < n)).all(1)
        lo, hi, p = np.clip(lo[seen], 0, n), np.clip(hi[seen], 0, n), p[seen]
        touch = np.zeros((len(m), n + 1, n + 1), np.int32)
        for ys, xs, by in ((lo, lo, 1), (lo, hi, -1), (hi, lo, -1), (hi, hi, 1)):
            np.add.at(touch, (p, ys[:, 1], xs[:, 0]), by)
        found |= (filled & (np.cumsum(np.cumsum(touch, 1), 2)[:, :n, :n] == 0)).any(0)
    return found


def union_part(shapes: Shapes, box: tuple[float, float, float, float], n: int = 32) -> np.ndarray:
    """The directed edges of the union of areas whose middles lie in a square box (its upper ends left out). shapes: all that meet an edge that touches the box."""
    full = covered(shapes, box, n)
    total = np.zeros((n + 1, n + 1), np.int64)
    total[1:, 1:] = np.cumsum(np.cumsum(~full, 0), 1)
    w = (box[2] - box[0]) / n
    lo, hi = np.floor((shapes.low - box[:2]) / w - 1e-9), np.floor((shapes.high - box[:2]) / w + 1e-9) + 1
    a, b = np.clip(lo, 0, n).astype(int), np.clip(hi, 0, n).astype(int)
    open_ = total[b[:, 1], b[:, 0]] - total[a[:, 1], b[:, 0]] - total[b[:, 1], a[:, 0]] + total[a[:, 1], a[:, 0]] > 0
    touches = ((hi > 0) & (lo < n)).all(1)
    own = touches & open_
    if not own.any():
        return np.zeros((0, 4))
    # an edge bounds nothing where cells are covered, nor do places where edges meet there
    hidden = ((lo >= 0) & (hi <= n)).all(1) & ~open_
    near = ~hidden & (shapes.low <= shapes.high[own].max(0)).all(1) & (shapes.high >= shapes.low[own].min(0)).all(1)
    of = np.repeat(np.arange(len(shapes.n)), shapes.n)
    rows = np.flatnonzero(near)
    rows = rows[np.argsort(shapes.s[rows, 0], kind="stable")]
    s, mine = shapes.s[rows], own[rows]
    k, p = cuts(s, np.arange(len(s)) + 1, np.searchsorted(s[:, 0], s[:, 2], "right"), lambda i, j: mine[i] | mine[j])
    place = np.cumsum(mine) - 1
    u, v, seg, flip = _parts(s[mine], shapes.flip[rows[mine]], place[k[mine[k]]], p[mine[k]])
    mid = (u + v) / 2
    here = ((mid >= box[:2]) & (mid < box[2:])).all(1)
    c = np.clip(np.floor((mid[here] - box[:2]) / w), 0, n - 1).astype(int)
    here[here] = ~full[c[:, 1], c[:, 0]]
    members = np.arange(len(shapes.n))
    zero = np.zeros(len(members), np.int64)
    return sides(shapes, members, zero, zero, u[here], v[here], of[rows[mine]][seg[here]], flip[here], lambda one, _: one > 0)[0]


def _following(edges: np.ndarray, start: np.ndarray, end: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge that follows each edge, groups where that is unclear): the first one clockwise from where the edge came from; start, end: numbers of its places."""
    n = len(edges)
    order = np.argsort(start, kind="stable")
    lo, hi = np.searchsorted(start[order], end), np.searchsorted(start[order], end, "right")
    single = hi - lo == 1
    follow = np.arange(n)
    follow[single] = order[lo[single]]
    many = np.flatnonzero(hi - lo > 1)
    if len(many):
        count = (hi - lo)[many]
        i, j = np.repeat(many, count), order[ranges(lo[many], count)]
        d, back = edges[j, 2:] - edges[j, :2], edges[i, :2] - edges[i, 2:]
        turn = (np.arctan2(back[:, 1], back[:, 0]) - np.arctan2(d[:, 1], d[:, 0])) % (2 * np.pi)
        turn[turn == 0] = 2 * np.pi
        best = np.lexsort((edges[j, 3], edges[j, 2], turn, i))
        follow[many] = j[best[np.cumsum(count) - count]]
    unclear = np.zeros(int(g.max(initial=-1)) + 1, bool)
    unclear[g[hi == lo]] = True
    unclear[g[follow[np.bincount(follow, minlength=n)[follow] != 1]]] = True
    return follow, unclear


def _shells_of(edges: np.ndarray, ring: np.ndarray, area: np.ndarray, g: np.ndarray, holes: np.ndarray, sliver: float) -> np.ndarray:
    """The smallest shell of its group around the middle of each hole's first edge; -1: none. Rings are known by their first edge."""
    found = np.full(len(holes), -1)
    x, y = ((edges[holes, :2] + edges[holes, 2:]) / 2).T
    begin, end = np.searchsorted(g, g[holes]), np.searchsorted(g, g[holes], "right")
    for part in blocks(end - begin):
        h, k = np.repeat(np.arange(part.start, part.stop), (end - begin)[part]), ranges(begin[part], (end - begin)[part])
        some = area[ring[k]] > sliver
        h, k = h[some], k[some]
        ax, ay, bx, by = edges[k].T
        turn = (bx - ax) * (y[h] - ay) - (by - ay) * (x[h] - ax)
        crossed = ((ay > y[h]) != (by > y[h])) & (turn != 0) & ((turn > 0) == (by > ay))
        key, times = np.unique(h[crossed] * len(edges) + ring[k[crossed]], return_counts=True)
        h, k = np.divmod(key[times % 2 == 1], len(edges))
        order = np.lexsort((area[k], h))
        h, first = np.unique(h[order], return_index=True)
        found[h] = k[order][first]
    return found


def polygons(edges: np.ndarray, group: np.ndarray, trace: Callable, sliver: float) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(groups, WKB, edges that close no ring) of directed edges with the area on their left. Groups with nothing but slivers have no row.

    Rings are joined for all groups at once. Groups with edges that lead nowhere, rings that come back to a place, or many holes go through `trace`.
    """
    order = np.lexsort((edges[:, 1], edges[:, 0], group))
    edges, group = edges[order] + 0.0, group[order]
    n = len(edges)
    names, g = np.unique(group, return_inverse=True)
    f = group.astype(float)
    ids = np.empty(2 * n, np.int64)
    o, new = _same(np.concatenate([f, f]), *np.concatenate([edges[:, :2], edges[:, 2:]]).T)
    ids[o] = np.cumsum(new) - 1
    follow, slow = _following(edges, ids[:n], ids[n:], g)
    follow = np.where(slow[g], np.arange(n), follow)
    # the smallest edge of each ring, and how far an edge is from the ring's last one: pointers double
    ring, step = np.arange(n), follow.copy()
    for _ in range(int(np.bincount(g).max(initial=1)).bit_length()):
        ring, step = np.minimum(ring, ring[step]), step[step]
    last = follow == ring
    step, far = np.where(last, np.arange(n), follow), (~last).astype(np.int64)
    for _ in range(int(np.bincount(g).max(initial=1)).bit_length()):
        far, step = far + far[step], step[step]
    size = np.bincount(ring, minlength=n)
    area = np.bincount(ring, edges[:, 0] * edges[:, 3] - edges[:, 2] * edges[:, 1], minlength=n) / 2
    # a place that a ring comes back to is one where several edges begin
    twice = np.flatnonzero(np.bincount(ids[:n], minlength=2 * n)[ids[:n]] > 1)
    key = ids[twice] * n + ring[twice]
    key, back, times = np.unique(key, return_inverse=True, return_counts=True)
    slow[g[twice[times[back] > 1]]] = True
    heads = np.flatnonzero((ring == np.arange(n)) & ~slow[g])
    holes = heads[area[heads] < -sliver]
    slow[np.bincount(g[holes], minlength=len(names)) * np.bincount(g, minlength=len(names)) > BLOCK] = True
    holes = holes[~slow[g[holes]]]
    first = heads[(area[heads] > sliver) & ~slow[g[heads]]]
    first = first[np.lexsort((first, -area[first], g[first]))]
    count = np.bincount(g[first], minlength=len(names))
    fast = np.flatnonzero(count)
    # rings in order: a shell, its holes
    shell = _shells_of(edges, ring, area, g, holes, sliver)
    holes, shell = holes[shell >= 0], shell[shell >= 0]
    rank = np.zeros(n + 1, np.int64)
    rank[first] = np.arange(len(first))
    rings, of = np.concatenate([first, holes]), np.concatenate([rank[first], rank[shell]])
    many = 1 + np.bincount(rank[shell], minlength=len(first))
    order = np.lexsort((rings, np.arange(len(rings)) >= len(first), of))
    rings, of = rings[order], of[order]
    outer = np.concatenate([np.ones(min(len(of), 1), bool), of[1:] != of[:-1]])
    lead = outer & (count[g[rings]] > 1) & np.concatenate([np.ones(min(len(of), 1), bool), g[rings[1:]] != g[rings[:-1]]])
    # nine bytes before a group of several shells, and before each shell; four before each ring
    length = 9 * lead + 9 * outer + 4 + 16 * (size[rings] + 1)
    begin = np.cumsum(length) - length
    body = begin + 9 * lead + 9 * outer + 4
    raw = np.zeros(int(length.sum()), np.uint8)
    put = lambda at, words: raw.__setitem__(at[:, None] + np.arange(words.shape[1]), words)
    four = lambda a: np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4)
    head = lambda kind, m: np.hstack([np.ones((len(m), 1), np.uint8), four(np.full(len(m), kind)), four(m)])
    put(begin[lead], head(6, count[g[rings[lead]]]))
    put((begin + 9 * lead)[outer], head(3, many))
    put(body - 4, four(size[rings] + 1))
    where = np.full(n, -1, np.int64)
    where[rings] = body
    e = np.flatnonzero(where[ring] >= 0)
    points = np.ascontiguousarray(edges[:, :2], "<f8").view(np.uint8).reshape(-1, 16)
    put(where[ring[e]] + 16 * (size[ring[e]] - 1 - far[e]), points[e])
    put(body + 16 * size[rings], points[rings])
    ends = np.concatenate([[0], np.cumsum(np.bincount(g[rings], length, len(names))[fast])]).astype(np.int64)
    shapes = pa.Array.from_buffers(pa.large_binary(), len(fast), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    found, texts, lost = [], [], []
    low = np.searchsorted(g, np.arange(len(names) + 1))
    for k in np.flatnonzero(slow):
        kind, c, m = trace(edges[low[k] : low[k + 1]])
        if c:
            found.append(k)
            texts.append(wkb.dumps(kind, c))
            lost.append(m)
    shapes = pa.concat_arrays([shapes, pa.array(texts, pa.large_binary())]).cast(pa.binary())
    return names[np.concatenate([fast, np.array(found, np.int64)])], shapes, np.concatenate([np.zeros(len(fast), np.int32), np.array(lost, np.int32)])
