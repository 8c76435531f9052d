"""Chains of lines against the walk over one list, and rounds that grow with the logarithm of a chain."""

import random

import pytest
from pyspark.sql import functions as F

from geolake.functions import kernels as k
from geolake.functions import wkb
from geolake.operators import chains


def canonical(path, closed):
    if closed:
        path = path[:-1]
        turns = [p[i:] + p[:i] for p in (path, path[::-1]) for i in range(len(path))]
        return min(turns)
    return min(path, path[::-1])


def frame(spark, rows):
    return spark.createDataFrame([(c, i, wkb.dumps("LineString", p)) for c, i, p in rows], "class string, id long, geometry binary")


def grid_lines(rng, n, size):
    seen, rows = set(), []
    while len(rows) < n:
        x, y, east = rng.randrange(size), rng.randrange(size), rng.random() < 0.5
        c = rng.choice("ab")
        if (c, x, y, east) in seen:
            continue
        seen.add((c, x, y, east))
        p = [(float(x), float(y)), (x + 0.5, y + 0.25), (float(x + east), float(y + (not east)))]
        rows.append((c, rng.randrange(10**9), p if rng.random() < 0.5 else p[::-1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_is_the_walk_over_one_list(spark, seed):
    rng = random.Random(seed)
    rows = grid_lines(rng, 260, 12)
    far = 50.0
    rows += [("a", 10**10 + i, [(far + i, 0.0), (far + i + 1, 0.0)][:: rng.choice([1, -1])]) for i in range(40)]  # one long chain
    ring = [(90.0, 0.0), (91.0, 0.0), (91.0, 1.0), (92.0, 3.0), (90.0, 1.0), (90.0, 0.0)]
    rows += [("b", 2 * 10**10 + (7 * i) % 5, list(p)[:: rng.choice([1, -1])]) for i, p in enumerate(zip(ring, ring[1:]))]  # a closed one
    rows += [("b", 3 * 10**10, [(x + 20, y) for x, y in ring[:4] + ring[:1]]), ("a", 3 * 10**10 + 1, [(70.0, 70.0), (71.0, 70.0)]), ("a", 3 * 10**10 + 2, [(70.0, 70.0), (70.0, 71.0), (71.0, 70.0)])]
    got = chains.merged(frame(spark, rows), "class").collect()
    mine = sorted((r["class"], canonical(wkb.loads(r.geometry)[1], r.closed)) for r in got)
    want = []
    for c in "ab":
        for p in k.merge_lines([p for d, _, p in rows if d == c]):
            want.append((c, canonical(list(map(tuple, p)), p[0] == p[-1] and sum(q in (x[0], x[-1]) for d, _, x in rows if d == c for q in [p[0]]) <= 2)))
    assert len(got) == len(want) and sum(r.lines for r in got) == len(rows) and mine == sorted(want)
    assert sum(r.closed for r in got) >= 3


def test_chains_edges(spark):
    assert chains.merged(frame(spark, []), "class").count() == 0
    odd = frame(spark, [("a", 1, [(0.0, 0.0), (1.0, 0.0)])]).unionByName(spark.createDataFrame([("a", 2, None), ("a", 3, wkb.dumps("Point", (1.0, 0.0))), (None, 4, wkb.dumps("LineString", [(1.0, 0.0), (2.0, 0.0)]))], "class string, id long, geometry binary"))
    assert sorted((r["class"] or "", r.lines) for r in chains.merged(odd, "class").collect()) == [("", 1), ("a", 1)]
    order = chains.chains(chains.ends_of(frame(spark, [("a", 5, [(0.0, 0.0), (1.0, 0.0)]), ("a", 3, [(2.0, 0.0), (1.0, 0.0)]), ("b", 4, [(2.0, 0.0), (3.0, 0.0)])]), "class"), "class")
    assert sorted(map(tuple, order.collect())) == [(3, 3, 0, 0, False), (4, 4, 0, 0, False), (5, 3, 1, 1, False)]
    assert order.where(F.col("place") < 0).count() == 0
