"""Areas that lie many times over one another: merged pieces, counted lines and overlays of pairs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from geolake.functions import kernels as k
from geolake.functions import wkb
from geolake.operators import overlay, pieces

from .test_pieces import BOX, areas, shapes


def table(spark, found, key="id"):
    return spark.createDataFrame([(i, wkb.dumps(*g), tuple(map(float, k.bounds(*g)))) for i, g in enumerate(found)], f"{key} long, geometry binary, bbox {BOX}")


def test_merged_pieces_hold_the_same_places_in_fewer_rows(spark):
    rng = random.Random(11)
    found = areas(rng, 30) + [("Polygon", [[(x, y), (x + 4, y), (x + 4, y + 3), (x, y + 3), (x, y)]]) for x, y in ((rng.uniform(-6, 3), rng.uniform(-6, 3)) for _ in range(150))]
    cut = pieces.subdivide(table(spark, found), "id", most=4).withColumn("nation", F.lit("a")).localCheckpoint()
    less = pieces.merged(cut, "nation").localCheckpoint()
    assert less.columns == ["nation", "id", "cell", "inside", "corner", "edges"] and less.where("inside and id is not null").isEmpty()
    assert less.count() * 2 < cut.count()
    spots = [(i, round(rng.uniform(-8, 10) * f) / f, round(rng.uniform(-8, 8) * f) / f) for i, f in enumerate([16] * 300 + [7.3] * 300)]
    points = spark.createDataFrame(spots, "p int, x double, y double")
    held = lambda d: {r.p for r in pieces.points_in(points, d.drop("nation"), "x", "y").select("p").collect()}
    assert held(less) == {i for i, x, y in spots if any(k.side(*g, x, y) >= 0 for g in found)}
    assert pieces.merged(cut.limit(0)).count() == 0


@pytest.mark.parametrize("most", [7, 50_000])
def test_touch_counts_are_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(pieces, "MOST_LINES", most)
    monkeypatch.setattr(pieces, "MOST_AREAS", most)
    rng = random.Random(12)
    home, every = areas(rng, 12), [g for g in shapes(rng, 25) if g[0] not in ("Polygon", "MultiPolygon")]
    want = {j: sum(k.intersects(g, h) for g in every) for j, h in enumerate(home)}
    got = pieces.touch_counts(table(spark, every, "line"), table(spark, home), "line", "id").collect()
    assert {r.id: r.n for r in got} == {j: n for j, n in want.items() if n} and len(got) == len({r.id for r in got})


def test_pairs_overlaid_in_tasks_are_those_overlaid_as_rows(spark, monkeypatch):
    rng = random.Random(13)
    left, right = table(spark, areas(rng, 8)), table(spark, areas(rng, 8), "other")
    d = overlay.intersection(left, right)
    near = lambda d: {(r.id, r.other): (round(r.a, 9), r.open) for r in d.select("id", "other", "open", k.geo_area("geometry").alias("a")).collect()}
    assert "collect_list" not in d._jdf.queryExecution().executedPlan().toString()
    local = near(d)
    monkeypatch.setattr(overlay, "PAIR_EDGES", 0)
    assert local == near(overlay.intersection(left, right)) and len(local) > 10
