"""Counts of pairs without the pairs, against brute force: overlapping boxes, places nearby, rows dealt over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from geolake.operators import spatial_join as sj
from geolake.plans import file_queries
from geolake.sources.shared import spread

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


@pytest.mark.parametrize("block", [8, 4096])
@pytest.mark.parametrize("sizes", [(0, 0.25, 2.5), (0.001, 0.02, 40)])
def test_overlap_counts_are_brute_force(spark, monkeypatch, sizes, block):
    monkeypatch.setattr(sj, "BLOCK", block)
    rng = random.Random(len(sizes) + block)
    rows = []
    for i in rng.sample(range(1000), 150):
        x, y = (0.5, 0.5) if i % 3 == 0 else (round(rng.uniform(-5, 5) * 4) / 4, rng.uniform(-5, 5))
        rows.append((i, (x, y, x + rng.choice(sizes), y + rng.choice(sizes))))
    want = {i: sum(i < j and p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1] for j, q in rows) for i, p in rows}
    d = spark.createDataFrame([*rows, (2000, None)], f"id long, bbox {BOX}").repartition(3)
    assert {r.id: r.n for r in sj.overlap_counts(d, "id", "bbox").collect()} == {i: n for i, n in want.items() if n}
    assert sj.overlap_counts(d.limit(0), "id", "bbox").count() == 0


def test_nearby_counts_are_brute_force_and_join_places_once(spark):
    rng = random.Random(3)
    spots = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(40)]
    a, b = [(i, *rng.choice(spots)) for i in range(100)], [(i, *rng.choice(spots)) for i in range(900)]
    left, right = spark.createDataFrame(a, "k long, x double, y double"), spark.createDataFrame(b, "o long, u double, v double")
    near = {k: [((x - u) ** 2 + (y - v) ** 2) ** 0.5 for _, u, v in b if (x - u) ** 2 + (y - v) ** 2 <= 2.25] for k, x, y in a}
    found = sj.nearby_counts(left, right, "k", 1.5, "x", "y", "u", "v")
    assert {r.k: (r.n, round(r.nearest, 9)) for r in found.collect()} == {k: (len(d), round(min(d), 9)) for k, d in near.items() if d}
    # 900 rows stand on 40 places: these are joined
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "count" in plan


def test_rows_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    d = spark.range(1000, numPartitions=1)
    assert spread(d, 100).rdd.getNumPartitions() == 10 and spread(d.limit(0)).count() == 0
    assert spread(d, 100).agg(F.sum("id")).first()[0] == 499500
    monkeypatch.setattr(file_queries, "spread", lambda df: spread(df, 4000))
    assert file_queries.feature_texts(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 5
