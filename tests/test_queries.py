"""Every query with an oracle gives the oracle's rows on the smallest tables; plans stay free of nested loops."""

import duckdb
import pytest

from geolake import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("~" if r[i] is None else repr(round(r[i], 9) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["reverse_geocode_bulk", "pip_raycast", "bbox_overlap_join", "in_country_semi", "semi_or_prefix", "distance_join", "tile_partition_counts", "tile_semi_join"])
def test_no_nested_loop(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0


def test_lines_are_merged(spark):
    """Of all lines of a class and cell fewer are left, and the same whatever the order of rows."""
    from pyspark.sql import functions as F

    from geolake.functions import kernels, wkb
    from geolake.plans import build_queries

    d = build_queries.road_lines(spark, SF).groupBy("class").agg(F.array_sort(F.collect_list("geometry")).alias("parts"))
    rows = d.select(F.size("parts").alias("n"), kernels.geo_merge_lines("parts").alias("g")).collect()
    assert all(0 < len(kernels.lines(*wkb.loads(bytes(r.g)))) < r.n for r in rows)
