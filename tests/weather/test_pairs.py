"""Distance matrices and masks whose rows are few and whose work is not: spread over tasks, and right."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldweave.jobs.registry import _half_up
from fieldweave.operators import grid


def places(spark, n, seed=0):
    """n places in one partition."""
    lon, lat = (F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(m * 1000)) / 1000 - m / 2 for k, m in ((1, 360), (2, 180)))
    return spark.range(0, n, 1, 1).select("id", lon.alias("lon"), lat.alias("lat"))


def brute(p, q):
    s, t = math.sin(math.radians(q.lat - p.lat) / 2), math.sin(math.radians(q.lon - p.lon) / 2)
    return 12742 * math.asin(min(math.sqrt(s * s + math.cos(math.radians(p.lat)) * math.cos(math.radians(q.lat)) * t * t), 1))


def loads(out):
    return [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]


def test_a_matrix_is_spread_over_tasks(spark):
    a, b = places(spark, 1000), places(spark, 610, 7)
    out = grid.distances(a, b, tile=100)
    got = loads(out)
    assert sum(got) == 610_000 == out.select("id_a", "id_b").distinct().count()
    assert len(got) >= 30 and max(got) <= 100_000
    for side in grid.tiled(a, b, tile=100):
        assert side.groupBy("part_a", "part_b").count().agg(F.max("count")).first()[0] <= 150


@pytest.mark.parametrize("tile", [7, 2000])
def test_distances_are_the_formula(spark, tile):
    odd = [(i, lon, lat) for i, (lon, lat) in enumerate([(0.0, 90.0), (0.0, -90.0), (10.0, 0.0), (-170.0, 0.0), (10.0, 1e-9), (180.0, 5.0), (-180.0, 5.0), (33.3, -44.4), (33.3, -44.4)])]
    rng = random.Random(2)
    a = spark.createDataFrame(odd + [(100 + i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(40)], "id long, lon double, lat double")
    place = {r.id: r for r in a.collect()}
    got = grid.distances(a, a, tile=tile).collect()
    assert len(got) == len(place) ** 2
    assert all(r.km == pytest.approx(brute(place[r.id_a], place[r.id_b]), rel=1e-13, abs=1e-10) for r in got)
    assert grid.distances(a, a.limit(0)).count() == 0 == grid.distances(a.limit(0), a).count()


def test_rounding_in_plain_arithmetic(spark):
    df = spark.createDataFrame([(0.0,), (0.00005,), (20015.08679,), (1234.56784999,), (None,), (float("nan"),)], "km double").select(_half_up("km", 4).alias("km"))
    got = [r.km for r in df.collect()]
    assert got[:5] == [0.0, 0.0001, 20015.0868, 1234.5678, None] and math.isnan(got[5])


@pytest.mark.parametrize("tile", [90, 2000])
def test_a_mirrored_matrix_has_every_pair_once(spark, tile):
    a = places(spark, 700)
    out = grid.self_distances(a, tile=tile).cache()
    assert out.count() == 490_000 == out.select("id_a", "id_b").distinct().count()
    swapped = out.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "km")
    assert out.exceptAll(swapped).count() == 0 and out.filter("id_a = id_b and km != 0").count() == 0
    assert out.exceptAll(grid.distances(a, a)).filter("id_a != id_b").count() == 0
    got = loads(out)
    assert tile > 700 or (len(got) >= 15 and max(got) <= 120_000)
    out.unpersist()


def stored(out):
    """Rows that a result's exchanges write, after it has run as a whole."""
    session = out.sparkSession
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution()
        plan.toRdd().count()
    finally:
        session.conf.unset("spark.sql.adaptive.enabled")
    nodes, n = [plan.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            n += node.metrics().apply("shuffleRecordsWritten").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_a_matrix_stores_each_point_once(spark):
    a, b = places(spark, 1000), places(spark, 610, 7)
    assert stored(grid.distances(a, b, tile=100)) == 1610 == stored(grid.distances(a, b))


def test_a_mirrored_matrix_stores_each_point_at_most_once_a_side(spark):
    a = places(spark, 700)
    assert max(stored(grid.self_distances(a, tile=tile)) for tile in (90, 2000)) <= 1400


@pytest.mark.parametrize("tile", [1, 2000])
def test_a_mirrored_matrix_keeps_missing_and_repeated_ids(spark, tile):
    a = spark.createDataFrame([(1, 3.0, 4.0), (1, 3.0, 4.0), (2, -7.0, 50.0), (None, 9.0, 9.0), (None, None, None), (5, None, 1.0)], "id long, lon double, lat double")
    p, q = (a.select(*[F.col(c).alias(f"{c}_{s}") for c in a.columns]) for s in "ab")
    km = F.when(F.col("id_a") == F.col("id_b"), 0.0).otherwise(grid.haversine_km(*[F.col(c) for c in ("lon_a", "lat_a", "lon_b", "lat_b")]))
    seen = lambda d: sorted((r.id_a or 0, r.id_b or 0, -1.0 if r.km is None else round(r.km, 6)) for r in d.collect())
    got = seen(grid.self_distances(a, tile=tile))
    assert len(got) == 36 and got == seen(p.crossJoin(q).select("id_a", "id_b", km.alias("km")))


def test_rings_of_one_block_are_spread_over_tasks(spark):
    corner = lambda x, y: F.struct((F.lit(8.0 + x) + F.col("id") % 7 / 10).alias("lon"), (F.lit(8.0 + y) + F.col("id") % 5 / 10).alias("lat"))
    rings = spark.range(0, 900, 1, 1).select(F.col("id").cast("string").alias("name"), F.array(corner(0.1, 0.2), corner(5.2, 0.4), corner(3.3, 4.9), corner(2.1, 1.7)).alias("ring"))
    cells = grid.make_grid(spark, 1.0)
    out = grid.polygon_cells(cells, rings, 1.0, 0.2, tile=30)
    got = loads(out)
    assert len(got) >= 15 and max(got) <= sum(got) / 4
    whole = grid.polygon_cells(cells, rings, 1.0, 0.2)
    assert out.count() == whole.count() == sum(got) > 900 and out.exceptAll(whole).count() == 0
    # Rings repeat after 35 names, and so do their cells.
    shapes = out.groupBy("name").agg(F.sort_array(F.collect_set("qid")).alias("cells")).select((F.col("name").cast("int") % 35).alias("shape"), "cells")
    assert shapes.count() == 900 and shapes.groupBy("shape").agg(F.count_distinct("cells").alias("n")).filter("n > 1").count() == 0
