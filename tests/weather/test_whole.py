"""Queries that give the whole job: every row that their tables can give."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.jobs import load
from fieldweave.operators import analytics
from fieldweave.sources.examples import example

from .conftest import SF

QUERIES, ORACLES = load()


def test_distances_of_two_sets_have_every_pair(spark):
    out = QUERIES["haversine_sets"](spark, SF)
    points, customers = (example(spark, SF, t).count() for t in ("points", "customer_points"))
    assert points > 1 and customers > 1
    assert out.count() == out.select("id_a", "id_b").distinct().count() == points * customers


def test_rebuilt_days_are_of_all_cells_and_years_with_eto(spark):
    out, days = QUERIES["rebuild_days"](spark, SF).cache(), QUERIES["disaggregate_daily"](spark, SF).cache()
    assert out.columns == ["qid", "year", "date", "pre", "tmax", "tmin", "eto"]
    keys = ["qid", "year", "date"]
    assert out.count() == days.count() and days.select(keys).exceptAll(out.select(keys)).count() == 0
    assert out.select("qid").distinct().count() == 4 and out.filter("eto > 0").select("qid").distinct().count() == 4


def test_analytics_cover_every_statistic_of_both_sources(spark):
    out = QUERIES["run_analytics"](spark, SF).groupBy("part", "source", "stat").agg(F.count("*").alias("n"), F.collect_set("variable").alias("v")).collect()
    wanted = {(p, s, k) for p in ("climatology", "quantile", "correlation") for s in ("hist", "stoc") for k in ("agg", "max", "min", "var")}
    assert {(r.part, r.source, r.stat) for r in out} == wanted
    assert all(set(r.v) == {"pre", "tmax", "tmin", "eto", "mei"} for r in out if r.part == "climatology")
    ks = QUERIES["similarity_ks_all_p"](spark, SF).select("stat", "variable").distinct().collect()
    assert {tuple(r) for r in ks} == {(k, v) for k in ("agg", "max", "min", "var") for v in ("pre", "tmax", "tmin", "eto")}


def test_daily_quantiles_reach_the_tails_of_all_variables(spark):
    out = QUERIES["daily_quantiles_all"](spark, SF)
    assert {r.variable for r in out.select("variable").distinct().collect()} == {"pre", "tmax", "tmin", "eto"}
    days = spark.range(20000).select(F.lit(1).cast("long").alias("qid"), F.expr("date_add(date'2001-01-01', int(id % 31))").alias("date"), F.col("id").cast("double").alias("pre"))
    got = {round(r.quantile, 6) for r in analytics.daily_quantiles(days, analytics.DAILY_PERCENTILES, ("pre",)).collect()}
    assert len(analytics.DAILY_PERCENTILES) == 111 and {0.0001, 0.0002, 0.998, 0.999} <= got and 0.99998 not in got
