"""Golden values, invariants and edges of the weather operators."""

from __future__ import annotations

import datetime
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import fao, normal, special
from fieldweave.operators import distributions, grid, indices, rebuild, seasonal, trend
from fieldweave.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_known_cell_ids(spark):
    rows = [(0.0, 0.0, 699050), (-47.9, -15.8, 2116266), (77.1, 28.6, 757942), (-0.001, 51.5, 2035459)]
    df = spark.createDataFrame(rows, "lon double, lat double, qid long")
    assert all(r.got == r.qid for r in df.withColumn("got", grid.ll_to_qid(F.col("lon"), F.col("lat"))).collect())
    centres = {r.qid: (r.lon, r.lat) for r in grid.with_lonlat(df.select("qid")).collect()}
    assert centres[2116266] == (-47.875, -15.875) and centres[2035459] == (-0.125, 51.625)
    out = spark.createDataFrame([(181.0, 0.0), (0.0, 90.0), (None, 1.0)], "lon double, lat double")
    assert [r.q for r in out.select(grid.ll_to_qid(F.col("lon"), F.col("lat")).alias("q")).collect()] == [None] * 3


@pytest.mark.parametrize("res", [0.25, 0.5, 1.0, 1.40625])
def test_cell_ids_match_a_stepwise_descent(spark, res):
    rng = random.Random(4)
    points = [(rng.uniform(-180, 180), rng.uniform(-89.9, 89.9)) for _ in range(200)]

    def descend(lon, lat):
        half, cx, cy, code = res * 2 ** (grid.levels(res) - 1), 0.0, 0.0, 0
        for _ in range(grid.levels(res)):
            east, north = lon >= cx, lat >= cy
            code = code * 4 + (0 if north and east else 1 if north else 3 if east else 2)
            half /= 2
            cx, cy = cx + (half if east else -half), cy + (half if north else -half)
        return code

    df = spark.createDataFrame(points, "lon double, lat double").select("*", grid.ll_to_qid(F.col("lon"), F.col("lat"), res).alias("qid"))
    rows = grid.with_lonlat(df.withColumnsRenamed({"lon": "x", "lat": "y"}), res).collect()
    assert all(r.qid == descend(r.x, r.y) and abs(r.lon - r.x) <= res / 2 and abs(r.lat - r.y) <= res / 2 for r in rows)


def test_grid_covers_its_bounds_once(spark):
    g = grid.make_grid(spark, 1.0, (-3.0, 2.0), (-1.0, 2.0)).collect()
    assert len(g) == 15 and len({r.qid for r in g}) == 15
    assert {r.lon for r in g} == {-2.5, -1.5, -0.5, 0.5, 1.5}


def test_pairs_within_match_brute_force(spark):
    rng = random.Random(6)
    points = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(250)]
    points += [(900, 179.99, 10.0), (901, -179.99, 10.0), (902, 20.0, 89.9), (903, -160.0, 89.9), (904, 0.0, -90.0)]
    p = spark.createDataFrame(points, "id long, lon double, lat double")
    for km in (300.0, 1500.0):
        got = {(r.id_a, r.id_b) for r in grid.pairs_within(p, p, km).collect()}
        want = {(r.id_a, r.id_b) for r in grid.distances(p, p).filter(F.col("km") <= km).collect()}
        assert got == want


def test_published_evapotranspiration_examples(spark):
    lat = F.radians(F.lit(-20.0))
    dec = fao.declination(F.lit(246))
    sha = fao.sunset_hour_angle(lat, dec)
    r = one(spark, ra=fao.extraterrestrial(lat, dec, sha, fao.inverse_distance(F.lit(246))), n=fao.daylight_hours(sha), p=fao.air_pressure(F.lit(1800.0)), e=fao.saturation(F.lit(24.5)), u=fao.wind_at_2m(F.lit(3.2), F.lit(10.0)))
    assert r.ra == pytest.approx(32.2, abs=0.05) and r.n == pytest.approx(11.7, abs=0.05)
    assert r.p == pytest.approx(81.8, abs=0.05) and r.e == pytest.approx(3.075, abs=0.002) and r.u == pytest.approx(2.4, abs=0.01)
    with pytest.raises(Exception):
        one(spark, x=fao.psychrometric_of(F.lit(4), F.lit(90.0)))
    polar = one(spark, a=fao.sunset_hour_angle(F.radians(F.lit(80.0)), fao.declination(F.lit(172))), b=fao.sunset_hour_angle(F.radians(F.lit(80.0)), fao.declination(F.lit(355))))
    assert polar.a == pytest.approx(math.pi) and polar.b == 0.0


def test_normal_functions_agree_with_the_library(spark):
    nd = statistics.NormalDist()
    x = [-8.0, -3.1, -0.4, 0.0, 1.7, 6.9, 40.0]
    p = [1e-9, 0.01, 0.024, 0.3, 0.5, 0.97, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.expr(normal.cdf_sql("x"))).collect()]
    assert got == pytest.approx([nd.cdf(v) for v in x], abs=1e-13) and list(normal.cdf(np.array(x))) == pytest.approx(got)
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(F.expr(normal.ppf_sql("p"))).collect()]
    assert got == pytest.approx([nd.inv_cdf(v) for v in p], rel=1e-7, abs=1e-9) and list(normal.ppf(np.array(p))) == pytest.approx(got)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(F.expr(normal.ppf_sql("p"))).collect()] == [None] * 3


def test_special_functions():
    assert special.gamma_cdf(np.array([1.0, 2.5]), 1.0) == pytest.approx([1 - math.exp(-1), 1 - math.exp(-2.5)], abs=1e-12)
    assert special.gamma_cdf(np.array([0.455]), 0.5)[0] == pytest.approx(math.erf(math.sqrt(0.455)), abs=1e-12)
    p = np.array([0.01, 0.4, 0.99])
    assert special.gamma_cdf(special.gamma_ppf(p, 2.3), 2.3) == pytest.approx(p, abs=1e-9)
    assert special.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert special.student_p(np.array([2.228]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-4)
    assert special.kolmogorov_p(1.358 / math.sqrt(10000), 10000) == pytest.approx(0.05, abs=0.002)
    k, s = special.gamma_fit(np.random.default_rng(1).gamma(2.0, 3.0, 20000))
    assert k == pytest.approx(2.0, rel=0.05) and s == pytest.approx(3.0, rel=0.05)
    assert math.isnan(special.gamma_fit(np.array([2.0, 2.0]))[0])


def days(spark, values, start=datetime.date(2000, 1, 30), qid=1):
    rows = [(qid, start + datetime.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "qid long, date date, pre double")


def test_spells_end_with_the_month(spark):
    d = days(spark, [5.0, 5.0, 5.0, 0.0, 5.0, 5.0, None, 5.0]).withColumn("wet", F.col("pre") > 1)
    got = sorted((r.month, r.start.day, r.days) for r in indices.spells(d, "wet").collect())
    assert got == [(1, 30, 2), (2, 1, 1), (2, 3, 2), (2, 6, 1)]
    assert sum(r[2] for r in got) == 6
    assert indices.spells(days(spark, [0.0, 0.0]).withColumn("wet", F.col("pre") > 1), "wet").count() == 0


def test_rain_indices_of_a_dry_month(spark):
    out = {r.index_name: r.value for r in indices.index_pre(days(spark, [0.0] * 20, datetime.date(2001, 3, 1))).collect()}
    assert out["rsum"] == 0 and out["rday"] == 0 and out["r_count_lt_p05"] == 20 and out["r_spell_lt_p05"] == 20 and out["r_spell_gt_p95"] == 0
    short = {r.index_name for r in indices.index_pre(days(spark, [1.0, 2.0], datetime.date(2001, 3, 1))).collect()}
    assert "pre48" in short and "pre72" not in short


def test_empty_tables(spark):
    none = days(spark, [])
    assert indices.index_pre(none).count() == 0 and distributions.ecdf(none, ["qid"], "pre").count() == 0
    assert indices.spei_ecdf(spark.createDataFrame([], "qid long, year int, month int, value double")).count() == 0


def test_l_moments_of_known_samples(spark):
    d = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 5)], "k int, value double")
    r = indices.l_moments(d, ["k"]).first()
    assert (r.l1, r.l2) == pytest.approx((3.0, 1.0)) and r.l3 == pytest.approx(0.0, abs=1e-12)


def test_ecdf_ties_and_between(spark):
    sample = spark.createDataFrame([(1, x) for x in (0.0, 0.0, 0.0, 1.0, 2.0, 2.0)], "k int, value double")
    points = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0)], "k int, value double")
    got = {r.value: r.p for r in distributions.ecdf_at(sample, points, ["k"]).collect()}
    assert got == pytest.approx({-1.0: 0.0, 0.0: 0.5, 0.5: 3.5 / 6, 1.0: 4 / 6, 2.0: 1.0, 3.0: 1.0})


def test_mapping_a_sample_to_itself_changes_nothing(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(k, max(0.0, rng.gauss(0, 3))) for k in (1, 2) for _ in range(80)], "k int, value double")
    assert all(abs(r.mapped - r.value) < 1e-9 for r in distributions.quantile_map(d, d, ["k"]).collect())
    assert all(abs(r.mapped - r.value) < 1e-9 for r in distributions.quantile_map_normal(d, d, ["k"]).collect())
    wet = d.filter("value > 0")
    assert all(abs(r.mapped - r.value) < 1e-6 * max(1, r.value) for r in distributions.quantile_map_gamma(wet, wet, ["k"]).collect())


def test_kumaraswamy_fit_returns_its_moments(spark):
    d = spark.createDataFrame([(0.3, 0.1), (0.5, 0.2), (0.7, 0.15)], "mean double, sd double")
    fitted = distributions.kuma_fit_moments(d, "mean", "sd")
    rows = distributions.kuma_moments(distributions.kuma_moments(fitted, "a", "b", 1).withColumnRenamed("moment", "m1"), "a", "b", 2).collect()
    assert all(r.m1 == pytest.approx(r["mean"], abs=1e-6) and math.sqrt(r.moment - r.m1**2) == pytest.approx(r.sd, abs=1e-6) for r in rows)


def test_trend_of_a_line(spark):
    d = spark.createDataFrame([(1, y, 3.0 + 2.0 * y) for y in range(12)], "k int, year int, value double")
    t = trend.theil_sen(d, ["k"], "year").first()
    assert (t.slope, t.intercept) == pytest.approx((2.0, 3.0)) and t.low == t.high == pytest.approx(2.0)
    m = trend.mann_kendall(d, ["k"], "year").first()
    assert m.tau == pytest.approx(1.0) and m.p < 1e-4
    flat = trend.mann_kendall(d.withColumn("value", F.lit(1.0)), ["k"], "year").first()
    assert flat.tau is None
    assert trend.linear_trend(d, ["k"], "year").first().slope == pytest.approx(2.0)


def test_patterns_rebuild_the_anomalies(spark):
    rng = np.random.default_rng(2)
    rows = [("pre", y, 2, q, float(rng.normal())) for y in range(9) for q in range(30)]
    a = seasonal.anomalies(spark.createDataFrame(rows, "variable string, year int, season int, qid long, value double"))
    eofs, pcs = seasonal.pca(a)
    assert seasonal.variance_explained(pcs).filter("mode = 7").first().cumulative == pytest.approx(1.0)
    back = pcs.join(eofs, ["variable", "season", "mode"]).groupBy("year", "qid").agg(F.sum(F.col("score") * F.col("loading")).alias("x"))
    assert back.join(a, ["year", "qid"]).agg(F.max(F.abs(F.col("x") - F.col("anom")))).first()[0] < 1e-9


def test_cholesky_gives_the_matrix_back(spark):
    r = [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)]
    low = {(x.var_i, x.var_j): x.l for x in seasonal.cholesky(spark.createDataFrame([(2, *x) for x in r], "season int, var_i string, var_j string, r double")).collect()}
    assert low["a", "a"] == pytest.approx(1.0) and low["b", "a"] * low["a", "a"] == pytest.approx(0.5) and low["b", "a"] ** 2 + low["b", "b"] ** 2 == pytest.approx(1.0)


def test_exact_trend_p_counts_orders(spark):
    """Against all orders of five values."""
    scores = [sum((b > a) - (b < a) for i, a in enumerate(x) for b in x[i + 1 :]) for x in itertools.permutations(range(5))]
    series = [(1, y, float(v)) for y, v in enumerate((1, 0, 2, 3, 4))] + [(2, y, float(v)) for y, v in enumerate((0, 3, 1, 4, 2))] + [(3, y, float(v)) for y, v in enumerate((1, 1, 2, 3, 4))]
    got = {r.k: r for r in trend.mann_kendall(spark.createDataFrame(series, "k int, year int, value double"), ["k"], "year", exact=True).collect()}
    for k in (1, 2):
        assert got[k].p == pytest.approx(sum(abs(s) >= abs(got[k].s) for s in scores) / len(scores))
    plain = {r.k: r for r in trend.mann_kendall(spark.createDataFrame(series, "k int, year int, value double"), ["k"], "year").collect()}
    assert got[3].p == plain[3].p and got[1].p != plain[1].p


def test_kumaraswamy_fit_to_quantiles_is_the_best_of_a_grid(spark):
    rng = np.random.default_rng(4)
    x = (1 - (1 - rng.random(4000)) ** (1 / 3.0)) ** (1 / 1.7)
    r = distributions.kuma_fit_quantiles(spark.createDataFrame([(1, float(v)) for v in x], "k int, value double"), ["k"]).first()
    p = np.array(distributions.KUMA_QUANTILES)
    loss = lambda a, b: float(((1 - (1 - np.quantile(x, p) ** a) ** b - p) ** 2).sum())
    assert loss(r.a, r.b) <= min(loss(a, b) for a in np.linspace(1.2, 2.2, 41) for b in np.linspace(2.2, 4.0, 41)) + 1e-9
    assert r.a == pytest.approx(1.7, rel=0.1) and r.b == pytest.approx(3.0, rel=0.15)


def test_all_indices_are_the_single_ones(spark):
    from fieldweave.jobs import load

    from .conftest import SF

    q = load()[0]
    rows = lambda d, *c: {tuple(r) for r in d.filter("value is not null").select("qid", "year", "month", *c).collect()}
    every = q["index_pre_all"](spark, SF).cache()
    assert rows(q["index_pre"](spark, SF), "index_name", "value") <= rows(every, "index_name", "value")
    assert rows(q["index_pre_eto"](spark, SF), "index_name", "value") <= rows(every, "index_name", "value")
    got = rows(every.filter("index_name = 'spi3'"), "value")
    want = {(r.qid, r.year, r.month, r.spi) for r in q["spi"](spark, SF).collect() if r.spi is not None}
    assert len(got) == len(want) and {x[:3] for x in got} == {x[:3] for x in want}
    assert {r.index_name for r in every.select("index_name").distinct().collect()} >= {"spi1", "spi3", "spi6", "eto", "spei1", "spei3", "spei6"}


def test_gamma_mapping_keeps_dry_days(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(np.concatenate([np.zeros(50), rng.gamma(2.0, 3.0, 150)]))], "qid int, i int, value double")
    out = distributions.quantile_map_gamma(d, d.withColumn("value", F.col("value") * 2), ["qid"]).collect()
    assert len(out) == 200 and all(r.mapped == 0 for r in out if r.value == 0)
    assert all(r.mapped == pytest.approx(2 * r.value, rel=1e-6) for r in out if r.value > 0)


def test_generator_gives_its_seasons_back(spark):
    """With the historic scores in place of simulated ones, the chain gives the historic values of more than four cells."""
    rng = np.random.default_rng(6)
    rows = [("pre", y, 2, q, float(v)) for q in range(20) for y, v in enumerate(rng.gamma(3.0, 2.0, 12))]
    hist = spark.createDataFrame(rows, "variable string, year int, season int, qid long, value double").cache()
    powers = seasonal.boxcox_fit(hist, shift=1.0).cache()
    d = hist.join(powers, ["variable", "season", "qid"]).withColumn("value", seasonal.boxcox(F.col("value"), F.col("power"), 1.0))
    anom = seasonal.anomalies(d.select(*hist.columns)).cache()
    eofs, pcs = seasonal.pca(anom)
    out = seasonal.synthesise(pcs, eofs, anom.select("variable", "season", "qid", "mean", "sd").distinct(), blocks=3)
    back = seasonal.finished(out.join(powers.select("variable", "season", "qid", "power"), ["variable", "season", "qid"]), {"pre": (0.0, 12.0)}, shift=1.0)
    got = back.withColumnRenamed("value", "x").join(hist, ["variable", "season", "year", "qid"]).collect()
    assert len(got) == 240 and all(r.x == pytest.approx(min(r.value, 12.0), rel=1e-5) for r in got)
    draws = seasonal.random_modes(pcs.select("variable", "season", "mode").distinct(), pcs.select("year").distinct(), "1", stored=pcs.withColumnRenamed("score", "z").filter("year < 5")).collect()
    held = {(r.year, r.mode): r.score for r in pcs.collect()}
    assert all((r.z == held[r.year, r.mode]) == (r.year < 5) for r in draws)


def test_monthly_indices_exchange_days_once(spark):
    from fieldweave.operators import indices

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = days(spark, [1.0, 2.0, 3.0] * 40).withColumns({"tmax": F.lit(20.0), "tmin": F.lit(10.0)})
        for out in (indices.index_pre(d), indices.index_tmp(d)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_seasons_wrap_around_the_year(spark):
    d = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = [r.s for r in d.select(seasonal.season_of(F.col("m")).alias("s"), "m").orderBy("m").collect()]
    assert got == [2, 2, 5, 5, 5, 8, 8, 8, 11, 11, 11, 2]
    got = [r.s for r in d.select(seasonal.season_of(F.col("m"), (3, 7, 11)).alias("s"), "m").orderBy("m").collect()]
    assert got == [3, 3, 3, 7, 7, 7, 7, 11, 11, 11, 11, 3]


def test_scaled_days_add_up_to_the_simulated_season(spark):
    daily = days(spark, [1.0, 2.0, 3.0] * 40, datetime.date(1999, 12, 1)).withColumns({"tmax": F.lit(20.0), "tmin": F.lit(10.0)})
    hist = rebuild.keyed(daily).groupBy("qid", F.col("season_year").alias("year"), "season").agg(F.sum("pre").alias("value")).withColumn("variable", F.lit("pre"))
    stoc = hist.filter("season = 2").withColumns({"year": F.lit(2100), "value": F.col("value") * 3})
    ssf = rebuild.scaling_factors(spark.createDataFrame([(2, 2100, 2000)], "season int, year int, histyear int"), hist, stoc)
    out = rebuild.disaggregate(daily, ssf)
    assert out.agg(F.sum("pre")).first()[0] == pytest.approx(stoc.first().value)
    assert {(r.year, r.m) for r in out.select("year", F.month("date").alias("m")).distinct().collect()} == {(2099, 12), (2100, 1), (2100, 2)}


def test_climate_text(spark):
    text = " 1950 1951\n 1950 " + " ".join(f"{i}.5" for i in range(12)) + "\n1951 " + " ".join(["-99.9"] * 11 + ["7"]) + "\n  -99.9\nend of file"
    rows = tables.parse_climate_text(spark.createDataFrame([("x", text)], "index_name string, text string")).orderBy("year", "month").collect()
    assert len(rows) == 24 and rows[3].value == 3.5 and rows[12].value is None and rows[23].value == 7.0


def test_plans_have_no_single_partition_and_no_python(spark):
    from fieldweave.jobs import load

    from .conftest import SF

    for name in ("index_pre", "index_tmp", "disaggregate_daily", "quantile_map_empirical", "similarity_ks", "ll_to_qid"):
        df = load()[0][name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Python" not in plan and "Pandas" not in plan, name
