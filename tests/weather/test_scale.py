"""Dense places, stored cubes, percentiles of many values and fits of many groups, against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import special
from fieldweave.jobs import load
from fieldweave.operators import analytics, distributions, grid, indices, rebuild, seasonal
from fieldweave.sources import tables
from fieldweave.sources.scratch import scratch

from .conftest import SF


def test_pairs_of_a_city_are_spread_over_tiles(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(600)]
    points += [(1000 + i, 13.4 + rng.uniform(-0.5, 0.5), 52.5 + rng.uniform(-0.3, 0.3)) for i in range(600)]
    p = spark.createDataFrame(points, "id long, lon double, lat double")
    got = grid.pairs_within(p, p, 40.0, tile=50).select("id_a", "id_b")
    want = grid.distances(p, p).filter(F.col("km") <= 40.0).select("id_a", "id_b")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    for side, most in zip(grid.binned(p, p, 40.0, tile=50), (120, 120)):
        assert side.groupBy(*grid.TILE).count().agg(F.max("count")).first()[0] <= most


def test_pairs_of_an_empty_set(spark):
    p = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lon double, lat double")
    assert grid.pairs_within(p, p.limit(0), 10.0).count() == 0 == grid.pairs_within(p.limit(0), p, 10.0).count()
    assert [tuple(r) for r in grid.pairs_within(p, p, 10.0).collect()] == [(1, 1, 0.0)]


BOXES = [(-60.0, -30.0, 80.0, 30.0), (170.0, 10.0, -165.0, 40.0), (-180.0, -90.0, 180.0, 90.0), (3.1, 3.2, 3.2, 3.3), (-1.0, -1.0, 1.0, 1.0)]


@pytest.mark.parametrize("most", [1, 8, 32, 200])
def test_ranges_hold_their_box(spark, most):
    cells = grid.make_grid(spark, 2.0).toPandas()
    for west, south, east, north in BOXES:
        across = cells.lon.between(west, east) if west <= east else (cells.lon >= west) | (cells.lon <= east)
        want = set(cells[across & cells.lat.between(south, north)].qid)
        ranges = grid.box_ranges(west, south, east, north, 2.0, most)
        assert len(ranges) <= max(most, 2) and all(a <= b < c for (a, b), (c, _) in zip(ranges, ranges[1:]))
        assert want <= {q for q in cells.qid if any(a <= q <= b for a, b in ranges)}


def test_a_box_of_a_cube_reads_its_own_files(spark):
    cells = grid.make_grid(spark, 1.0)
    path = scratch(spark, "cube")
    tables.write_cube(cells.select("qid", F.col("qid").cast("double").alias("value")), path, 1.0, 16)
    for box in BOXES:
        west, south, east, north = box
        across = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
        want = {r.qid for r in cells.filter(across & F.col("lat").between(south, north)).collect()}
        assert {r.qid for r in tables.read_cube(spark, path, box, 1.0).collect()} == want
    near = tables.read_cube(spark, path, (10.0, 10.0, 12.0, 12.0), 1.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(qid" in plan
    assert near.select(F.input_file_name()).distinct().count() == 1 < tables.read_cube(spark, path).select(F.input_file_name()).distinct().count()


def test_percentiles_by_ranges_are_exact(spark):
    rng = random.Random(8)
    rows = [("many", rng.gauss(0, 1)) for _ in range(3000)] + [("ties", float(rng.randrange(4))) for _ in range(999)]
    rows += [("zeros", 0.0 if rng.random() < 0.9 else rng.expovariate(1)) for _ in range(500)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None), ("two", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.0001, 0.1, 0.25, 0.5, 1 / 3, 0.9, 0.999, 1.0]
    want = {(r.k, i): v for r in d.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect() if r.q for i, v in enumerate(r.q)}
    for bins in (4, 64):
        rows = analytics.percentiles(d, ["k"], "v", probs, bins).collect()
        assert {(r.k, r.i): r.value for r in rows} == want
        assert {r.k: r.n for r in rows} == {"many": 3000, "ties": 999, "zeros": 500, "one": 1, "two": 2}


def moment(n, a, b):
    return b * math.exp(math.lgamma(1 + n / a) + math.lgamma(b) - math.lgamma(1 + n / a + b))


def test_kuma_fits_of_a_batch(spark):
    rng = random.Random(5)
    rows = [(i, moment(1, a, b), math.sqrt(moment(2, a, b) - moment(1, a, b) ** 2), a, b) for i, (a, b) in enumerate((rng.uniform(0.3, 9), rng.uniform(0.3, 40)) for _ in range(300))]
    rows += [(1000, 0.15, 0.15 * 0.13, None, None), (1001, None, 0.1, None, None), (1002, 0.5, 0.6, None, None), (1003, 0.5, 0.0, None, None)]
    out = {r.id: r for r in distributions.kuma_fit_moments(spark.createDataFrame([(i, m, s, x, y) for i, m, s, x, y in rows], "id int, mean double, sd double, a0 double, b0 double"), "mean", "sd").collect()}
    assert all(abs(out[i].a / a - 1) < 1e-6 and abs(out[i].b / b - 1) < 1e-6 for i, _, _, a, b in rows if a)
    far = out[1000]  # b is very large here
    assert abs(moment(1, far.a, far.b) - far.mean) < 1e-6 and abs(moment(2, far.a, far.b) - far.mean**2 - far.sd**2) < 1e-6
    assert all(out[i].a is None and out[i].b is None for i in (1001, 1002, 1003))


def test_kuma_grid_has_its_means_and_variations(spark):
    out = distributions.kuma_grid(spark.range(2), (0.1, 0.5, 0.7), (0.2, 0.5, 1.2)).collect()
    assert len(out) == 2 * 7 and {(r.mean, r.cv) for r in out} == {(m, c) for m in (0.1, 0.5, 0.7) for c in (0.2, 0.5, 1.2) if (m * c) ** 2 < m * (1 - m)}
    for r in out:
        m1, m2 = moment(1, r.a, r.b), moment(2, r.a, r.b)
        assert abs(m1 - r.mean) < 1e-8 and abs(math.sqrt(m2 - m1 * m1) / m1 - r.cv) < 1e-6


def test_kuma_quantile_fit_finds_its_distribution(spark):
    u = (np.arange(4000) + 0.5) / 4000
    want = {0: (2.0, 3.0), 1: (0.7, 1.4), 2: (5.0, 1.0)}
    rows = [(k, float(x)) for k, (a, b) in want.items() for x in (1 - (1 - u) ** (1 / b)) ** (1 / a)]
    out = distributions.kuma_fit_quantiles(spark.createDataFrame(rows + [(3, None)], "k int, value double"), ["k"]).collect()
    assert {r.k for r in out} == set(want) and all(abs(r.a / want[r.k][0] - 1) < 5e-3 and abs(r.b / want[r.k][1] - 1) < 5e-3 for r in out)


def genlogistic_loss(x, loc, scale):
    """Negative log-likelihood with the best c for a location and scale."""
    z = (x - loc) / scale
    soft = np.logaddexp(0, -z)
    c = len(x) / soft.sum()
    return -(len(x) * np.log(c / scale) - z.sum() - (c + 1) * soft.sum())


def test_likeliest_logistic_is_the_best_of_a_grid(spark):
    rng = np.random.default_rng(4)
    draw = lambda c, loc, scale, n: loc - scale * np.log(rng.uniform(size=n) ** (-1 / c) - 1)
    groups = {k: draw(*p, 40) for k, p in enumerate([(1, 3, 2), (0.3, -5, 1), (6, 100, 10), (1, 1e6, 1e-2)])}
    groups |= {10: rng.exponential(size=30), 11: -rng.exponential(size=30), 12: np.array([0.0] * 7 + [50.0]), 13: np.array([1.0, 2.0]), 20: np.array([2.0] * 5), 21: np.array([1.5])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(0, None), (30, None)]
    out = {r.k: r for r in distributions.genlogistic_fit(spark.createDataFrame(rows, "k int, value double"), ["k"]).collect()}
    assert set(out) == set(groups) and all(out[k].loc is None and out[k].scale is None and out[k].c is None for k in (20, 21))
    for k, x in groups.items():
        if k >= 20:
            continue
        z = (x - out[k].loc) / out[k].scale
        assert abs(out[k].c / (len(x) / np.logaddexp(0, -z).sum()) - 1) < 1e-8
        got = genlogistic_loss(x, out[k].loc, out[k].scale)
        near = [genlogistic_loss(x, out[k].loc + a * out[k].scale, out[k].scale * math.exp(b)) for a in (-1e-3, 0, 1e-3) for b in (-1e-3, 0, 1e-3)]
        wide = [genlogistic_loss(x, x.mean() + a * x.std(), math.exp(b) * x.std()) for a in np.linspace(-3, 3, 25) for b in np.linspace(-3, 2, 21)]
        assert got <= min(near + wide) + 1e-5


def test_likeliest_logistic_finds_its_distribution():
    u = (np.arange(20000) + 0.5) / 20000
    want = [(3.0, 2.0, 1.0), (-5.0, 1.0, 0.3), (100.0, 10.0, 6.0)]
    x = np.concatenate([loc - scale * np.log(u ** (-1 / c) - 1) for loc, scale, c in want])
    got = distributions._genlogistic_fits(x, np.array([0, 20000, 40000]))
    assert all(abs(a - b) <= 2e-2 * s for g, w in zip(got, want) for a, b, s in zip(g, w, (w[1], w[1], w[2])))


def test_spei_by_likelihood_is_the_normal_score_of_its_cdf(spark):
    rng = np.random.default_rng(6)
    rows = [(q, 1990 + y, m, float(rng.normal(m, 2))) for q in (1, 2) for y in range(25) for m in range(1, 13)]
    balance = spark.createDataFrame([*rows, *[(3, 1990 + y, m, 1.0) for y in range(4) for m in range(1, 13)]], "qid int, year int, month int, value double")
    out = distributions.spei_mle(balance).toPandas()
    sums = indices.rolling_month(balance, 3).toPandas()
    assert len(out) == len(sums) and out[out.qid == 3].spei.isna().all() and out[out.qid < 3].spei.notna().all()
    from statistics import NormalDist

    for _, g in out[out.qid < 3].groupby(["qid", "month"]):
        x = g.value.to_numpy()
        loc, scale, c = distributions._genlogistic_fits(x, np.array([0]))[0]
        p = np.exp(-c * np.logaddexp(0, -(x - loc) / scale))  # c is very large where a Gumbel fits best
        assert np.allclose([NormalDist().inv_cdf(v) for v in p], g.spei, atol=1e-6)
        assert abs(g.spei.mean()) < 0.15 and 0.8 < g.spei.std() < 1.2


def test_boxcox_power_is_the_best_of_all(spark):
    rng = np.random.default_rng(9)
    groups = {(s, q): rng.lognormal(1, 0.6, 24) if q == 1 else rng.uniform(5, 9, 24) for s in (2, 8) for q in (1, 2)}
    groups[2, 3] = np.array([4.0])
    groups[2, 4] = np.array([4.0, 4.0, 4.0])
    d = spark.createDataFrame([("pre", s, q, 1980 + i, float(x)) for (s, q), v in groups.items() for i, x in enumerate(v)], "variable string, season int, qid long, year int, value double")
    out = {(r.season, r.qid): r for r in seasonal.boxcox_fit(d).collect()}
    assert set(out) == set(groups)
    for k, v in groups.items():
        if k[1] > 2:
            assert out[k].power is None and out[k].d is None
            continue
        best = None
        for i in range(500):
            p = round(0.001 + 0.002 * i, 3)
            y = [(x**p - 1) / p for x in sorted(v)]
            mean = sum(y) / len(y)
            sd = math.sqrt(sum((a - mean) ** 2 for a in y) / (len(y) - 1))
            dist = max(abs((j + 1) / len(y) - 0.5 * math.erfc(-(a - mean) / sd / math.sqrt(2))) for j, a in enumerate(y))
            if best is None or dist < best[1] - 1e-12:
                best = (p, dist)
        assert abs(out[k].d - best[1]) < 1e-9 and abs(out[k].power - best[0]) < 1e-9


def gamma_cdf(x, shape):
    """The lower incomplete gamma by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / shape
    k = shape
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + shape * math.log(x) - math.lgamma(shape))


def test_gamma_mapping_with_a_point_mass(spark):
    rng = np.random.default_rng(11)
    rain = lambda shape, scale, dry, n: [0.0 if rng.uniform() < dry else float(rng.gamma(shape, scale)) for _ in range(n)]
    for dry0, dry1 in ((0.6, 0.3), (0.2, 0.5)):
        source, target = rain(1.4, 6.0, dry0, 300), rain(0.9, 11.0, dry1, 300)
        s, t = (spark.createDataFrame([(1, x) for x in v], "qid int, value double") for v in (source, target))
        f = [distributions.fit_distribution(d, ["qid"]).first() for d in (s, t)]
        for r, v in zip(f, (source, target)):
            wet = np.array([x for x in v if x > 0])
            assert r.p0 == sum(x <= 1.0 for x in v) / len(v) and abs(r.shape * r.scale - wet.mean()) < 1e-9
            # The likeliest gamma: log(shape) less its digamma is log of the mean less the mean of logs.
            digamma = (math.lgamma(r.shape + 1e-5) - math.lgamma(r.shape - 1e-5)) / 2e-5
            assert abs(math.log(r.shape) - digamma - (math.log(wet.mean()) - np.log(wet).mean())) < 1e-6
        p0 = min(f[0].p0, f[1].p0)
        for r in distributions.quantile_map_gamma(s, t, ["qid"], dry=True).collect():
            c = p0 + (1 - p0) * gamma_cdf(r.value / f[0].scale, f[0].shape) if r.value > 0 else p0
            c = max((c - f[1].p0) / (1 - f[1].p0), 0.0)
            assert r.mapped >= 0 and (r.mapped == 0 if c == 0 else abs(gamma_cdf(r.mapped / f[1].scale, f[1].shape) - c) < 1e-9)


def student_tail(t, df):
    """Two-sided, by adding up the density in t = sqrt(df) tan(a)."""
    a = math.atan(abs(t) / math.sqrt(df))
    n = 20000
    inside = sum(math.cos((k + 0.5) * a / n) ** (df - 1) for k in range(n)) * a / n
    return 1 - 2 * inside * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_p_of_correlations(spark):
    rows = [(i, n, r) for i, (n, r) in enumerate([(3, 0.5), (5, -0.7), (12, 0.05), (40, 0.6), (200, 0.1)])]
    for r in seasonal.with_correlation_p(spark.createDataFrame(rows, "i int, n long, r double")).collect():
        t = r.r * math.sqrt((r.n - 2) / (1 - r.r**2))
        assert abs(r.t - t) < 1e-12 and abs(r.p - student_tail(t, r.n - 2)) < 1e-7
    for n, x in ((1, 0.0), (2, 1.0), (2, 0.5), (5, 1.0), (5, -1.0), (4, None)):
        r = seasonal.with_correlation_p(spark.createDataFrame([(n, x)], "n long, r double")).first()
        assert r.t is None and r.p is None
    assert special.student_p(np.array([0.0]), np.array([3.0]))[0] == pytest.approx(1.0)


def over_scans(plan, name):
    """For each scan of `name` in a printed plan, what is done to its rows, up to the sums over them."""
    lines = [(line.index(bare := line.lstrip(" :+-*()0123456789")), bare) for line in plan.splitlines() if line.strip()]
    for i, (depth, line) in enumerate(lines):
        if line.startswith("FileScan") and name in line:
            path, sums = [], 0
            for d, above in reversed(lines[:i]):
                if d < depth and sums < 2:
                    depth = d
                    path.append(above.split("(")[0].split(" ")[0])
                    sums += above.startswith("HashAggregate")
            yield path


def test_stored_history_is_never_exchanged(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = load()[0]["rebuild_days"](spark, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        paths = list(over_scans(plan, "history_"))
        assert len(paths) == 3 and sum("SortMergeJoin" in p for p in paths) == 2 and "Bucketed: true" in plan
        assert not any("Exchange" in step for p in paths for step in p)
        assert out.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("history", "factors"))]


def test_days_from_a_stored_history_are_those_of_stored_factors(spark):
    from fieldweave.jobs import monthly
    from fieldweave.sources.examples import example

    hist, ssf = example(spark, SF, "weather_hist"), monthly._ssf(spark, SF)
    got = rebuild.rebuilt_from_seasons(hist, ssf)
    want = rebuild.rebuilt(hist, ssf, rebuild.eto_factors(hist, rebuild.disaggregate(hist, ssf)))
    shown = lambda d: d.select("qid", "year", "date", *[F.round(c, 9).alias(c) for c in ("pre", "tmax", "tmin", "eto")])
    assert got.count() > 0 and got.columns == want.columns
    assert shown(got).exceptAll(shown(want)).count() == 0 == shown(want).exceptAll(shown(got)).count()
