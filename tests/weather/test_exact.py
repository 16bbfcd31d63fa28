"""Exact p-values, trends of long series, masks by blocks and patterns of cells with gaps, against brute force."""

from __future__ import annotations

import itertools
import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import special
from fieldweave.operators import grid, seasonal, trend


def orders(n, m):
    """How many of all orders of n and m values have each distance, as |i m - j n|."""
    out: dict[int, int] = {}
    for c in itertools.combinations(range(n + m), n):
        i = j = d = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in c else (i, j + 1)
            d = max(d, abs(i * m - j * n))
        out[d] = out.get(d, 0) + 1
    return out


@pytest.mark.parametrize("n,m", [(1, 1), (1, 6), (3, 5), (4, 6), (7, 2), (8, 8), (8, 7)])
def test_two_sample_p_counts_all_orders(n, m):
    counts = orders(n, m)
    for d in counts:
        assert abs(special.two_sample_p(d / (n * m), n, m) - sum(v for k, v in counts.items() if k >= d) / comb(n + m, n)) < 1e-12
    assert special.two_sample_p(0.0, n, m) == 1.0


def test_two_sample_p_is_not_the_asymptotic_one():
    assert abs(special.two_sample_p(0.5, 6, 6) - special.kolmogorov_p(0.5, 3)) > 0.05
    assert abs(special.two_sample_p(0.03, 5000, 5000) - special.kolmogorov_p(0.03, 2500)) < 1e-3
    assert 0 < special.two_sample_p(1.0, 40, 40) == pytest.approx(2 / comb(80, 40), rel=1e-9)


def test_one_sample_p_has_the_published_values():
    for d, n, inside in ((0.274, 10, 0.6284796154565043), (0.04, 2000, 0.99676943191713677), (0.016, 16000, 0.99945234913828052)):
        assert abs(1 - special.kolmogorov_exact_p(d, n, 20_000) - inside) < 1e-10
    # One value: the distance is at least d with probability 2 (1 - d) for d over a half; two values have a form of their own.
    for d in (0.5, 0.6, 0.9, 0.99):
        assert abs(special.kolmogorov_exact_p(d, 1) - 2 * (1 - d)) < 1e-14 and abs(special.kolmogorov_exact_p(d, 2) - 2 * (1 - d) ** 2) < 1e-14
    for d in (0.26, 0.3, 0.4, 0.49):
        assert abs(1 - special.kolmogorov_exact_p(d, 2) - 2 * (2 * d - 0.5) ** 2) < 1e-13
    assert special.kolmogorov_exact_p(0.0, 5) == 1.0 and special.kolmogorov_exact_p(1.0, 5) == 0.0 and special.kolmogorov_exact_p(0.05, 10) == 1.0


def test_one_sample_p_goes_on_smoothly_where_its_form_changes():
    for n in (5, 30, 200):
        p = [special.kolmogorov_exact_p(float(d), n) for d in np.linspace(0.01, 0.99, 300)]
        assert all(a >= b - 1e-12 for a, b in zip(p, p[1:]))


def test_p_columns(spark):
    d = spark.createDataFrame([(0.5, 6, 6), (0.5, 6, 6), (None, 3, 3)], "d double, n_hist long, n_stoc long")
    assert [r.p for r in seasonal.with_two_sample_p(d).collect()] == [special.two_sample_p(0.5, 6, 6)] * 2 + [None]
    one = seasonal.with_kolmogorov_p(d, F.col("n_hist")).collect()
    assert one[0].p == special.kolmogorov_exact_p(0.5, 6) and one[2].p is None


def series(kind, n, rng):
    return [rng.standard_normal(n), rng.integers(0, 4, n).astype(float), np.where(rng.random(n) < 0.6, 0, rng.random(n).round(2)), np.full(n, 3.0)][kind]


@pytest.mark.parametrize("kind", range(4))
def test_orders_and_slopes_are_the_brute_force_ones(kind):
    rng = np.random.default_rng(kind)
    for n in (2, 3, 10, 77, 600):
        x, t = series(kind, n, rng), np.arange(n, dtype=float)
        i, j = np.triu_indices(n, 1)
        slopes = np.sort((x[j] - x[i]) / (t[j] - t[i]))
        assert trend.kendall_s(x) == np.sign(x[j] - x[i]).sum()
        places = sorted({0, len(slopes) // 3, len(slopes) // 2, len(slopes) - 1})
        for most in (20, 300_000):
            assert np.allclose(trend.nth_slopes(t, x, places, most), slopes[places], atol=1e-12)


def test_daily_trends_of_forty_years(spark):
    rng = np.random.default_rng(9)
    rows = [(q, k, float(v)) for q in range(3) for k, v in enumerate(rng.standard_normal(14_600) + np.arange(14_600) * 0.001 * (q - 1))]
    df = spark.createDataFrame(rows, "qid long, day long, value double")
    found = {r.qid: r for r in trend.theil_sen(df, ["qid"], "day").collect()}
    assert all(r.low < 0.001 * (q - 1) < r.high and abs(r.slope - 0.001 * (q - 1)) < 1e-5 for q, r in found.items())
    tau = {r.qid: r.tau for r in trend.mann_kendall(df, ["qid"], "day").collect()}
    assert tau[0] < -0.5 and abs(tau[1]) < 0.05 and tau[2] > 0.5


def brute_inside(ring, x, y, buff):
    odd, gap = False, 1e9
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
        t = min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / max((x2 - x1) ** 2 + (y2 - y1) ** 2, 1e-300), 0), 1)
        gap = min(gap, ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5)
    return odd or gap <= buff


@pytest.mark.parametrize("up", [0, 2, 4])
def test_masks_by_blocks_are_the_brute_force_ones(spark, up):
    rng = random.Random(8)
    rings = {"world": [(-179.5, -80.2), (179.5, -80.2), (179.5, 80.2), (-179.5, 80.2)], "dateline": [(170.3, -10.1), (195.2, -12.7), (188.1, 20.4)], "west": [(-190.3, 60.2), (-170.1, 61.0), (-175.2, 72.9)], "pole": [(-30.0, 70.0), (40.0, 75.0), (10.0, 95.0)], "dot": [(5.1, 5.1), (5.2, 5.1), (5.15, 5.2)]}
    for k in range(4):
        x, y = rng.uniform(-150, 150), rng.uniform(-60, 60)
        rings[f"star{k}"] = [(x + rng.uniform(5, 20) * np.cos(a), y + rng.uniform(5, 20) * np.sin(a)) for a in np.linspace(0, 6, 9)]
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in rings.items()] + [("none", [])], "name string, ring array<struct<lon: double, lat: double>>")
    cells = grid.make_grid(spark, 4.0)
    out = grid.polygon_cells(cells, df, 4.0, 0.3, up=up)
    got = {(r.name, r.qid) for r in out.collect()}
    want = {(name, c.qid) for c in cells.collect() for name, ring in rings.items() if any(brute_inside(ring, c.lon + turn, c.lat, 0.3) for turn in (-360, 0, 360))}
    assert got == want and out.count() == len(got)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_patterns_keep_groups_with_gaps(spark):
    rng = np.random.default_rng(4)
    full = [("pre", 2, y, q, float(v)) for q in range(6) for y, v in enumerate(rng.standard_normal(5))]
    df = spark.createDataFrame(full, "variable string, season int, year int, qid long, anom double")
    gaps = [r for r in full if (r[2], r[3]) != (3, 5)] + [("pre", 2, 0, 7, None), ("pre", 2, 4, 8, 1.0)]
    want = seasonal.pca(df.filter("qid < 5"))
    got = seasonal.pca(spark.createDataFrame(gaps, df.schema))
    rows = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=str)
    assert rows(got[1]) == rows(want[1]) and rows(got[0]) == rows(want[0])
    with pytest.raises(ValueError, match="pre, season 2"):
        seasonal.pca(df.filter("qid < 5 and year <> qid"))


def test_patterns_of_many_years_without_a_matrix_of_years(spark):
    """300 years of 40 cells: the leading modes are those of the plain decomposition, from blocks of 8 directions."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 300)) * np.geomspace(9, 0.5, 40)[:, None]
    df = spark.createDataFrame([("pre", 2, y, q, float(x[q, y])) for q in range(40) for y in range(300)], "variable string, season int, year int, qid long, anom double")
    eofs, pcs = seasonal.pca(df, modes=4, block=8)
    u, size, vt = np.linalg.svd(x, full_matrices=False)
    got = pcs.toPandas().pivot(index="mode", columns="year", values="score").to_numpy()
    want = size[:4, None] * vt[:4]
    want *= np.sign(want[np.arange(4), np.abs(want).argmax(axis=1)])[:, None]
    assert np.abs(got - want).max() < 1e-8
    loads = eofs.toPandas().pivot(index="qid", columns="mode", values="loading").to_numpy()
    assert loads.shape == (40, 4) and np.abs(loads @ got - u[:, :4] * size[:4] @ vt[:4]).max() < 1e-8
    every = seasonal.pca(df, block=16)[1].toPandas().pivot(index="mode", columns="year", values="score").to_numpy()
    assert every.shape == (40, 300) and np.abs(np.linalg.norm(every, axis=1) - size).max() < 1e-8
