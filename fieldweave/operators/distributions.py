"""Empirical and fitted distributions, quantile mapping, and price paths.

The empirical cdf has knots k/n at the sorted values; ties take the highest
rank. Mapping a value to a quantile of another sample needs that sample's order
statistics on both sides of a position, found by equality joins on ranks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal, special


def ecdf(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """`values` with `p`, the empirical cdf at each of its own values."""
    return values.withColumn("p", F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))


def ecdf_at(sample: DataFrame, points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """`points` with `p`, the interpolated empirical cdf of `sample` at new values; 0 below, 1 above.

    Sample and points are sorted together, and each point looks back and ahead
    to its neighbours among the knots, so no range join is needed.
    """
    knots = ecdf(sample.select(*keys, value), keys, value).distinct().select(*keys, F.col(value).alias("_x"), F.col("p").alias("_p"))
    both = knots.withColumn("_kind", F.lit(0)).unionByName(points.withColumn("_x", F.col(value)).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_x", "_kind")
    knot = lambda c: F.when(F.col("_kind") == 0, F.col(c))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = both.withColumns({
        "_x0": F.last(knot("_x"), True).over(back), "_p0": F.last(knot("_p"), True).over(back),
        "_x1": F.first(knot("_x"), True).over(ahead), "_p1": F.first(knot("_p"), True).over(ahead),
    })
    between = F.col("_p0") + F.coalesce(F.try_divide(F.col("_x") - F.col("_x0"), F.col("_x1") - F.col("_x0")), F.lit(0.0)) * (F.col("_p1") - F.col("_p0"))
    p = F.when(F.col("_x0").isNull(), 0.0).when(F.col("_x1").isNull(), 1.0).otherwise(between)
    return d.filter("_kind = 1").select(*points.columns, p.alias("p"))


def at_probability(sample: DataFrame, wanted: DataFrame, keys: list[str], value: str = "value", p: str = "p") -> DataFrame:
    """`wanted` with `mapped`, the empirical quantile of `sample` at `p`: knots (k/n, k-th value), the least below 1/n."""
    w = Window.partitionBy(*keys)
    ranks = sample.select(*keys, F.col(value).alias("_x"), F.row_number().over(w.orderBy(value)).alias("_k"), F.count("*").over(w).alias("_n"))
    sizes = ranks.groupBy(*keys).agg(F.first("_n").alias("_n"))
    d = wanted.join(sizes, keys).withColumn("_at", F.greatest(F.col(p) * F.col("_n"), F.lit(1.0)))
    d = d.withColumns({"_lo": F.floor("_at").cast("int"), "_hi": F.least(F.ceil("_at"), F.col("_n")).cast("int")})
    low = ranks.select(*keys, F.col("_k").alias("_lo"), F.col("_x").alias("_xl"))
    high = ranks.select(*keys, F.col("_k").alias("_hi"), F.col("_x").alias("_xh"))
    d = d.join(low, [*keys, "_lo"]).join(high, [*keys, "_hi"])
    return d.select(*wanted.columns, (F.col("_xl") + (F.col("_at") - F.col("_lo")) * (F.col("_xh") - F.col("_xl"))).alias("mapped"))


def quantile_map(source: DataFrame, target: DataFrame, keys: list[str], value: str = "value", wet: float | None = None) -> DataFrame:
    """`source` with `mapped`: each value at its own cdf, read from the target's quantiles; below `wet` counts as zero first."""
    if wet is not None:
        dry = F.when(F.col(value) >= wet, F.col(value)).otherwise(0.0)
        source, target = source.withColumn(value, dry), target.withColumn(value, dry)
    return at_probability(target, ecdf(source, keys, value), keys, value).drop("p")


def quantile_map_normal(source: DataFrame, target: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """`source` with `mapped` through two fitted normals, which is a change of location and scale."""
    moments = lambda d, s: d.groupBy(*keys).agg(F.avg(value).alias(f"_m{s}"), F.stddev_pop(value).alias(f"_s{s}"))
    d = source.join(moments(source, 0), keys).join(moments(target, 1), keys)
    z = F.try_divide(F.col(value) - F.col("_m0"), F.col("_s0"))
    return d.select(*source.columns, (z * F.col("_s1") + F.col("_m1")).alias("mapped"))


def fit_distribution(values: DataFrame, keys: list[str], value: str = "value", thresh: float = 1.0) -> DataFrame:
    """(keys, n, mean, sd, p0, shape, scale): normal moments (population), the share at or below `thresh`, a gamma of the positive values.

    Sums and counts are aggregated by Spark; only one row per group meets numpy.
    """
    x = F.col(value)
    a = values.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.avg(F.when(x <= thresh, 1.0).otherwise(0.0)).alias("p0"),
        F.avg(F.when(x > 0, x)).alias("_m"), F.avg(F.when(x > 0, F.ln(F.when(x > 0, x)))).alias("_l"),
    )

    @F.pandas_udf("double")
    def shape(m: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        with np.errstate(all="ignore"):
            s = np.log(m.to_numpy(float)) - l.to_numpy(float)
            s = np.where(s > 1e-12, s, np.nan)
            k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
            for _ in range(30):
                slope = 1 / k - (special.digamma(k + 1e-5) - special.digamma(k - 1e-5)) / 2e-5
                k = np.maximum(k - (np.log(k) - special.digamma(k) - s) / slope, k / 4)
        return pd.Series(k)

    a = a.withColumn("shape", F.nanvl(shape("_m", "_l"), F.lit(None).cast("double")))
    return a.withColumn("scale", F.try_divide("_m", "shape")).drop("_m", "_l")


def quantile_map_gamma(source: DataFrame, target: DataFrame, keys: list[str], value: str = "value", dry: bool = False, thresh: float = 1.0) -> DataFrame:
    """`source` with `mapped` through fitted gammas; with `dry`, a point mass at zero holds the share at or below `thresh`."""
    side = lambda d, s: fit_distribution(d, keys, value, thresh).select(*keys, *[F.col(c).alias(f"_{c}{s}") for c in ("p0", "shape", "scale")])
    d = source.join(side(source, 0), keys).join(side(target, 1), keys)

    @F.pandas_udf("double")
    def mapped(x: pd.Series, p0: pd.Series, a0: pd.Series, b0: pd.Series, p1: pd.Series, a1: pd.Series, b1: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        frame = pd.DataFrame({"x": x, "p0": p0, "a0": a0, "b0": b0, "p1": p1, "a1": a1, "b1": b1})
        for (q0, k0, s0, q1, k1, s1), g in frame.groupby(["p0", "a0", "b0", "p1", "a1", "b1"]):
            v = g["x"].to_numpy(float)
            c = special.gamma_cdf(v / s0, k0)
            if dry:
                q0 = min(q0, q1)
                c = np.where(v > 0, q0 + (1 - q0) * c, q0)
                c = np.clip((c - q1) / (1 - q1) if q1 < 1 else 0 * c, 0, None)
            out[g.index] = np.where(c > 0, special.gamma_ppf(np.clip(c, 0, 1 - 1e-12), k1) * s1, 0.0)
        return pd.Series(out)

    names = ["_p00", "_shape0", "_scale0", "_p01", "_shape1", "_scale1"]
    return d.select(*source.columns, mapped(F.col(value), *[F.col(c) for c in names]).alias("mapped"))


def spi(monthly: DataFrame, n: int = 3, cell: str = "qid") -> DataFrame:
    """(cell, year, month, value, spi): a gamma fitted to the positive n-month sums of a calendar month, mixed with the share of zeros.

    Fitting the positive sums with two parameters is the documented intent of the index.
    """
    from .indices import rolling_month

    d = rolling_month(monthly, n, cell)
    f = fit_distribution(d, [cell, "month"], thresh=0.0).select(cell, "month", F.col("p0").alias("_q"), "shape", "scale")

    @F.pandas_udf("double")
    def cdf(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
        return pd.Series(special.gamma_cdf(x.to_numpy(float) / scale.to_numpy(float), shape.to_numpy(float)))

    d = d.join(f, [cell, "month"]).withColumn("p", F.col("_q") + (1 - F.col("_q")) * F.when(F.col("shape").isNotNull(), cdf("value", "shape", "scale")))
    return d.withColumn("spi", F.expr(normal.ppf_sql("p"))).select(cell, "year", "month", "value", "spi")


def kuma_pdf(x: Column, a: Column, b: Column, low: float = 0.0, high: float = 1.0) -> Column:
    u = (x - low) / (high - low)
    return a * b * F.pow(u, a - 1) * F.pow(1 - F.pow(u, a), b - 1) / (high - low)


def kuma_cdf(x: Column, a: Column, b: Column) -> Column:
    return 1 - F.pow(1 - F.pow(x, a), b)


def kuma_quantile(q: Column, a: Column, b: Column) -> Column:
    return F.pow(1 - F.pow(1 - q, 1 / b), 1 / a)


def _kuma_log_moment(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = n / a
    small, large = np.minimum(b, c), np.maximum(b, c)  # the two may change places, and small steps lose nothing
    return special.log_gamma_ratio(1 + large, small) - special.log_gamma_ratio(np.ones_like(small), small)


def _kuma_moment(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.exp(_kuma_log_moment(n, a, b))


def kuma_moments(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """`df` with `moment`, the n-th raw moment."""

    @F.pandas_udf("double")
    def moment(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_kuma_moment(n, x.to_numpy(float), y.to_numpy(float)))

    return df.withColumn("moment", moment(a, b))


def _newton(gap, n: int, rounds: int = 100) -> np.ndarray:
    """(n, 2) roots of n systems of two equations at once, by Newton steps that each system halves until it gains; `gap(z, rows)` gives the equations of some systems.

    Systems that have settled leave the batch.
    """
    z, live = np.zeros((n, 2)), np.arange(n)
    for _ in range(rounds):
        f = gap(z[live], live)
        j = np.stack([(gap(z[live] + e, live) - gap(z[live] - e, live)) / 2e-6 for e in np.eye(2) * 1e-6], axis=2)
        det = j[:, 0, 0] * j[:, 1, 1] - j[:, 0, 1] * j[:, 1, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.stack([j[:, 0, 1] * f[:, 1] - j[:, 1, 1] * f[:, 0], j[:, 1, 0] * f[:, 0] - j[:, 0, 0] * f[:, 1]], axis=1) / det[:, None]
        step = np.where(np.isfinite(step), step, 0.0)
        size, miss = np.ones(len(live)), (f**2).sum(axis=1)
        reached = lambda: np.clip(z[live] + size[:, None] * step, -40, 60)  # noqa: E731, B023
        for _ in range(14):
            worse = ~((gap(reached(), live) ** 2).sum(axis=1) < miss)
            if not worse.any():
                break
            size[worse] /= 2
        move = np.abs(reached() - z[live]).max(axis=1)
        z[live] = reached()
        live = live[move >= 1e-12]
        if not len(live):
            break
    return z


def kuma_fit_moments(df: DataFrame, mean: str, sd: str) -> DataFrame:
    """`df` with (a, b) whose mean and variance are those given, by Newton steps between the logarithms of both, all rows of a batch at once.

    Null where the mean or the deviation is null, where no distribution on (0, 1) has
    them, and where a or b would pass what doubles can tell apart.
    """

    @F.pandas_udf("struct<a: double, b: double>")
    def solve(m: pd.Series, s: pd.Series) -> pd.DataFrame:
        mu, var = m.to_numpy(float), s.to_numpy(float) ** 2
        out = np.full((len(mu), 2), np.nan)
        good = np.flatnonzero((mu > 0) & (mu < 1) & (var > 0) & (var < mu * (1 - mu)))
        mu, var = mu[good], var[good]

        def gap(z, rows):
            a, b = np.exp(z[:, 0]), np.exp(z[:, 1])
            first, second = _kuma_log_moment(1, a, b), _kuma_log_moment(2, a, b)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                return np.stack([first - np.log(mu[rows]), np.log(np.expm1(second - 2 * first)) - np.log(var[rows] / mu[rows] ** 2)], axis=1)

        z = _newton(gap, len(good))
        reached = np.abs(gap(z, np.arange(len(good)))).max(axis=1) < 1e-6
        out[good] = np.where(reached[:, None], np.exp(z), np.nan)
        return pd.DataFrame(out, columns=["a", "b"])

    d = df.withColumn("_s", solve(mean, sd))
    return d.withColumns({c: F.when(~F.isnan(f"_s.{c}"), F.col(f"_s.{c}")) for c in ("a", "b")}).drop("_s")


def gbm_fit(prices: DataFrame, year_from: int = -1, month_from: int = 1, year_to: int = 0, month_to: int = 12) -> DataFrame:
    """(matyear, date, lr): log-returns between neighbouring dates of all dates in any contract's window; null prices break them.

    A contract's window runs from the first of `month_from` of matyear + year_from to the 28th of `month_to` of matyear + year_to.
    """
    start, stop = F.make_date(F.col("matyear") + year_from, F.lit(month_from), F.lit(1)), F.make_date(F.col("matyear") + year_to, F.lit(month_to), F.lit(28))
    d = prices.filter((F.col("date") >= start) & (F.col("date") <= stop))
    # The rank of a date among all that occur, through one row per date.
    days = d.select("date").distinct().withColumn("rank", F.row_number().over(Window.orderBy("date")))
    w = Window.partitionBy("matyear").orderBy("date")
    d = d.join(days, "date").withColumns({"before": F.lag("price").over(w), "gap": F.col("rank") - F.lag("rank").over(w)})
    return d.filter("gap = 1 and before > 0 and price > 0").select("matyear", "date", (F.ln("price") - F.ln("before")).alias("lr"))


def gbm_moments(returns: DataFrame) -> DataFrame:
    """(matyear, drift, volatility)."""
    return returns.groupBy("matyear").agg(F.avg("lr").alias("drift"), F.stddev_samp("lr").alias("volatility"))


def gbm_paths(params: DataFrame, days: int, sims: int, seed: str, keys: list[str]) -> DataFrame:
    """(keys, sim, day, level) of simulated prices relative to the start, with normals that depend on seed, keys, simulation and day only.

    Day 0 is the start; day 1 carries the increments of days 0 and 1.
    """
    d = params.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    d = d.withColumn("_key", F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("sim").cast("string"), F.col("day").cast("string")))
    d = d.withColumn("_z", F.expr(normal.hashed_normal_sql("_key")))
    b = F.sum("_z").over(Window.partitionBy(*keys, "sim").orderBy("day"))
    b = F.when(F.col("day") == 0, 0.0).otherwise(b)
    drift, vol = F.col("drift"), F.col("volatility")
    return d.select(*keys, "sim", "day", F.exp((drift - vol * vol / 2) * F.col("day") + vol * b).alias("level"))


#: The probabilities that a fit to quantiles looks at.
KUMA_QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99)


def kuma_fit_quantiles(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, a, b) whose cdf at the sample's quantiles is nearest to their probabilities, by damped Gauss-Newton on logarithms of a and b.

    Spark aggregates each group to its quantiles; only those meet numpy.
    """
    q = values.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p) for p in KUMA_QUANTILES])).alias("_q")).filter("_q is not null")

    @F.pandas_udf("struct<a: double, b: double>")
    def solve(quantiles: pd.Series) -> pd.DataFrame:
        p = np.array(KUMA_QUANTILES)
        u = np.clip(np.array([np.asarray(x, float) for x in quantiles]).reshape(-1, len(p)), 0.0, 1.0)
        z, damp, live = np.zeros((len(u), 2)), np.full(len(u), 1e-3), np.arange(len(u))
        gap = lambda z, rows: 1 - (1 - u[rows] ** np.exp(z[:, :1])) ** np.exp(z[:, 1:]) - p
        for _ in range(200):
            if not len(live):
                break
            f = gap(z[live], live)
            j = np.stack([(gap(z[live] + e, live) - gap(z[live] - e, live)) / 2e-6 for e in np.eye(2) * 1e-6], axis=2)
            normal_matrix = np.einsum("nki,nkj->nij", j, j) + damp[live][:, None, None] * np.eye(2)
            step = np.linalg.solve(normal_matrix, -np.einsum("nki,nk->ni", j, f)[:, :, None])[:, :, 0]
            gains = (gap(z[live] + step, live) ** 2).sum(axis=1) < (f**2).sum(axis=1)
            z[live] = np.where(gains[:, None], np.clip(z[live] + step, -8, 12), z[live])
            damp[live] = np.where(gains, damp[live] / 3, damp[live] * 4)
            live = live[(np.abs(step).max(axis=1) >= 1e-11) & (damp[live] <= 1e12)]
        return pd.DataFrame(np.exp(z), columns=["a", "b"])

    return q.withColumn("_s", solve("_q")).select(*keys, F.col("_s.a").alias("a"), F.col("_s.b").alias("b"))


def kuma_grid(df: DataFrame, means: tuple[float, ...], variations: tuple[float, ...]) -> DataFrame:
    """`df` times a grid of means and coefficients of variation, with the (a, b) of each; pairs no distribution on (0, 1) has are left out."""
    g = df.withColumn("mean", F.explode(F.array(*[F.lit(m) for m in means]))).withColumn("cv", F.explode(F.array(*[F.lit(c) for c in variations])))
    g = g.withColumn("sd", F.col("mean") * F.col("cv")).filter("sd * sd < mean * (1 - mean)")
    return kuma_fit_moments(g, "mean", "sd").drop("sd")


def _genlogistic_fits(x: np.ndarray, starts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """(groups, 3) of location, scale and shape c of the likeliest type I generalised logistic of each group; a group's values lie together in `x` from its start on.

    For given location and scale the best c is closed, so damped Newton steps with exact
    derivatives search location and log scale, for all groups at once; those that have settled
    leave the batch. Groups without deviation are NaN. Where the likelihood grows towards the edge of
    the family (skewness beyond a Gumbel's or an exponential's), steps end at the bounds
    or when they gain nothing any more.
    """
    n = np.diff([*starts, len(x)])
    mean = np.add.reduceat(x, starts) / n
    sd = np.sqrt(np.add.reduceat((x - np.repeat(mean, n)) ** 2, starts) / n)
    with np.errstate(all="ignore"):
        u = (x - np.repeat(mean, n)) / np.repeat(sd, n)
    owner = np.repeat(np.arange(len(n)), n)
    low, high = np.array([-40.0, -12.0]), np.array([40.0, 4.0])
    at, damp = np.tile([0.0, -0.6], (len(n), 1)), np.full(len(n), 1e-3)
    alive = sd > 1e-12 * np.maximum(np.abs(mean), 1e-300)

    def loss(place, v, first, count, whole=False):
        """Mean negative log-likelihood up to a constant; with `whole`, its gradient and Hessian as well."""
        scale = np.exp(place[:, 1])
        z = (v - np.repeat(place[:, 0], count)) / np.repeat(scale, count)
        each = lambda w: np.add.reduceat(w, first) / count
        tail = np.exp(-np.abs(z))
        soft = np.log1p(tail) + np.maximum(-z, 0.0)
        t, zm = each(soft), each(z)
        f = np.log(t) + place[:, 1] + zm + t
        if not whole:
            return f
        g = np.where(z > 0, tail, 1.0) / (1 + tail)
        h = tail / (1 + tail) ** 2
        tl, ts = each(g) / scale, each(g * z)
        tll, tls, tss = each(h) / scale**2, (each(h * z) - each(g)) / scale, each(h * z * z) - ts
        by = 1 / t + 1
        gradient = np.stack([by * tl - 1 / scale, by * ts + 1 - zm], axis=1)
        a, b, d = by * tll - (tl / t) ** 2, by * tls - tl * ts / t**2 + 1 / scale, by * tss - (ts / t) ** 2 + zm
        return f, gradient, np.stack([np.stack([a, b], axis=1), np.stack([b, d], axis=1)], axis=1)

    # Short groups may have several peaks: begin on the best place of a grid.
    live, best = np.flatnonzero(alive), np.full(len(n), np.inf)
    for place in ((a, b) for a in (-2.0, -1.0, 0.0, 0.7, 1.4, 2.2) for b in (-4.0, -2.5, -1.5, -0.6, 0.0)):
        if not len(live):
            break
        count = n[live]
        with np.errstate(divide="ignore", over="ignore"):
            f = loss(np.tile(place, (len(live), 1)), u[alive[owner]], np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        better = np.isfinite(f) & (f < best[live])
        at[live[better]], best[live[better]] = place, f[better]
    for _ in range(rounds):
        if not len(live):
            break
        mine = np.zeros(len(n), bool)
        mine[live] = True
        v, count = u[mine[owner]], n[live]
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        f, gradient, hessian = loss(at[live], v, first, count, True)
        # Lift the smaller eigenvalue above zero, so that every step goes downhill.
        half, diff, off = (hessian[:, 0, 0] + hessian[:, 1, 1]) / 2, (hessian[:, 0, 0] - hessian[:, 1, 1]) / 2, hessian[:, 0, 1]
        least = half - np.hypot(diff, off)
        lift = damp[live] * np.abs(half) + np.maximum(0.0, -least) * 1.001 + 1e-14
        aa, dd = hessian[:, 0, 0] + lift, hessian[:, 1, 1] + lift
        det = aa * dd - off**2
        with np.errstate(all="ignore"):
            step = -np.stack([dd * gradient[:, 0] - off * gradient[:, 1], aa * gradient[:, 1] - off * gradient[:, 0]], axis=1) / det[:, None]
        step = np.where(np.isfinite(step), np.clip(step, -2.0, 2.0), 0.0)
        there = np.clip(at[live] + step, low, high)
        with np.errstate(divide="ignore"):
            reached = loss(there, v, first, count)
        gains = np.isfinite(reached) & (reached <= f)
        moved = np.abs(there - at[live]).max(axis=1)
        at[live] = np.where(gains[:, None], there, at[live])
        damp[live] = np.where(gains, np.maximum(damp[live] / 10, 1e-15), damp[live] * 8 + 1e-12)
        live = live[(moved >= 1e-11) & (damp[live] < 1e12)]
    scale = np.exp(at[:, 1])
    with np.errstate(all="ignore"):
        z = (u - np.repeat(at[:, 0], n)) / np.repeat(scale, n)
        shape = n / np.add.reduceat(np.log1p(np.exp(-np.abs(z))) + np.maximum(-z, 0.0), starts)
    return np.where(alive[:, None], np.stack([mean + at[:, 0] * sd, scale * sd, shape], axis=1), np.nan)


def genlogistic_fit(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, loc, scale, c, _rows): the likeliest type I generalised logistic of each group, with the group's rows beside it.

    The density is c exp(-z) / (1 + exp(-z))^(c + 1) / scale with z = (x - loc) / scale. All groups of an
    Arrow batch, which is bounded by bytes, are fitted at once. Nulls do not count; groups without deviation have null parameters.
    """
    rest = [c for c in values.columns if c not in keys]
    grouped = values.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_rows"))

    @F.pandas_udf("struct<loc: double, scale: double, c: double>")
    def solve(lists: pd.Series) -> pd.DataFrame:
        sizes = np.array([len(v) for v in lists], dtype=np.int64)
        x = np.concatenate([np.asarray(v, float) for v in lists]) if len(lists) else np.zeros(0)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
        return pd.DataFrame(_genlogistic_fits(x, starts) if len(lists) else np.zeros((0, 3)), columns=["loc", "scale", "c"])

    d = grouped.withColumn("_s", solve(F.transform("_rows", lambda r: r[value].cast("double"))))
    return d.select(*keys, *[F.nanvl(f"_s.{c}", F.lit(None).cast("double")).alias(c) for c in ("loc", "scale", "c")], "_rows")


def spei_mle(balance: DataFrame, n: int = 3, cell: str = "qid") -> DataFrame:
    """(cell, year, month, value, spei) through a generalised logistic that is fitted to a calendar month's n-month sums by maximum likelihood.

    Null where all sums of a month are equal. One exchange by cell serves the sums and the fits.
    """
    from .indices import rolling_month

    d = genlogistic_fit(rolling_month(balance, n, cell), [cell, "month"])
    d = d.select(cell, "month", "loc", "scale", "c", F.inline("_rows"))
    d = d.withColumn("_z", (F.col("value") - F.col("loc")) / F.col("scale"))
    d = d.withColumn("_p", F.exp(-F.col("c") * (F.log1p(F.exp(-F.abs("_z"))) + F.greatest(-F.col("_z"), F.lit(0.0)))))
    return d.withColumn("spei", F.expr(normal.ppf_sql("_p"))).select(cell, "year", "month", "value", "spei")
