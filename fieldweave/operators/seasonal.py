"""Seasons: aggregation, transforms, leading patterns, analogue years.

A season is named by its last month. Sets of season months wrap around the
year: with 2, 5, 8, 11, December belongs to season 2 of the next year.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal, special
from ..functions.stats import corr
from ..sources.scratch import stored

SEASONS = (2, 5, 8, 11)


def season_of(month: Column, seasons: tuple[int, ...] = SEASONS) -> Column:
    out = F.lit(min(seasons))
    for s in sorted(seasons, reverse=True):
        out = F.when(month <= s, F.lit(s)).otherwise(out)
    return out


def season_label(month: Column, length: int = 3) -> Column:
    """The initials of the months that end with this one, as DJF for 2."""
    initials = "JFMAMJJASOND"
    out = F.lit(None).cast("string")
    for m in range(1, 13):
        out = F.when(month == m, F.lit("".join(initials[(m - length + k) % 12] for k in range(length)))).otherwise(out)
    return out


def season_year(year: Column, month: Column, seasons: tuple[int, ...] = SEASONS) -> Column:
    return year + F.when(month > max(seasons), 1).otherwise(0)


def season_key(year: Column, season: Column, seasons: tuple[int, ...] = SEASONS) -> Column:
    """A running number of seasons."""
    out = F.lit(None).cast("int")
    for k, s in enumerate(sorted(seasons)):
        out = F.when(season == s, F.lit(k)).otherwise(out)
    return (year * len(seasons) + out).cast("int")


def season_aggregate(monthly: DataFrame, seasons: tuple[int, ...] = SEASONS, length: int = 3, sums: tuple[str, ...] = ("pre",)) -> DataFrame:
    """(variable, year, season, qid, value): rolling sums or means of rows at season ends, of seasons that every cell has."""
    w = Window.partitionBy("variable", "qid").orderBy("year", "month").rowsBetween(1 - length, 0)
    x = F.when(F.col("variable").isin(*sums), F.sum("value").over(w)).otherwise(F.avg("value").over(w))
    d = monthly.withColumn("value", F.when(F.count("value").over(w) == length, x)).filter(F.col("month").isin(*seasons) & F.col("value").isNotNull())
    cells = d.groupBy("variable").agg(F.countDistinct("qid").alias("cells"))
    full = d.groupBy("variable", "year", "month").agg(F.count("*").alias("n")).join(cells, "variable").filter("n = cells")
    return d.join(full.select("variable", "year", "month"), ["variable", "year", "month"], "left_semi").select("variable", "year", F.col("month").alias("season"), "qid", "value")


def anomalies(seasonal: DataFrame) -> DataFrame:
    """`seasonal` with its mean, sample deviation and standardised anomaly by (variable, season, cell)."""
    w = Window.partitionBy("variable", "season", "qid")
    d = seasonal.withColumns({"mean": F.avg("value").over(w), "sd": F.stddev_samp("value").over(w)})
    return d.withColumn("anom", F.try_divide(F.col("value") - F.col("mean"), F.col("sd")))


def normality_d(anom: DataFrame, keys: list[str], value: str = "anom") -> DataFrame:
    """(keys, n, d): the one-sample Kolmogorov-Smirnov distance from the standard normal."""
    w = Window.partitionBy(*keys)
    d = anom.filter(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w), "_x": F.col(value)})
    phi = F.expr(normal.cdf_sql("_x"))
    return d.groupBy(*keys).agg(F.first("_n").alias("n"), F.max(F.greatest(F.col("_i") / F.col("_n") - phi, phi - (F.col("_i") - 1) / F.col("_n"))).alias("d"))


def with_kolmogorov_p(stats: DataFrame, n: Column) -> DataFrame:
    """`stats` (with d, the distance of n values from a distribution) and its exact p-value; asymptotic above 10,000 values."""

    @F.pandas_udf("double")
    def p(d: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else special.kolmogorov_exact_p(float(a), int(b)) for a, b in zip(d, m)], dtype=float)

    return stats.withColumn("p", p("d", n.cast("long")))


def with_two_sample_p(stats: DataFrame, n: str = "n_hist", m: str = "n_stoc") -> DataFrame:
    """`stats` (with d, the distance of samples of n and m values) and its exact p-value; asymptotic above 10,000 values.

    Groups of equal sizes and distance share their p, which is counted once in a batch.
    """

    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        held: dict[tuple, float] = {}
        for key in set(zip(d, n, m)):
            held[key] = special.two_sample_p(float(key[0]), int(key[1]), int(key[2]))
        return pd.Series([held[key] for key in zip(d, n, m)], dtype=float)

    known = F.col("d").isNotNull() & F.col(n).isNotNull() & F.col(m).isNotNull()
    value = p(F.when(known, F.col("d")).otherwise(1.0), F.when(known, F.col(n)).otherwise(1).cast("long"), F.when(known, F.col(m)).otherwise(1).cast("long"))
    return stats.withColumn("p", F.when(known, value))


def boxcox_fit(seasonal: DataFrame, shift: float = 0.0, powers: tuple[float, ...] = tuple(np.arange(0.001, 1.001, 0.002).round(3).tolist())) -> DataFrame:
    """(variable, season, qid, power, d): the power whose standardised transform is nearest to normal by the upper ecdf step; the first on ties; null for fewer than two different values.

    A group is one cell's seasons, so it is small; its values are sorted once for all powers.
    """

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["value"].dropna().to_numpy(float)) + shift
        n = len(x)
        d = np.full(len(powers), np.nan)
        if n > 1 and x[0] < x[-1]:
            p = np.array(powers)[:, None]
            with np.errstate(all="ignore"):
                y = (x[None, :] ** p - 1) / p
                z = (y - y.mean(axis=1, keepdims=True)) / y.std(axis=1, ddof=1, keepdims=True)
                d = np.abs(np.arange(1, n + 1) / n - normal.cdf(z)).max(axis=1)
        k = int(np.nanargmin(d)) if np.isfinite(d).any() else None
        first = pdf.iloc[0]
        return pd.DataFrame([(first["variable"], first["season"], first["qid"], None if k is None else powers[k], None if k is None else float(d[k]))], columns=["variable", "season", "qid", "power", "d"])

    return seasonal.select("variable", "season", "qid", "value").groupBy("variable", "season", "qid").applyInPandas(best, "variable string, season int, qid long, power double, d double")


def boxcox(value: Column, power: Column, shift: float = 0.0) -> Column:
    return (F.pow(value + shift, power) - 1) / power


def boxcox_inverse(value: Column, power: Column, shift: float = 0.0) -> Column:
    """Back to the value; what has none becomes zero."""
    base = value * power + 1
    return F.coalesce(F.when(base >= 0, F.pow(F.when(base >= 0, base), 1 / power) - shift), F.lit(0.0))


def gram(anom: DataFrame, weight: Column | None = None) -> DataFrame:
    """(variable, season, y1, y2, g): inner products of years over cells; years x years rows whatever the number of cells."""
    v = F.col("anom") * (F.lit(1.0) if weight is None else weight)
    # A cell's years in one row, so that its products need no join; they are summed before they are shuffled.
    cells = anom.groupBy("variable", "season", "qid").agg(F.collect_list(F.struct("year", v.alias("v"))).alias("_x"))
    pairs = cells.select("variable", "season", "_x", F.explode("_x").alias("_a")).select("variable", "season", "_a", F.explode("_x").alias("_b"))
    return pairs.groupBy("variable", "season", F.col("_a.year").alias("y1"), F.col("_b.year").alias("y2")).agg(F.sum(F.col("_a.v") * F.col("_b.v")).alias("g"))


def normal_cells(anom: DataFrame, least: float = 0.05) -> DataFrame:
    """(variable, season, qid) of cells whose anomalies the one-sample test does not reject at `least`."""
    return with_kolmogorov_p(normality_d(anom, ["variable", "season", "qid"]), F.col("n")).filter(F.col("p") >= least).select("variable", "season", "qid")


def finished(values: DataFrame, bounds: dict[str, tuple[float, float]], shift: float = 0.0) -> DataFrame:
    """(variable, season, year, qid, value) from transformed values with their `power`: back through Box-Cox, zero where there is none, clipped, in single precision."""
    x = boxcox_inverse(F.col("value"), F.col("power"), shift)
    for name, (low, high) in bounds.items():
        x = F.when(F.col("variable") == name, F.least(F.greatest(x, F.lit(low)), F.lit(high))).otherwise(x)
    return values.select("variable", "season", "year", "qid", x.cast("float").cast("double").alias("value"))


def complete_cells(anom: DataFrame) -> DataFrame:
    """`anom` without the cells that lack a value in a year that their (variable, season) has; a group without a complete cell is an error that names it."""
    keys = ["variable", "season"]
    known = anom.filter("anom is not null")
    years = known.groupBy(*keys).agg(F.count_distinct("year").alias("_years"))
    cells = known.groupBy(*keys, "qid").agg(F.count_distinct("year").alias("_own"))
    full = cells.join(F.broadcast(years), keys).filter("_own = _years").select(*keys, "qid")  # years has a row for each variable and season
    lost = years.join(full.select(*keys).distinct(), keys, "left_anti").collect()
    if lost:
        raise ValueError("no cell has every year of " + ", ".join(f"{r['variable']}, season {r['season']}" for r in lost))
    return known.join(full, [*keys, "qid"], "left_semi")


class _Krylov:
    """Leading eigenvectors of one group's products of years, from products with blocks of vectors; the matrix itself is never there."""

    def __init__(self, years: list[int], pairs: int | None, block: int, tolerance: float):
        self.years, self.pairs, self.block, self.tolerance = years, pairs, block, tolerance
        self.basis = self.image = np.zeros((len(years), 0))
        self.rng = np.random.default_rng(len(years))
        self.asked = self._orthogonal(self.rng.standard_normal((len(years), min(block, len(years)))))
        self.values, self.vectors = np.zeros(0), self.basis

    def _orthogonal(self, new: np.ndarray) -> np.ndarray:
        """`new` made orthonormal and orthogonal to the basis; directions that vanish are drawn anew while there is room."""
        n, out = len(self.years), self.basis
        for column in new.T:
            if out.shape[1] == n:
                break
            for _ in range(20):
                left = column - out @ (out.T @ column)
                left -= out @ (out.T @ left)
                if np.linalg.norm(left) > 1e-10 * max(np.linalg.norm(column), 1e-300):
                    break
                column = self.rng.standard_normal(n)
            left /= np.linalg.norm(left)
            left -= out @ (out.T @ left)
            out = np.column_stack([out, left / np.linalg.norm(left)])
        return out[:, self.basis.shape[1] :]

    def told(self, image: np.ndarray) -> bool:
        """Takes the product with `asked`; whether the wanted pairs have settled, or the basis spans all years."""
        self.basis, self.image = np.column_stack([self.basis, self.asked]), np.column_stack([self.image, image])
        small = self.basis.T @ self.image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        n = self.basis.shape[1]
        wanted = n if self.pairs is None else min(self.pairs, n)
        self.values, self.vectors = values[:wanted], self.basis @ turn[:, :wanted]
        if n == len(self.years):
            return True
        if self.pairs is not None and n > self.pairs:
            one_more = wanted + 1  # pairs of equal size can hide behind one another
            rest = self.image @ turn[:, :one_more] - self.basis @ turn[:, :one_more] * values[:one_more]
            if np.linalg.norm(rest, axis=0).max() <= self.tolerance * max(values[0], 0.0):
                return True
        self.asked = self._orthogonal(image)
        return False


def _products(cells: DataFrame, blocks: dict[tuple[str, int], np.ndarray]) -> dict[tuple[str, int], np.ndarray]:
    """Sum over cells of x (x'B) for each group's block B; tasks add up their cells, Spark adds up the tasks year by year."""
    width = max(b.shape[1] for b in blocks.values())
    names = [f"s{j}" for j in range(width)]

    def run(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(["variable", "season"]):
                b = blocks.get((key[0], int(key[1])))
                if b is not None:
                    x = np.stack(part["x"].to_list())
                    sums[key] = sums.get(key, 0) + x.T @ (x @ b)
        for (v, s), total in sums.items():
            out = pd.DataFrame(np.pad(total, ((0, 0), (0, width - total.shape[1]))), columns=names)
            yield out.assign(variable=v, season=int(s), at=np.arange(len(out)))[["variable", "season", "at", *names]]

    schema = "variable string, season int, at long, " + ", ".join(f"{c} double" for c in names)
    rows = cells.mapInPandas(run, schema).groupBy("variable", "season", "at").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = {k: np.zeros(b.shape) for k, b in blocks.items()}
    for r in rows:
        own = out[r["variable"], r["season"]]
        own[r["at"]] = [r[c] for c in names[: own.shape[1]]]
    return out


def pca(
    anom: DataFrame, weight: Column | None = None, least: float = 1e-6, modes: int | None = None, block: int = 16, tolerance: float = 1e-12
) -> tuple[DataFrame, DataFrame]:
    """(eofs, pcs): leading patterns (variable, season, mode, qid, loading) and scores (variable, season, year, mode, score).

    Cells never leave the executors, and products of years with years are never
    formed: a block Krylov iteration asks for products of all cells with a few
    vectors over years at a time, until the first `modes` have settled or all
    directions are there. So the driver holds years x directions. A cell that lacks
    one of its group's years is left out, the group stays; a group without a
    complete cell is an error. Modes without variance are left out; the largest
    score of a mode is positive.
    """
    spark = anom.sparkSession
    w = F.lit(1.0) if weight is None else weight
    anom = complete_cells(anom).withColumn("_v", F.col("anom") * w)
    by_year = F.array_sort(F.collect_list(F.struct("year", "_v")))
    cells = anom.groupBy("variable", "season", "qid").agg(by_year.alias("_x")).select("variable", F.col("season").cast("int").alias("season"), F.transform("_x", lambda y: y["_v"]).alias("x"))
    cells = stored(spark, cells, "cells")
    years: dict[tuple[str, int], list[int]] = {}
    for r in anom.select("variable", "season", "year").distinct().collect():
        years.setdefault((r["variable"], int(r["season"])), []).append(int(r["year"]))
    groups = {k: _Krylov(sorted(v), modes, block, tolerance) for k, v in years.items()}
    open_ = dict(groups)
    while open_:
        images = _products(cells, {k: g.asked for k, g in open_.items()})
        open_ = {k: g for k, g in open_.items() if not g.told(images[k])}
    vectors = []
    for (v, s), g in groups.items():
        size = np.sqrt(np.maximum(g.values, 0))
        for k in range(len(size)):
            if size[k] > least * max(size[0], 1e-300) and size[k] > 1e-9:
                u = g.vectors[:, k] * np.sign(g.vectors[np.argmax(np.abs(g.vectors[:, k])), k])
                vectors += [(v, s, y, k, float(x), float(size[k])) for y, x in zip(g.years, u)]
    table = spark.createDataFrame(vectors, "variable string, season int, year int, mode int, v double, size double")
    pcs = table.select("variable", "season", "year", "mode", (F.col("v") * F.col("size")).alias("score"))
    joined = anom.join(table, ["variable", "season", "year"])  # years x modes rows, whatever the number of cells
    eofs = joined.groupBy("variable", "season", "mode", "qid").agg((F.sum(F.col("_v") * F.col("v") / F.col("size"))).alias("loading"))
    return eofs, pcs


def variance_explained(pcs: DataFrame) -> DataFrame:
    """(variable, season, mode, share, cumulative)."""
    v = pcs.groupBy("variable", "season", "mode").agg(F.var_samp("score").alias("_v"))
    every = Window.partitionBy("variable", "season")
    d = v.withColumn("share", F.col("_v") / F.sum("_v").over(every))
    return d.select("variable", "season", "mode", "share", F.sum("share").over(every.orderBy("mode")).alias("cumulative"))


def correlations(long: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """(keys, var_i, var_j, n, r) of every pair of names in (keys, on, name, x)."""
    a = long.select(*keys, *on, F.col("name").alias("var_i"), F.col("x").alias("_a"))
    b = long.select(*keys, *on, F.col("name").alias("var_j"), F.col("x").alias("_b"))
    return a.join(b, [*keys, *on]).groupBy(*keys, "var_i", "var_j").agg(F.count("*").alias("n"), corr("_a", "_b").alias("r"))


def with_correlation_p(found: DataFrame) -> DataFrame:
    """`found` with Student's t and its two-sided p; null for fewer than three pairs and for exact lines."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(special.student_p(t.to_numpy(float), n.to_numpy(float) - 2))

    n, r = F.col("n"), F.col("r")
    t = F.when((n > 2) & (F.abs(r) < 1 - 1e-12), r * F.sqrt(F.try_divide(n - 2, 1 - r * r)))
    d = found.withColumn("t", t)
    return d.withColumn("p", F.when(F.col("t").isNotNull(), p(F.coalesce("t", F.lit(0.0)), "n")))


def analogues(stoc: DataFrame, hist: DataFrame) -> DataFrame:
    """(season, year, histyear, d2): the historic year nearest to each simulated one; both tables are (variable, season, year, mode, score).

    Squared distances are weighted by each mode's share of its variable's variance; the earliest year wins ties.
    """
    shares = hist.groupBy("variable", "season", "mode").agg(F.var_samp("score").alias("_v"))
    w = shares.withColumn("_w", F.col("_v") / F.sum("_v").over(Window.partitionBy("variable", "season"))).drop("_v")
    h = hist.join(w, ["variable", "season", "mode"]).select("variable", "season", "mode", F.col("year").alias("histyear"), F.col("score").alias("_h"), "_w")
    d = stoc.join(h, ["variable", "season", "mode"]).groupBy("season", "year", "histyear").agg(F.sum(F.col("_w") * F.pow(F.col("score") - F.col("_h"), F.lit(2))).alias("d2"))
    best = F.min(F.struct("d2", "histyear")).alias("best")
    return d.groupBy("season", "year").agg(best).select("season", "year", "best.histyear", "best.d2")


def random_modes(modes: DataFrame, years: DataFrame, seed: str, stored: DataFrame | None = None) -> DataFrame:
    """(variable, season, mode, year, z): standard normals that depend on seed and keys only; `stored` draws of that form come first."""
    d = modes.join(years, how="cross")
    d = d.withColumn("_key", F.concat_ws("|", F.lit(seed), F.col("year").cast("string"), F.col("season").cast("string"), "variable", F.col("mode").cast("string")))
    d = d.withColumn("z", F.expr(normal.hashed_normal_sql("_key"))).select("variable", "season", "mode", "year", "z")
    if stored is None:
        return d
    keys = ["variable", "season", "mode", "year"]
    d = d.join(stored.select(*keys, F.col("z").alias("_z")), keys, "left")
    return d.select(*keys, F.coalesce("_z", "z").alias("z"))


def synthesise(scores: DataFrame, eofs: DataFrame, moments: DataFrame, blocks: int | None = None) -> DataFrame:
    """(variable, season, year, qid, value): scores times loadings, times the deviation, plus the mean of (variable, season, qid, mean, sd).

    A year's scores and a cell's loadings are one row each, and cells lie in
    `blocks` that all years are sent to, so the join makes a row for each value
    of the result and no more, over as many keys as there are blocks and seasons.
    """
    n = blocks or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_mode = lambda value: F.map_from_entries(F.collect_list(F.struct("mode", value)))
    cells = eofs.groupBy("variable", "season", "qid").agg(F.array_sort(F.collect_list(F.struct("mode", "loading"))).alias("_l"))
    cells = cells.join(moments, ["variable", "season", "qid"]).withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(n)))
    years = scores.groupBy("variable", "season", "year").agg(by_mode("score").alias("_s")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    d = cells.join(years, ["variable", "season", "_block"])
    terms = F.filter(F.transform("_l", lambda x: x["loading"] * F.try_element_at("_s", x["mode"])), lambda x: x.isNotNull())
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return d.filter(F.size(terms) > 0).select("variable", "season", "year", "qid", (total * F.col("sd") + F.col("mean")).alias("value"))


def cholesky(found: DataFrame, ridge: float = 1e-9) -> DataFrame:
    """(season, var_i, var_j, l): the lower factor of each season's correlation matrix, names in order.

    The matrix has as many rows as there are modes and indices, whatever the
    number of cells or years, so one task per season holds it.
    """

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="var_i", columns="var_j", values="r").sort_index().sort_index(axis=1)
        m = m.fillna(0.0).to_numpy() + ridge * np.eye(len(m)), list(m.index)
        lam, vec = np.linalg.eigh(m[0])
        # Pairs of short series can make it slightly indefinite; the nearest definite matrix is factored.
        fixed = m[0] if lam[0] > 0 else (vec * np.maximum(lam, ridge)) @ vec.T
        low = np.linalg.cholesky(fixed)
        names = m[1]
        return pd.DataFrame([(pdf["season"].iloc[0], a, b, low[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if j <= i], columns=["season", "var_i", "var_j", "l"])

    return found.groupBy("season").applyInPandas(factor, "season int, var_i string, var_j string, l double")


def correlate_modes(draws: DataFrame, factor: DataFrame, deviations: DataFrame) -> DataFrame:
    """(season, year, name, score): standardised draws (season, year, name, z) times the factor's transpose, scaled by (season, name, sd).

    Names without a deviation, such as climate indices, fall out.
    """
    w = Window.partitionBy("season", "name")
    z = draws.withColumn("z", (F.col("z") - F.avg("z").over(w)) / F.stddev_samp("z").over(w))
    f = factor.select("season", F.col("var_i").alias("name"), F.col("var_j").alias("_from"), "l")
    d = z.withColumnRenamed("name", "_from").join(f, ["season", "_from"]).groupBy("season", "year", "name").agg(F.sum(F.col("z") * F.col("l")).alias("score"))
    return d.join(deviations, ["season", "name"]).select("season", "year", "name", (F.col("score") * F.col("sd")).alias("score"))
