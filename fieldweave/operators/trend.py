"""Trends and decompositions per cell.

Pairwise statistics take time of n log n for a series of n values, not of its
pairs: orders are counted by merging sorted runs, and of slopes only those are
listed that lie between two counted ones. A series is one group of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.stats import corr


def _merges(rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Merge sort from the bottom: at each level (places in runs, for each place of a right run how many of its left run rank below it, and how many not above).

    Runs lie in rows, a left and a right half in each; places beyond the end rank above all.
    """
    n = len(rank)
    size = 1 << max(n - 1, 0).bit_length()
    rank = np.append(rank, np.full(size - n, n + 1, dtype=np.int64))
    at, width = np.arange(size), 1
    while width < size:
        runs = at.reshape(-1, 2 * width)
        base = np.arange(len(runs))[:, None] * (n + 2)
        left, right = (rank[runs[:, :width]] + base).ravel(), (rank[runs[:, width:]] + base).ravel()
        before = np.repeat(np.arange(len(runs)) * width, width)
        yield runs, np.searchsorted(left, right, "left") - before, np.searchsorted(left, right, "right") - before
        at = np.take_along_axis(runs, np.argsort(rank[runs], axis=1, kind="stable"), 1).ravel()
        width *= 2


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64).ravel()


def kendall_s(x: np.ndarray) -> int:
    """Pairs in order less pairs out of order."""
    out = 0
    for runs, below, upto in _merges(_ranks(x)):
        width = runs.shape[1] // 2
        real = runs[:, width:].ravel() < len(x)
        out += int(below[real].sum()) - int((width - upto[real]).sum())
    return out


def _slopes_upto(t: np.ndarray, x: np.ndarray, slope: float) -> int:
    """How many pairs have at most this slope."""
    out = 0
    for runs, below, _ in _merges(_ranks(x - slope * t)):
        width = runs.shape[1] // 2
        real = runs[:, width:].ravel() < len(x)
        out += int((width - below[real]).sum())
    return out


def _slopes_between(t: np.ndarray, x: np.ndarray, low: float, high: float) -> np.ndarray:
    """The slopes above `low` and up to `high`: those of the pairs whose order by x - slope t differs at the two."""
    first = np.lexsort((-t, x - low * t))
    out = []
    for runs, below, _ in _merges(_ranks((x - high * t)[first])):
        width = runs.shape[1] // 2
        rights = runs[:, width:].ravel()
        count = np.where(rights < len(x), width - below, 0)
        a = np.repeat(np.repeat(np.arange(len(runs)) * 2 * width, width) + below, count)
        a = runs.ravel()[a + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)]
        a, b = first[a], first[np.repeat(rights, count)]
        out.append((x[b] - x[a])[t[a] < t[b]] / (t[b] - t[a])[t[a] < t[b]])
    return np.concatenate(out) if out else np.empty(0)


def nth_slopes(t: np.ndarray, x: np.ndarray, places: list[int], most: int = 300_000) -> list[float]:
    """The slopes of pairs at `places` of their sorted order, from 0.

    The interval of slopes is halved by counting until at most `most` are left in
    it, which are then listed, or until it holds equal slopes only, up to rounding.
    """
    n = len(x)
    steps = np.diff(x) / np.diff(t)
    low, high = float(steps.min()) - 1.0, float(steps.max()) + 1.0  # a pair's slope is a mean of the steps between
    known = {low: 0, high: n * (n - 1) // 2}

    def upto(slope: float) -> int:
        if slope not in known:
            known[slope] = _slopes_upto(t, x, slope)
        return known[slope]

    out = []
    for k in places:
        a, b = low, high
        for zero in (np.nextafter(0.0, -1.0), 0.0):  # values that repeat make many slopes of zero
            if a < zero < b:
                a, b = (a, zero) if upto(zero) > k else (zero, b)
        while upto(b) - upto(a) > most:
            mid = a + (b - a) / 2
            if not a < mid < b or b - a <= 1e-15 * max(abs(a), abs(b)):
                break
            a, b = (a, mid) if upto(mid) > k else (mid, b)
        if a == np.nextafter(0.0, -1.0) and b == 0.0:
            out.append(0.0)
        elif upto(b) - upto(a) > most:
            out.append(b)
        else:
            found = np.sort(_slopes_between(t, x, a, b))
            out.append(float(found[min(max(k - upto(a), 0), len(found) - 1)]) if len(found) else b)
    return out


def _exact_p(n: Column, s: Column) -> Column:
    """The exact two-sided p of Kendall's s for n values without ties, from the counts of orders by inversions."""

    @F.pandas_udf("double")
    def p(n: pd.Series, s: pd.Series) -> pd.Series:
        held: dict[int, np.ndarray] = {}
        out = []
        for k, x in zip(n.to_numpy(int), s.to_numpy(float)):
            if k not in held:
                share = np.ones(1)
                for j in range(2, k + 1):  # a j-th value adds 0 to j - 1 inversions, each as likely
                    share = np.convolve(share, np.full(j, 1 / j))
                held[k] = share
            most = k * (k - 1) // 2
            few = int(round((most - abs(x)) / 2))
            out.append(min(1.0, 2 * float(held[k][: few + 1].sum())))
        return pd.Series(out, dtype=float)

    return p(n, s)


def mann_kendall(series: DataFrame, keys: list[str], order: str, value: str = "value", exact: bool = False) -> DataFrame:
    """(keys, n, s, tau, p): Kendall's tau-b against time, with a two-sided p by the normal approximation with ties.

    With `exact`, p is exact where no values are tied and there are at most 33 of
    them, or at most one pair of values is out of order.
    """
    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        return pdf[keys].iloc[:1].assign(s=float(kendall_s(x)))

    known = series.filter(F.col(value).isNotNull()).select(*keys, order, value)
    s = known.groupBy(*keys).applyInPandas(counted, known.select(*keys).schema.add("s", "double"))
    ties = series.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("t"))
    t = F.col("t")
    by = ties.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(t * (t - 1)).alias("tied"), F.sum(t * (t - 1) * (2 * t + 5)).alias("v"))
    n = F.col("n")
    d = by.join(s, keys, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    whole = (n * (n - 1)).cast("double")
    d = d.withColumn("tau", F.try_divide(2 * F.col("s"), F.sqrt(whole) * F.sqrt(whole - F.col("tied"))))
    var = (n * (n - 1) * (2 * n + 5) - F.col("v")) / 18.0
    d = d.withColumn("z", -F.abs(F.try_divide("s", F.sqrt(var))))
    p = 2 * F.expr(normal.cdf_sql("z"))
    if exact:
        most = n * (n - 1) / 2
        plain = (F.col("tied") == 0) & (n > 1) & ((n <= 33) | ((n <= 1000) & (most - F.abs("s") <= 2)))
        d = d.withColumn("_p", _exact_p(F.when(plain, n).otherwise(F.lit(2)), F.when(plain, F.col("s")).otherwise(F.lit(0.0))))
        p = F.when(plain, F.col("_p")).otherwise(p)
    return d.select(*keys, "n", "s", "tau", p.alias("p"))


def theil_sen(series: DataFrame, keys: list[str], order: str, value: str = "value", z: float = 1.959963984540054) -> DataFrame:
    """(keys, slope, intercept, low, high): the median of pairwise slopes with bounds by Kendall's variance (95 %).

    Time counts rows from zero.
    """

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        n, t = len(x), np.arange(len(x), dtype=float)
        if n < 2:
            return pdf[keys].iloc[:0].assign(slope=0.0, intercept=0.0, low=0.0, high=0.0)
        tied = np.unique(x, return_counts=True)[1].astype(float)
        pairs = n * (n - 1) // 2
        reach = z * np.sqrt((n * (n - 1) * (2 * n + 5) - (tied * (tied - 1) * (2 * tied + 5)).sum()) / 18)
        places = [(pairs - 1) // 2, pairs // 2, max(round((pairs - reach) / 2) - 1, 0), min(round((pairs + reach) / 2), pairs - 1)]
        a, b, low, high = nth_slopes(t, x, places)
        slope = (a + b) / 2
        return pdf[keys].iloc[:1].assign(slope=slope, intercept=float(np.median(x)) - slope * (n - 1) / 2, low=low, high=high)

    known = series.filter(F.col(value).isNotNull()).select(*keys, order, value)
    schema = known.select(*keys).schema
    for c in ("slope", "intercept", "low", "high"):
        schema = schema.add(c, "double")
    return known.groupBy(*keys).applyInPandas(fitted, schema)


def linear_trend(series: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """(keys, n, slope, intercept, r, stderr) of the value on row numbers from zero."""
    d = series.filter(F.col(value).isNotNull()).withColumn("_t", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("double"))
    f = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(value, "_t").alias("slope"), F.regr_intercept(value, "_t").alias("intercept"), corr(value, "_t").alias("r")
    )
    err = F.when(F.col("r") != 0, F.abs("slope") * F.sqrt(F.greatest(F.try_divide(1 / (F.col("r") * F.col("r")) - 1, F.col("n") - 2), F.lit(0.0))))
    return f.withColumn("stderr", err)


def decompose(series: DataFrame, keys: list[str], order: list[str], season: str, back: int, ahead: int, value: str = "value", multiplicative: bool = False) -> DataFrame:
    """`series` with trend (mean of the rows -back..+ahead, null if incomplete), seasonal (mean by season) and residual."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, ahead)
    x = F.col(value)
    d = series.withColumn("trend", F.when(F.count(x).over(w) == back + ahead + 1, F.avg(x).over(w)))
    rest = F.try_divide(x, F.col("trend")) if multiplicative else x - F.col("trend")
    d = d.withColumn("seasonal", F.avg(rest).over(Window.partitionBy(*keys, season)))
    residual = F.try_divide(x, F.col("trend") * F.col("seasonal")) if multiplicative else x - F.col("trend") - F.col("seasonal")
    return d.withColumn("residual", residual)


def detrend(values: DataFrame, trend: DataFrame, pivot_year: int, keys: list[str]) -> DataFrame:
    """`values` moved to the climate of `pivot_year`: plus (pivot_year - year) times the slope of its keys and month."""
    d = values.join(trend.select(*keys, "month", "slope"), [*keys, "month"])
    return d.withColumn("value", F.col("value") + (F.lit(pivot_year) - F.col("year")) * F.col("slope")).drop("slope")
