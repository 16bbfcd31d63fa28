"""Validation of simulated against historic weather, per cell and calendar month.

Tables are long: (qid, year, month, variable, value). `by` names further keys,
such as the source and the statistic, which come first in the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import corr

PERCENTILES = (0.1, 0.2, 0.5, *range(1, 100), 99.5, 99.8, 99.9)
DAILY_PERCENTILES = (0.01, 0.02, 0.05, *PERCENTILES, 99.995, 99.998, 99.999)


def climatology(monthly: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return monthly.groupBy(*by, "qid", "month", "variable").agg(F.avg("value").alias("value"))


def quantiles(monthly: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, by: tuple[str, ...] = ()) -> DataFrame:
    """(qid, month, variable, quantile, value) of the percentiles that the cell's span of years can show."""
    probs = [p / 100 for p in percentiles]
    g = monthly.groupBy(*by, "qid", "month", "variable").agg(F.percentile("value", F.array(*[F.lit(p) for p in probs])).alias("_q"))
    span = monthly.groupBy(*by, "qid").agg((F.max("year") - F.min("year") + 1).alias("_n"))
    d = g.join(span, [*by, "qid"]).select(*by, "qid", "month", "variable", "_n", F.posexplode("_q").alias("_i", "value"))
    d = d.withColumn("quantile", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1))
    return d.filter("quantile > 1 / _n and quantile < 1 - 1 / _n").select(*by, "qid", "month", "variable", "quantile", "value")


def percentiles(values: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 64) -> DataFrame:
    """(keys, n, i, value): the exact, interpolated percentile probs[i] of each group's n values, however many they are; nulls do not count.

    Equal values become one row with a count. Rough percentiles part each group
    into about `bins` ranges of values; the ranges' counts say where each begins, so
    ranks are counted range by range and no task holds or sorts a whole group.
    """
    each = values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    cuts = each.groupBy(*keys).agg(F.percentile_approx("_x", [k / bins for k in range(1, bins)], 20 * bins).alias("_cuts"), F.sum("_c").alias("n"))
    d = each.join(cuts, keys).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = d.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_s")).withColumn("_before", before).drop("_s")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(starts, [*keys, "_bin"]).withColumn("_end", F.col("_before") + upto).withColumn("_start", F.col("_end") - F.col("_c"))
    # The percentiles at a rank between a value's first and last, or next to them, and what it gives to each: all or a part.
    ps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    last = F.col("n") - 1
    mine = F.filter(ps, lambda p: (p["p"] * last > F.col("_start") - 1) & (p["p"] * last < F.col("_end")))
    d = d.select(*keys, "n", "_x", "_start", "_end", F.explode(mine).alias("_p"))
    at = F.col("_p.p") * last
    low, high = F.floor(at), F.ceil(at)
    share = F.when((low >= F.col("_start")) & (high < F.col("_end")), F.lit(1.0)).when(low >= F.col("_start"), high - at).otherwise(at - low)
    return d.groupBy(*keys, "n", F.col("_p.i").alias("i")).agg(F.sum(share * F.col("_x")).alias("value"))


def daily_quantiles(daily: DataFrame, shown: tuple[float, ...], variables: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(qid, month, variable, quantile, value) of days, limited by the largest count of days in a cell's months."""
    probs = [p / 100 for p in shown]
    keys = [*by, "qid", "month", "variable"]
    long = daily.withColumn("month", F.month("date")).unpivot([*by, "qid", "month"], list(variables), "variable", "value")
    d = percentiles(long, keys, "value", probs).withColumn("_n", F.max("n").over(Window.partitionBy(*by, "qid")))
    d = d.withColumn("quantile", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("i") + 1))
    return d.filter("quantile > 1 / _n and quantile < 1 - 1 / _n").select(*keys, "quantile", "value")


def similarity_ks(hist: DataFrame, stoc: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(qid, month, variable, n_hist, n_stoc, d): the two-sample Kolmogorov-Smirnov distance; equal values step together."""
    keys = [*by, "qid", "month", "variable"]
    both = hist.select(*keys, "value", F.lit(1).alias("h")).unionByName(stoc.select(*keys, "value", F.lit(0).alias("h")))
    every = Window.partitionBy(*keys)
    upto = every.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = both.filter("value is not null").withColumns({
        "_a": F.sum("h").over(upto), "_b": F.sum(1 - F.col("h")).over(upto), "_n": F.sum("h").over(every), "_m": F.sum(1 - F.col("h")).over(every),
    })
    return d.filter("_n > 0 and _m > 0").groupBy(*keys).agg(F.first("_n").alias("n_hist"), F.first("_m").alias("n_stoc"), F.max(F.abs(F.col("_a") / F.col("_n") - F.col("_b") / F.col("_m"))).alias("d"))


def cross_correlation(wide: DataFrame, variables: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(qid, month, variable, variable2, r) of all pairs, in one aggregation."""
    pairs = [(a, b) for a in variables for b in variables]
    g = wide.groupBy(*by, "qid", "month").agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    d = g.unpivot([*by, "qid", "month"], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return d.select(*by, "qid", "month", F.split_part("pair", F.lit("|"), F.lit(1)).alias("variable"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("variable2"), "r").filter("r is not null")


def spatial_correlation(monthly: DataFrame, references: list[int]) -> DataFrame:
    """(qid, qid_ref, variable, r) of each cell's series with each reference cell's; the list of references is small by definition."""
    ref = monthly.filter(F.col("qid").isin(*references)).select(F.col("qid").alias("qid_ref"), "variable", "year", "month", F.col("value").alias("_r"))
    return monthly.join(ref, ["variable", "year", "month"]).groupBy("qid", "qid_ref", "variable").agg(corr("value", "_r").alias("r"))
